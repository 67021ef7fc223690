"""Queries of the record engine over the driver's tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import alignment as al
from ..operators import annotations as an
from ..operators import assessment as asm
from ..operators import evaluation as ev
from ..operators import governance as gv
from ..operators import groundtruth as gt
from ..operators import ordered as od
from ..operators import pixels as px
from ..operators import recognition as rc
from ..operators import reconcile as rec
from .bridges import bridge, bridge_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


EV, PL, FO, TF, WR, PR, CA, RV, PX, GT, AC, RC = (
    bridge_sql(n) for n in ("scoring_events", "players", "foul_cells", "team_foul_cells", "written_scores", "predictions", "catalog", "reviews", "pixels", "ground_truth", "automatic_crops", "reviewed_crops")
)
BY = "PARTITION BY document_id, side ORDER BY running_score, seq"
DELTA = f"(SELECT *, running_score - COALESCE(LAG(running_score) OVER ({BY}), 0) AS delta FROM {EV} b)"
PERIODS = f"""(SELECT document_id, side, event_id, points, shot_type, jersey, running_score, seq, status,
  CASE WHEN p <= 4 THEN p WHEN ink_color = 'blue' THEN 4 END AS period FROM (SELECT *, CASE WHEN f = 'red' THEN 1 ELSE 2 END + k - 1 AS p FROM (
  SELECT *, SUM(CASE WHEN pv IS NULL OR pv <> ink_color THEN 1 ELSE 0 END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (
  SELECT *, LAG(ink_color) OVER ({BY}) AS pv, FIRST_VALUE(ink_color) OVER ({BY}) AS f FROM {EV} b WHERE ink_color IN ('red', 'blue')) x) y) z
  UNION ALL SELECT document_id, side, event_id, points, shot_type, jersey, running_score, seq, status, NULL FROM {EV} b WHERE ink_color NOT IN ('red', 'blue'))"""
JUMPS = f"(SELECT event_id, points <> running_score - COALESCE(LAG(running_score) OVER ({BY}), 0) AS jump FROM {EV} b WHERE points > 0 AND shot_type <> 'ambiguous')"


def periods(spark: SparkSession, d: str) -> DataFrame:
    return od.color_run_periods(bridge(spark, d, "scoring_events"))


@query("game_ledger", f"""SELECT e.document_id, e.side, CAST(period AS BIGINT) AS period, COUNT(*) AS n_events, CAST(SUM(points) AS BIGINT) AS score, COUNT(*) FILTER (WHERE COALESCE(jump, false)) AS n_jumps,
  COUNT(*) FILTER (WHERE jersey IS NULL) AS n_unresolved FROM {PERIODS} e LEFT JOIN {JUMPS} j ON e.event_id = j.event_id GROUP BY ALL""")
def game_ledger(spark, d):
    # Jumps and periods share one window's partitioning.
    e = od.color_run_periods(od.with_jumps(bridge(spark, d, "scoring_events")))
    return e.groupBy("document_id", "side", "period").agg(F.count(F.lit(1)).alias("n_events"), F.sum("points").alias("score"), F.count_if(F.coalesce("jump", F.lit(False))).alias("n_jumps"), F.count_if(F.col("jersey").isNull()).alias("n_unresolved"))


@query("wn1_plausible_sequence", f"""SELECT event_id, CAST(delta AS BIGINT) AS delta, CASE WHEN delta NOT BETWEEN 1 AND 3 OR (points > 0 AND points <> delta) THEN 'review' ELSE status END AS status,
  CASE WHEN delta NOT BETWEEN 1 AND 3 OR (points > 0 AND points <> delta) THEN LEAST(COALESCE(confidence, 0.0), CAST(0.69 AS DOUBLE)) ELSE confidence END AS confidence FROM {DELTA} t""")
def wn1(spark, d):
    return od.plausible_sequence(bridge(spark, d, "scoring_events")).select("event_id", "delta", "status", "confidence")


@query("wn2_color_run_period", f"SELECT event_id, CAST(period AS BIGINT) AS period FROM {PERIODS} p")
def wn2(spark, d):
    return periods(spark, d).select("event_id", "period")


@query("wn3_reconcile_delta", f"SELECT event_id, jump FROM {JUMPS} j")
def wn3(spark, d):
    return od.reconcile_delta(bridge(spark, d, "scoring_events")).select("event_id", "jump")


STATUS = f"""(SELECT e.*, r.jersey AS on_roster, j.jump FROM {PERIODS} e LEFT JOIN {JUMPS} j ON e.event_id = j.event_id
  LEFT JOIN {PL} r ON e.document_id = r.document_id AND e.side = r.side AND e.jersey = r.jersey)"""


@query("wn4_event_status", f"""SELECT event_id, CASE WHEN points <= 0 OR shot_type = 'ambiguous' THEN 'review' WHEN jersey IS NULL THEN 'unresolved' WHEN on_roster IS NULL THEN 'review'
  WHEN period IS NULL THEN 'unresolved' WHEN jump THEN 'review' ELSE status END AS final_status FROM {STATUS} s""")
def wn4(spark, d):
    return rec.event_status(periods(spark, d), bridge(spark, d, "players")).select("event_id", "final_status")


@query("wn6_stop_at_terminal", f"""SELECT document_id, side, jersey, slot, symbol FROM (SELECT *, MIN(CASE WHEN symbol = 'F' THEN slot END) OVER (PARTITION BY document_id, side, jersey) AS t FROM {FO} f) x WHERE t IS NULL OR slot < t""")
def wn6(spark, d):
    return od.stop_at_terminal(bridge(spark, d, "foul_cells")).select("document_id", "side", "jersey", "slot", "symbol")


@query("wn7_roster_dedup", f"""SELECT document_id, side, row_no, CASE WHEN jersey IS NULL OR f < row_no THEN 'unresolved' WHEN ok THEN 'accepted' ELSE 'review' END AS row_status FROM (
  SELECT *, MIN(CASE WHEN ok THEN row_no END) OVER (PARTITION BY document_id, side, jersey) AS f FROM (
  SELECT document_id, side, row_no, CASE WHEN row_no % 6 = 0 THEN NULL ELSE jersey % 7 END AS jersey, participated AS ok FROM {PL} p) x) y""")
def wn7(spark, d):
    rows = bridge(spark, d, "players").select("document_id", "side", "row_no", F.when(F.col("row_no") % 6 != 0, F.col("jersey") % 7).alias("jersey"), F.col("participated").alias("acceptable"))
    return od.roster_duplicates(rows).select("document_id", "side", "row_no", "row_status")


@query("wn8_runs", f"""SELECT cell, MIN(x) AS first_value, MAX(x) AS last_value, COUNT(*) AS n, CAST(round_even((MIN(x) + MAX(x)) / 2.0, 0) AS BIGINT) AS center FROM (SELECT cell, x, x - ROW_NUMBER() OVER (PARTITION BY cell ORDER BY x) AS i FROM (SELECT DISTINCT cell, x FROM {PX} p) a) b GROUP BY cell, i""")
def wn8(spark, d):
    return od.runs(bridge(spark, d, "pixels"), "x", ("cell",))


@query("wn9_gap_clusters", f"""SELECT cell, CAST(c AS BIGINT) AS cluster, COUNT(*) AS n, MIN(x) AS low, MAX(x) AS high, CAST(SUM(x) AS BIGINT) AS total, CAST(round_even(MEDIAN(x), 0) AS BIGINT) AS center FROM (
  SELECT cell, x, SUM(g) OVER (PARTITION BY cell ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (SELECT cell, x, CASE WHEN x - LAG(x) OVER (PARTITION BY cell ORDER BY x) > 4 THEN 1 ELSE 0 END AS g FROM {PX} p) a) b GROUP BY cell, c""")
def wn9(spark, d):
    return od.gap_clusters(bridge(spark, d, "pixels"), "x", 4, ("cell",))


@query("wn11_latest_annotation", "SELECT conv_id, arg_max(turn, turn) FILTER (WHERE turn % 3 <> 2) AS latest FROM conversations GROUP BY conv_id")
def wn11(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    t = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t.alias("turn"), (t % 3 == 2).alias("was_cancelled"))).alias("annotations"))
    return od.latest_annotation(t).select("conv_id", F.col("latest.turn").alias("latest"))


@query("wn12_local_maxima", f"""SELECT cell, pos, value FROM (SELECT *, MAX(value) OVER (PARTITION BY cell ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM (
  SELECT cell, x AS pos, CAST(COUNT(*) AS BIGINT) AS value FROM {PX} p GROUP BY cell, x) a) b WHERE value >= 1 AND value >= m""")
def wn12(spark, d):
    return od.local_maxima(bridge(spark, d, "pixels").groupBy("cell", F.col("x").alias("pos")).agg(F.count(F.lit(1)).alias("value")), 1, ("cell",))


@query("ag1_box_score", f"""SELECT p.document_id, p.side, p.jersey, CAST(COALESCE(SUM(e.points), 0) AS BIGINT) AS points, COUNT(*) FILTER (WHERE e.shot_type = 'free_throw') AS free_throws,
  COUNT(*) FILTER (WHERE e.shot_type = 'two_point') AS two_points, COUNT(*) FILTER (WHERE e.shot_type = 'three_point') AS three_points FROM {PL} p LEFT JOIN (SELECT * FROM {EV} b WHERE points > 0 AND shot_type <> 'ambiguous') e
  ON p.document_id = e.document_id AND p.side = e.side AND p.jersey = e.jersey GROUP BY p.document_id, p.side, p.jersey""")
def ag1(spark, d):
    return rec.box_score(bridge(spark, d, "scoring_events"), bridge(spark, d, "players"))


SCORES = f"(SELECT document_id, side, CAST(period AS BIGINT) AS period, CAST(SUM(points) AS BIGINT) AS score FROM {PERIODS} e WHERE period IS NOT NULL AND points > 0 AND shot_type <> 'ambiguous' GROUP BY document_id, side, period)"


@query("ag2_period_score", f"SELECT * FROM {SCORES} s")
def ag2(spark, d):
    return rec.period_scores(periods(spark, d))


@query("ag3_period_spine", f"""SELECT w.document_id, w.side, w.period, COALESCE(s.score, 0) AS score, w.value AS written, w.status, 'regular' AS kind FROM {WR} w
  LEFT JOIN {SCORES} s ON w.document_id = s.document_id AND w.side = s.side AND w.period = s.period""")
def ag3(spark, d):
    w = bridge(spark, d, "written_scores")
    return rec.period_spine(rec.period_scores(periods(spark, d)), w, w)


@query("ag4_calculated_score", f"SELECT document_id, side, CAST(COALESCE(SUM(CASE WHEN points > 0 THEN points END), 0) AS BIGINT) AS calculated FROM {EV} b GROUP BY document_id, side")
def ag4(spark, d):
    return rec.calculated_scores(bridge(spark, d, "scoring_events"))


FOULS = f"""(SELECT document_id, side, period, COUNT(*) AS fouls FROM (SELECT *, CASE WHEN ink_color = 'red' THEN CASE WHEN slot <= first_half_slots THEN 1 ELSE 3 END WHEN ink_color = 'blue' THEN CASE WHEN slot <= first_half_slots THEN 2 ELSE 4 END END AS period,
  UPPER(REPLACE(TRIM(symbol), ' ', '')) AS s FROM {FO} f) x WHERE period IS NOT NULL AND s IN ('P', 'P1', 'P2', 'P3', 'T', 'T1', 'U', 'U1', 'U2', 'U3', 'D', 'D2') GROUP BY document_id, side, period)"""


def fouls(spark, d):
    c = bridge(spark, d, "foul_cells")
    return c.withColumn("period", sc.period_of_foul(F.col("slot"), F.col("first_half_slots"), F.col("ink_color")))


@query("ag5_derived_fouls", f"SELECT document_id, side, CAST(period AS BIGINT) AS period, fouls FROM {FOULS} f")
def ag5(spark, d):
    return rec.derived_fouls(fouls(spark, d))


BOXES = f"""(SELECT document_id, side, period, COALESCE(MAX(CASE WHEN kind = 'x' THEN slot END), 0) AS x_count, COUNT(*) FILTER (WHERE kind = 'x') AS marked, MAX(CASE WHEN kind = 'ambiguous' THEN slot END) AS doubt, MIN(confidence) AS confidence
  FROM {TF} t GROUP BY document_id, side, period)"""


@query("ag6_team_foul_boxes", f"SELECT document_id, side, period, x_count, marked < x_count OR COALESCE(doubt > x_count, false) AS review, x_count = 4 AS capped, confidence FROM {BOXES} b")
def ag6(spark, d):
    return rec.team_foul_boxes(bridge(spark, d, "team_foul_cells"))


@query("jn4_foul_mismatch", f"""SELECT b.document_id, b.side, b.period, b.x_count, COALESCE(f.fouls, 0) AS fouls FROM {BOXES} b LEFT JOIN {FOULS} f ON b.document_id = f.document_id AND b.side = f.side AND b.period = f.period
  WHERE CASE WHEN b.x_count = 4 THEN COALESCE(f.fouls, 0) < 4 ELSE COALESCE(f.fouls, 0) <> b.x_count END""")
def jn4(spark, d):
    return rec.foul_mismatches(rec.team_foul_boxes(bridge(spark, d, "team_foul_cells")), rec.derived_fouls(fouls(spark, d)))


@query("ag8_status_lattice", f"SELECT document_id, side, CASE MAX(CASE status WHEN 'unresolved' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) WHEN 2 THEN 'unresolved' WHEN 1 THEN 'review' ELSE 'accepted' END AS status, COUNT(*) AS n FROM {WR} w GROUP BY document_id, side")
def ag8(spark, d):
    return rec.worst_status(bridge(spark, d, "written_scores"), od.SIDE)


@query("ag11_starters", f"SELECT document_id, side, COUNT(*) FILTER (WHERE starter) AS starters FROM {PL} p GROUP BY document_id, side HAVING COUNT(*) FILTER (WHERE starter) <> 5")
def ag11(spark, d):
    return rec.starters_warnings(bridge(spark, d, "players"))


@query("wn6_terminals", f"SELECT document_id, side, jersey, slot, ink_color FROM (SELECT *, MIN(CASE WHEN symbol = 'F' THEN slot END) OVER (PARTITION BY document_id, side, jersey) AS t FROM {FO} f) x WHERE slot = t")
def wn6t(spark, d):
    return od.terminals(bridge(spark, d, "foul_cells")).select("document_id", "side", "jersey", "slot", "ink_color")


@query("jn1_assigned_fouls", f"SELECT f.document_id, f.side, f.jersey, f.slot, p.row_no FROM {FO} f JOIN (SELECT * FROM {PL} q WHERE (document_id + row_no) % 5 <> 0) p ON f.document_id = p.document_id AND f.side = p.side AND f.jersey = p.jersey")
def jn1(spark, d):
    return rec.assigned_fouls(bridge(spark, d, "players").filter("(document_id + row_no) % 5 <> 0"), bridge(spark, d, "foul_cells")).select("document_id", "side", "jersey", "slot", "row_no")


WARNED = f"""SELECT event_id, CASE WHEN points <= 0 OR shot_type = 'ambiguous' THEN 'Score ' || running_score || ': ambiguous shot type' ELSE concat_ws(';', CASE WHEN jump THEN 'Score ' || running_score || ': jump of ' || delta || ' is incompatible with a ' || points || '-point event' END,
  CASE WHEN period IS NULL THEN 'Score ' || running_score || ': period is unresolved' END, CASE WHEN jersey IS NULL THEN 'Score ' || running_score || ': jersey is unresolved' WHEN on_roster IS NULL THEN 'Score ' || running_score || ': jersey ' || jersey || ' is not in the supplied roster' END) END AS said
  FROM (SELECT e.*, r.jersey AS on_roster, j.jump, j.delta FROM {PERIODS} e LEFT JOIN (SELECT event_id, points <> running_score - COALESCE(LAG(running_score) OVER ({BY}), 0) AS jump, running_score - COALESCE(LAG(running_score) OVER ({BY}), 0) AS delta FROM {EV} b WHERE points > 0 AND shot_type <> 'ambiguous') j
  ON e.event_id = j.event_id LEFT JOIN {PL} r ON e.document_id = r.document_id AND e.side = r.side AND e.jersey = r.jersey) s"""


def statused(spark, d) -> DataFrame:
    return rec.event_status(periods(spark, d), bridge(spark, d, "players"))


@query("wn4_warnings", WARNED)
def wn4w(spark, d):
    return statused(spark, d).select("event_id", F.array_join("warnings", ";").alias("said"))


FINALS = "SELECT DISTINCT document_id, side, CASE WHEN document_id % 4 = 0 THEN NULL ELSE document_id % 50 END AS written_final FROM {written} w"


def finals(spark, d) -> DataFrame:
    return spark.sql(FINALS, written=bridge(spark, d, "written_scores"))


def scored_players(spark, d) -> DataFrame:
    p = bridge(spark, d, "players")
    return p.join(rec.box_score(bridge(spark, d, "scoring_events"), p).select("document_id", "side", "jersey", "points"), ["document_id", "side", "jersey"])


def validated(spark, d) -> DataFrame:
    w = bridge(spark, d, "written_scores")
    spine = rec.period_spine(rec.period_scores(periods(spark, d)), w, w)
    return rec.validation_warnings(finals(spark, d), scored_players(spark, d), bridge(spark, d, "foul_cells"), bridge(spark, d, "scoring_events"), spine)


AG1, AG3, AG4 = (ORACLE_SQL[k] for k in ("ag1_box_score", "ag3_period_spine", "ag4_calculated_score"))
VALIDATED = f"""(SELECT document_id, side, 1 AS rule, 0 AS place, 'Detected ' || COUNT(*) FILTER (WHERE starter) || ' starters; expected 5' AS text FROM {PL} p GROUP BY document_id, side HAVING COUNT(*) FILTER (WHERE starter) <> 5
  UNION ALL SELECT document_id, side, 2, row_no * 2, 'Jersey ' || jersey || ': starter without participation' FROM {PL} p WHERE starter AND NOT participated
  UNION ALL SELECT p.document_id, p.side, 2, p.row_no * 2 + 1, 'Jersey ' || p.jersey || ': has a game event without a participation mark' FROM {PL} p JOIN ({AG1}) a USING (document_id, side, jersey)
    WHERE NOT participated AND (a.points > 0 OR EXISTS (SELECT 1 FROM {FO} f WHERE f.document_id = p.document_id AND f.side = p.side AND f.jersey = p.jersey))
  UNION ALL SELECT document_id, side, 4, 0, 'Calculated score (' || c.calculated || ') differs from written score (' || w.written_final || ')' FROM ({AG4}) c JOIN ({FINALS.format(written=WR)}) w USING (document_id, side) WHERE c.calculated <> w.written_final
  UNION ALL SELECT document_id, side, 5, period, 'Q' || period || ': calculated period score (' || score || ') differs from written score (' || written || ')' FROM ({AG3}) s WHERE score <> written)"""


@query("ag11_validation", f"SELECT document_id, side, rule, CAST(place AS BIGINT) AS place, text FROM {VALIDATED} v")
def ag11v(spark, d):
    return validated(spark, d).select("document_id", "side", "ord.rule", "ord.place", "text")


SIDE_WARNINGS = f"""(SELECT document_id, side, string_agg(said, ';' ORDER BY a, b, c) AS warnings FROM (SELECT e.document_id, e.side, 0 AS a, e.running_score AS b, e.seq AS c, w.said FROM {EV} e JOIN ({WARNED}) w ON e.event_id = w.event_id WHERE said <> ''
  UNION ALL SELECT document_id, side, 1, period, 0, 'Q' || period || ': derived team fouls (' || fouls || ') differ from the X boxes (' || x_count || ')' FROM ({ORACLE_SQL["jn4_foul_mismatch"]}) m
  UNION ALL SELECT document_id, side, 2, rule, place, text FROM {VALIDATED} v) u GROUP BY document_id, side)"""


def warnings_of_sides(spark, d) -> DataFrame:
    return rec.side_warnings(statused(spark, d), jn4(spark, d), validated(spark, d))


@query("st8_side_warnings", f"SELECT * FROM {SIDE_WARNINGS} s")
def st8(spark, d):
    return warnings_of_sides(spark, d).withColumn("warnings", F.array_join("warnings", ";"))


@query("sc8_foul_symbol", f"""SELECT document_id, side, jersey, slot, CASE WHEN s = 'F' THEN 'unknown' WHEN s LIKE 'P%' THEN 'personal' WHEN s LIKE 'T%' THEN 'technical' WHEN s LIKE 'U%' THEN 'unsportsmanlike' ELSE 'disqualifying' END AS kind,
  CASE WHEN s LIKE '%1' THEN 1 WHEN s LIKE '%2' THEN 2 WHEN s LIKE '%3' THEN 3 END AS free_throws, s IN ('PC', 'TC', 'UC', 'DC') AS cancelled, s = 'GD' AS fighting, s NOT IN ('F', 'PC', 'TC', 'UC', 'DC', 'GD') AS counts
  FROM (SELECT *, UPPER(REPLACE(TRIM(symbol), ' ', '')) AS s FROM {FO} f) x""")
def sc8(spark, d):
    return bridge(spark, d, "foul_cells").select("document_id", "side", "jersey", "slot", sc.foul_symbol(F.col("symbol")).alias("f")).select("document_id", "side", "jersey", "slot", "f.*")


ACC = "predicted IS NOT NULL AND confidence >= 0.5"
MET = f"""COUNT(*) AS total, COUNT(*) FILTER (WHERE {ACC}) AS accepted, COUNT(*) FILTER (WHERE {ACC} AND predicted <> expected) AS errors, COUNT(*) FILTER (WHERE {ACC}) / COUNT(*) AS automation,
  CASE WHEN COUNT(*) FILTER (WHERE {ACC}) > 0 THEN COUNT(*) FILTER (WHERE {ACC} AND predicted <> expected) / COUNT(*) FILTER (WHERE {ACC}) ELSE 0.0 END AS error_rate, COUNT(*) FILTER (WHERE COALESCE(predicted = expected, false)) / COUNT(*) AS accuracy"""


@query("ag12_metrics", f"SELECT field_type, {MET} FROM {PR} p GROUP BY field_type")
def ag12(spark, d):
    return ev.metrics(bridge(spark, d, "predictions"), 0.5, "field_type").drop("reviewed", "review_rate")


SWEEP = f"""(SELECT field_type, threshold, CAST(SUM(a) OVER w AS BIGINT) AS accepted, CAST(SUM(e) OVER w AS BIGINT) AS errors, CAST(SUM(t) OVER (PARTITION BY field_type) AS BIGINT) AS total FROM (
  SELECT field_type, threshold, SUM(a) AS a, SUM(e) AS e, SUM(t) AS t FROM (SELECT field_type, confidence AS threshold, COUNT(predicted) AS a, COUNT(*) FILTER (WHERE predicted <> expected) AS e, COUNT(*) AS t FROM {PR} p GROUP BY 1, 2
  UNION ALL SELECT DISTINCT field_type, CAST(z AS DOUBLE), 0, 0, 0 FROM {PR} p CROSS JOIN (SELECT 0 AS z UNION ALL SELECT 1) y) u GROUP BY 1, 2) g WINDOW w AS (PARTITION BY field_type ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("ag13_sweep", f"SELECT * FROM {SWEEP} s")
def ag13(spark, d):
    return ev.sweep(bridge(spark, d, "predictions"), "field_type")


@query("ag13_choice", f"""SELECT k.field_type, b.threshold IS NOT NULL AS found, COALESCE(b.threshold, CAST(1.0000000000000002 AS DOUBLE)) AS threshold FROM (SELECT DISTINCT field_type FROM {SWEEP} s) k LEFT JOIN (
  SELECT field_type, threshold, ROW_NUMBER() OVER (PARTITION BY field_type ORDER BY accepted / total DESC, CASE WHEN accepted > 0 THEN errors / accepted ELSE 0 END, threshold) AS r FROM {SWEEP} s
  WHERE accepted / total >= 0.1 AND CASE WHEN accepted > 0 THEN errors / accepted ELSE 0 END <= 0.3) b ON k.field_type = b.field_type AND b.r = 1""")
def ag13c(spark, d):
    return ev.chosen_threshold(ev.sweep(bridge(spark, d, "predictions"), "field_type"), 0.3, 0.1, "field_type")


CHOICE = ORACLE_SQL["ag13_choice"]
OWN = MET.replace("confidence >= 0.5", "confidence >= threshold")


@query("ag14_sliced", f"SELECT 'field_type' AS slice, p.field_type AS value, {OWN} FROM {PR} p JOIN ({CHOICE}) c ON p.field_type = c.field_type GROUP BY 2 UNION ALL " + " UNION ALL ".join(
    f"SELECT '{n}' AS slice, {v} AS value, {MET} FROM {PR} p GROUP BY 2" for n, v in (("all", "'*'"), ("capture", "capture"), ("writer_known", "CASE WHEN writer_known THEN 'yes' ELSE 'no' END"), ("writer_seen", "CASE WHEN writer_seen THEN 'yes' ELSE 'no' END"))))
def ag14(spark, d):
    p = bridge(spark, d, "predictions")
    return ev.sliced(p, 0.5, ev.chosen_threshold(ev.sweep(p, "field_type"), 0.3, 0.1, "field_type"))


@query("ag16_by_writer", f"SELECT CASE WHEN writer_known THEN 'known_writer' ELSE 'unknown_writer' END AS writer, {MET} FROM {PR} p GROUP BY 1")
def ag16(spark, d):
    return ev.by_writer(bridge(spark, d, "predictions"), 0.5).drop("reviewed", "review_rate")


@query("ag15_states", f"SELECT capture, COUNT(*) FILTER (WHERE {ACC}) AS accepted, COUNT(*) FILTER (WHERE predicted IS NOT NULL AND confidence < 0.5) AS review, COUNT(*) FILTER (WHERE predicted IS NULL) AS unresolved, COUNT(predicted) / COUNT(*) AS coverage FROM {PR} p GROUP BY capture")
def ag15(spark, d):
    return ev.decision_states(bridge(spark, d, "predictions"), 0.5, "capture")


@query("jn6_align_scoring", f"""SELECT t.document_id, t.side, t.running_score, e.points AS predicted, COALESCE(e.confidence, 0) AS confidence FROM (SELECT DISTINCT document_id, side, running_score + event_id % 2 AS running_score FROM {EV} b) t LEFT JOIN (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, side, running_score ORDER BY seq DESC) AS r FROM {EV} b) e ON t.document_id = e.document_id AND t.side = e.side AND t.running_score = e.running_score AND e.r = 1""")
def jn6(spark, d):
    e = bridge(spark, d, "scoring_events")
    truth = e.select("document_id", "side", (F.col("running_score") + F.col("event_id") % 2).alias("running_score")).distinct()
    return ev.aligned(truth, e.withColumn("value", F.col("points")), ("document_id", "side", "running_score"))


# Labels of the alignment queries: what was read, with every third or so changed or left out; SQL that Spark and DuckDB read alike.
TRUTH = {
    "roster": "SELECT document_id, side, row_no, jersey + CASE WHEN (document_id + row_no) % 5 = 0 THEN 1 ELSE 0 END AS jersey FROM {players} b WHERE row_no <= 10",
    "scoring": "SELECT document_id, side, running_score + document_id % 2 AS running_score, MAX(points) AS points, MAX(CASE WHEN ink_color = 'red' THEN 'Q1' ELSE 'Q2' END) AS period, CASE WHEN running_score % 4 = 0 THEN NULL ELSE MAX(jersey) END AS jersey FROM {scoring_events} b GROUP BY document_id, side, running_score",
    "periods": "SELECT document_id, side, period, COALESCE(value, 0) + document_id % 3 AS score FROM {written_scores} b",
    "finals": "SELECT DISTINCT document_id, side, document_id % 40 AS score FROM {written_scores} b",
    "team_fouls": "SELECT document_id, side, period, COUNT(*) AS fouls FROM {team_foul_cells} b WHERE kind = 'x' GROUP BY document_id, side, period",
    "fouls": "SELECT document_id, side, jersey, slot, CASE WHEN ink_color = 'red' THEN 'Q1' ELSE 'Q4' END AS period, CASE WHEN slot = 2 THEN 'P' ELSE symbol END AS symbol FROM {foul_cells} b",
}
READ = {
    "roster": "SELECT document_id, side, row_no, CASE WHEN row_no % 6 = 0 THEN NULL ELSE jersey END AS jersey, 0.5 + row_no / 100.0 AS confidence FROM {players} b WHERE row_no <> 3",
    "periods": "SELECT document_id, side, period, value AS score, CASE WHEN period = 2 THEN NULL ELSE value END AS candidate, 1.5 - period / 4.0 AS confidence FROM {written_scores} b WHERE period <> 4",
    "finals": "SELECT DISTINCT document_id, side, document_id % 40 AS candidate, CAST(0.25 AS DOUBLE) AS confidence FROM {written_scores} b WHERE side = 'A'",
    "fouls": "SELECT document_id, side, jersey, slot, symbol, CASE WHEN ink_color = 'unknown' THEN NULL ELSE 4 END AS period, CAST(0.75 AS DOUBLE) AS confidence FROM {foul_cells} b WHERE slot <> 4",
}
_OBS = ("scoring_events", "players", "written_scores", "team_foul_cells", "foul_cells")


def labels_of(spark, d, tables: dict[str, str], name: str) -> DataFrame:
    return spark.sql(tables[name], **{n: bridge(spark, d, n) for n in _OBS if "{" + n + "}" in tables[name]})


def _labels_sql(tables: dict[str, str], name: str) -> str:
    return "(" + tables[name].format(**{n: bridge_sql(n) for n in _OBS}) + ")"


def _rows_sql(frm: str, *fields: tuple[str, str, str, str, str], keep: str = "true") -> str:
    """SQL of prediction rows: for each field an id, a type, what is expected and read, and a confidence."""
    return " UNION ALL ".join(f"SELECT t.document_id, {i} AS field_id, '{k}' AS field_type, CAST({e} AS VARCHAR) AS expected, CAST({p} AS VARCHAR) AS predicted, GREATEST(0, LEAST(1, COALESCE(CAST({c} AS DOUBLE), 0))) AS confidence FROM {frm}" + (f" WHERE {keep}" if k == "scoring_jersey" else "") for i, k, e, p, c in fields)


@query("jn7_roster_fields", _rows_sql(f"{_labels_sql(TRUTH, 'roster')} t LEFT JOIN {_labels_sql(READ, 'roster')} r USING (document_id, side, row_no)", ("'roster:' || side || ':' || row_no", "roster_jersey", "t.jersey", "r.jersey", "r.confidence")))
def jn7(spark, d):
    return al.roster_fields(labels_of(spark, d, TRUTH, "roster"), labels_of(spark, d, READ, "roster"))


_SCORED = f"{_labels_sql(TRUTH, 'scoring')} t LEFT JOIN (SELECT * FROM (SELECT p.*, e.confidence, ROW_NUMBER() OVER (PARTITION BY p.document_id, p.side, p.running_score ORDER BY p.seq DESC) AS rn FROM {PERIODS} p JOIN {EV} e ON p.event_id = e.event_id) x WHERE rn = 1) r USING (document_id, side, running_score)"


@query("jn6_scoring_fields", _rows_sql(
    _SCORED, ("'scoring:' || side || ':' || running_score || ':points'", "scoring_points", "t.points", "r.points", "r.confidence"), ("'scoring:' || side || ':' || running_score || ':period'", "scoring_period", "t.period", "'Q' || r.period", "r.confidence"),
    ("'scoring:' || side || ':' || running_score || ':jersey'", "scoring_jersey", "t.jersey", "r.jersey", "r.confidence / 2"), keep="t.jersey IS NOT NULL"))
def jn6f(spark, d):
    return al.scoring_fields(labels_of(spark, d, TRUTH, "scoring"), periods(spark, d).withColumn("jersey_confidence", F.col("confidence") / 2))


@query("jn8_period_fields", _rows_sql(
    f"{_labels_sql(TRUTH, 'periods')} t LEFT JOIN {_labels_sql(READ, 'periods')} r USING (document_id, side, period)", ("'period_score:' || side || ':Q' || period", "period_score", "t.score", "r.score", "r.confidence"),
    ("'written_period_score:' || side || ':Q' || period", "written_period_score", "t.score", "r.candidate", "r.confidence")))
def jn8(spark, d):
    return al.period_fields(labels_of(spark, d, TRUTH, "periods"), labels_of(spark, d, READ, "periods"))


@query("jn8_final_fields", _rows_sql(
    f"{_labels_sql(TRUTH, 'finals')} t LEFT JOIN (SELECT document_id, side, SUM(CASE WHEN points > 0 THEN points ELSE 0 END) AS calculated, MIN(COALESCE(confidence, 0)) AS least FROM {EV} b GROUP BY 1, 2) e USING (document_id, side) LEFT JOIN {_labels_sql(READ, 'finals')} r USING (document_id, side)",
    ("'final_score:' || side", "final_score", "t.score", "CAST(COALESCE(e.calculated, 0) AS BIGINT)", "e.least"), ("'written_final_score:' || side", "written_final_score", "t.score", "r.candidate", "r.confidence")))
def jn8f(spark, d):
    return al.final_fields(labels_of(spark, d, TRUTH, "finals"), bridge(spark, d, "scoring_events"), labels_of(spark, d, READ, "finals"))


@query("jn9_team_foul_fields", _rows_sql(f"{_labels_sql(TRUTH, 'team_fouls')} t LEFT JOIN {BOXES} r USING (document_id, side, period)", ("'team_fouls:' || side || ':Q' || period", "team_fouls", "t.fouls", "r.x_count", "r.confidence")))
def jn9(spark, d):
    return al.team_foul_fields(labels_of(spark, d, TRUTH, "team_fouls"), rec.team_foul_boxes(bridge(spark, d, "team_foul_cells")))


@query("jn10_foul_fields", _rows_sql(
    f"{_labels_sql(TRUTH, 'fouls')} t LEFT JOIN {_labels_sql(READ, 'fouls')} r USING (document_id, side, jersey, slot)", ("'individual_foul:' || side || ':' || jersey || ':' || slot || ':symbol'", "individual_foul_symbol", "t.symbol", "r.symbol", "r.confidence"),
    ("'individual_foul:' || side || ':' || jersey || ':' || slot || ':period'", "individual_foul_period", "t.period", "'Q' || r.period", "r.confidence")))
def jn10(spark, d):
    return al.foul_fields(labels_of(spark, d, TRUTH, "fouls"), labels_of(spark, d, READ, "fouls"))


CROPS_SQL = "SELECT event_id AS crop_id, document_id, side, CASE WHEN event_id % 2 = 0 THEN 'scoring_event' WHEN event_id % 3 = 0 THEN 'foul_terminal' ELSE 'foul_event' END AS field_type, running_score, jersey, 1 + event_id % 5 AS slot FROM {scoring_events} b"


@query("jn21_crop_labels", f"SELECT c.crop_id, CASE WHEN c.field_type = 'scoring_event' THEN CAST(s.jersey AS VARCHAR) WHEN c.field_type = 'foul_event' THEN f.symbol END AS label FROM ({CROPS_SQL.format(scoring_events=EV)}) c LEFT JOIN {_labels_sql(TRUTH, 'scoring')} s USING (document_id, side, running_score) LEFT JOIN {_labels_sql(TRUTH, 'fouls')} f ON c.document_id = f.document_id AND c.side = f.side AND c.jersey = f.jersey AND c.slot = f.slot")
def jn21(spark, d):
    crops = spark.sql(CROPS_SQL, scoring_events=bridge(spark, d, "scoring_events"))
    return al.labelled_crops(crops, labels_of(spark, d, TRUTH, "scoring"), labels_of(spark, d, TRUTH, "fouls")).select("crop_id", "label")


# A review of crops: boxes in percent of a page of 100 by 50, some moved, some labels changed, some refused or undecided, older annotations cancelled or overruled.
REVIEWED_SQL = """SELECT doc_id AS crop_id, doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN 'jersey' WHEN 2 THEN 'scoring_event' ELSE 'foul_event' END AS field_type, CASE WHEN doc_id % 4 IN (0, 2) THEN '12' ELSE 'Pc' END AS label, 'T' AS predicted_label, doc_id % 10 <> 8 AS model_trainable,
  CONCAT('s', CAST(doc_id AS VARCHAR(20))) AS sheet, CONCAT('c', CAST(doc_id AS VARCHAR(20))) AS crop_hash FROM {documents} b"""


def review_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, manifest and catalogue of the jerseys stage."""
    c = spark.sql(REVIEWED_SQL, documents=spark.read.parquet(f"{d}/documents.parquet"))
    asked = c.filter("field_type <> 'foul_event'")
    k = F.col("crop_id")
    width = F.when(k % 7 == 0, 30.0).otherwise(50.0)
    chosen = F.when(k % 12 == 0, F.array().cast("array<string>")).when(k % 9 == 0, F.array(F.lit("illegible"))).otherwise(F.array(F.lit("accepted")))
    result = lambda kind, name, **value: F.struct(F.lit("b").alias("id"), F.lit(kind).alias("type"), F.lit(name).alias("from_name"), F.lit("image").alias("to_name"), F.struct(*[
        value.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("x", "double"), ("y", "double"), ("width", "double"), ("height", "double"), ("rotation", "double"), ("rectanglelabels", "array<string>"), ("choices", "array<string>"), ("text", "array<string>"))]).alias("value"))
    results = F.array(
        result("rectanglelabels", "bbox", x=F.lit(10.0), y=F.lit(20.0), width=width, height=F.lit(40.0), rectanglelabels=F.array(F.lit("candidate"))), result("choices", "decision", choices=chosen),
        result("textarea", "final_label", text=F.array(F.when(k % 4 == 0, " 7 ").otherwise("12"))))
    annotation = lambda cancelled, r: F.struct(cancelled.alias("was_cancelled"), r.alias("result"))
    # The second annotation is void for some crops: then the first, without a box, is not to be read either.
    first = annotation(F.lit(True), F.slice(results, 1, 1))
    data = F.struct(F.lit(None).cast("string").alias("image"), k.cast("string").alias("crop_id"), F.lit(None).cast("string").alias("document_id"), F.col("sheet").alias("source_image_hash"), F.col("crop_hash").alias("crop_image_hash"), F.lit(100).alias("image_width"), F.lit(50).alias("image_height"))
    tasks = asked.select(data.alias("data"), F.lit(None).cast("string").alias("file_upload"), F.array(first, annotation(k % 10 == 4, results)).alias("annotations"))
    box = F.array(F.lit(10), F.lit(10), F.lit(60), F.lit(30))
    manifest = c.select(F.col("crop_id").cast("string").alias("crop_id"), "document_id", "field_type", "label", "predicted_label", "model_trainable", F.col("sheet").alias("source_image_hash"), F.col("crop_hash").alias("crop_image_hash"), box.alias("bbox_original"), F.lit("unlabeled").alias("status"))
    return tasks, manifest, c.select("document_id", F.col("sheet").alias("sha256"))


DECIDED_SQL = f"""(SELECT *, CASE WHEN decision = 'accepted' AND (crop_id % 7 = 0 OR final <> label) THEN 'adjusted' ELSE decision END AS review_state FROM (SELECT *, CASE WHEN decision = 'accepted' THEN CASE WHEN model_trainable THEN CASE WHEN crop_id % 4 = 0 THEN '7' ELSE '12' END ELSE 'T' END END AS final
  FROM (SELECT *, CASE WHEN crop_id % 9 = 0 THEN 'illegible' ELSE 'accepted' END AS decision FROM ({REVIEWED_SQL.format(documents="documents")}) r WHERE field_type <> 'foul_event' AND crop_id % 10 <> 4 AND crop_id % 12 <> 0) x) y)"""


@query("jn13_imported_crops", f"SELECT CAST(crop_id AS VARCHAR) AS crop_id, CASE WHEN crop_id % 7 = 0 THEN '10,10,40,30' ELSE '10,10,60,30' END AS bbox_revised, label AS label_original, final AS label_final, review_state, CASE WHEN final IS NULL THEN 'excluded' ELSE 'labeled' END AS status FROM {DECIDED_SQL} z")
def jn13(spark, d):
    return an.imported_crops(*review_tables(spark, d), "jerseys").drop("bbox_original").withColumn("bbox_revised", F.array_join("bbox_revised", ","))


@query("st5_reviewed_manifest", f"""SELECT CAST(m.crop_id AS VARCHAR) AS crop_id, COALESCE(z.review_state, 'pending') AS review_state, CASE WHEN z.crop_id IS NULL THEN m.label ELSE z.final END AS label, COALESCE(r <= CEIL(n / 10), false) AS audit_required, CASE WHEN r <= CEIL(n / 10) THEN 'pending' END AS audit_state
  FROM ({REVIEWED_SQL.format(documents="documents")}) m LEFT JOIN {DECIDED_SQL} z ON m.crop_id = z.crop_id LEFT JOIN (SELECT crop_id, ROW_NUMBER() OVER (PARTITION BY field_type ORDER BY sha1(CAST(crop_id AS VARCHAR))) AS r, COUNT(*) OVER (PARTITION BY field_type) AS n FROM {DECIDED_SQL} q WHERE model_trainable AND final IS NOT NULL) s ON m.crop_id = s.crop_id""")
def st5m(spark, d):
    tasks, manifest, catalog = review_tables(spark, d)
    return an.reviewed_manifest(manifest, an.imported_crops(tasks, manifest, catalog, "jerseys"), None, "jerseys").select("crop_id", "review_state", "label", "audit_required", "audit_state")


# DuckDB has no 64-bit unsigned conversion of hex text but by a cast with 0x.
SPLIT = "CASE WHEN b < 0.7 THEN 'train' WHEN b < 0.85 THEN 'validation' ELSE 'test' END"


@query("sc5_split", f"SELECT o_orderkey, {SPLIT} AS split FROM (SELECT o_orderkey, CAST(CAST(CONCAT('0x', SUBSTR(sha256(CONCAT('s1:', CAST(o_orderkey AS VARCHAR))), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS b FROM orders) x")
def sc5(spark, d):
    return gv.with_split(spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey").cast("string"), "s1").select("o_orderkey", "split")


@query("ag21_leakage", f"SELECT writer, string_agg(split, ',' ORDER BY split) AS splits, COUNT(*) AS n FROM (SELECT DISTINCT writer, {SPLIT} AS split FROM (SELECT writer, CAST(CAST(CONCAT('0x', SUBSTR(sha256(CONCAT('s1:', CAST(document_id AS VARCHAR))), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS b FROM {CA} c) x) y GROUP BY writer HAVING COUNT(*) > 1")
def ag21(spark, d):
    return gv.leakage(gv.with_split(bridge(spark, d, "catalog"), F.col("document_id").cast("string"), "s1"), "writer")


@query("tk1_pilots", f"""SELECT category, document_id, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY CASE WHEN status = 'ready' THEN 0 ELSE 1 END, CASE WHEN extension IN ('jpg', 'jpeg') AND category = (SELECT MIN(category) FROM {CA} c WHERE status <> 'unreadable' AND extension IN ('jpg', 'jpeg')) THEN 0 ELSE 1 END, document_id) AS r
  FROM {CA} c WHERE status <> 'unreadable') x WHERE r = 1 ORDER BY category LIMIT 5""")
def tk1(spark, d):
    return gv.pilots(bridge(spark, d, "catalog"), 5)


TRAINABLE = "COALESCE(model_trainable, true) AND review_state IN ('accepted', 'adjusted') AND label IS NOT NULL"


@query("tk2_audit_sample", f"SELECT field_type, crop_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY field_type ORDER BY sha1(CAST(crop_id AS VARCHAR))) AS r, COUNT(*) OVER (PARTITION BY field_type) AS n FROM {RV} v WHERE {TRAINABLE}) x WHERE r <= CEIL(n / 10)")
def tk2(spark, d):
    return gv.audit_sample(bridge(spark, d, "reviews"))


@query("jn14_stale", f"SELECT r.crop_id FROM {RC} r JOIN {AC} a ON a.crop_id = r.crop_id WHERE r.source_image_hash <> a.source_image_hash OR r.crop_image_hash <> a.crop_image_hash")
def jn14(spark, d):
    a = bridge(spark, d, "automatic_crops").select("crop_id", "source_image_hash", "crop_image_hash")
    r = bridge(spark, d, "reviewed_crops").select("crop_id", F.col("source_image_hash").alias("reviewed_hash"), F.col("crop_image_hash").alias("reviewed_crop_hash"))
    return gv.stale(a.join(r, "crop_id"), (("source_image_hash", "reviewed_hash"), ("crop_image_hash", "reviewed_crop_hash"))).select("crop_id")


SAMPLE = ORACLE_SQL["tk2_audit_sample"]


@query("tk2_audit_states", f"""SELECT v.crop_id, s.crop_id IS NOT NULL AS audit_required, CASE WHEN s.crop_id IS NOT NULL THEN CASE WHEN v.crop_id % 2 = 0 THEN 'passed' ELSE 'pending' END END AS audit_state FROM {RV} v LEFT JOIN ({SAMPLE}) s ON v.crop_id = s.crop_id""")
def tk2a(spark, d):
    v = bridge(spark, d, "reviews").withColumn("audit_required", F.col("crop_id") % 2 == 0).withColumn("audit_state", F.lit("passed"))
    return gv.audited(v, ("de", "en", "es", "fr")).select("crop_id", "audit_required", "audit_state")


@query("st5_upsert", f"SELECT crop_id, field_type, CASE WHEN crop_id % 3 = 0 THEN review_state ELSE 'pending' END AS review_state, CASE WHEN crop_id % 3 = 0 THEN NULL ELSE label END AS label FROM {RV} v")
def st5(spark, d):
    base = bridge(spark, d, "reviews").select("crop_id", "field_type", "review_state", "label")
    return gv.merged_reviews(base, base.filter("crop_id % 3 = 0").select("crop_id", "review_state", F.lit(None).cast("string").alias("label")))


CROP = f"""(SELECT a.crop_id, a.field_type, CASE WHEN a.field_type IN ('jersey', 'scoring_event') THEN 'jerseys' ELSE 'fouls' END AS stage, old, CASE WHEN old THEN 'stale' ELSE COALESCE(r.review_state, 'pending') END AS state,
  r.crop_id IS NOT NULL AND NOT old AND COALESCE(r.model_trainable, true) AND r.review_state IN ('accepted', 'adjusted') AND r.label IS NOT NULL AS valid, r.audit_required, r.audit_state
  FROM (SELECT a.*, COALESCE(r.source_image_hash <> a.source_image_hash, false) OR COALESCE(r.crop_image_hash <> a.crop_image_hash, false) AS old FROM {AC} a LEFT JOIN {RC} r ON a.crop_id = r.crop_id) a LEFT JOIN {RC} r ON a.crop_id = r.crop_id WHERE a.field_type <> 'other')"""
PROGRESS = f"""(SELECT *, CASE WHEN decided > 0 THEN geometrically_correct / decided ELSE 0.0 END AS geometric_correct_rate, decided / candidates AS completion, audit_required - audit_completed AS audit_pending FROM (SELECT stage, COUNT(*) AS candidates, COUNT(*) FILTER (WHERE state NOT IN ('pending', 'stale')) AS decided,
  COUNT(*) FILTER (WHERE state = 'pending') AS pending, COUNT(*) FILTER (WHERE state = 'stale') AS stale, COUNT(*) FILTER (WHERE valid) AS trainable, COUNT(*) FILTER (WHERE valid AND audit_required) AS audit_required, COUNT(*) FILTER (WHERE valid AND audit_required AND audit_state IN ('passed', 'corrected')) AS audit_completed,
  COUNT(*) FILTER (WHERE state IN ('accepted', 'adjusted', 'erasure', 'illegible')) AS geometrically_correct FROM {CROP} c GROUP BY stage) x)"""


@query("ag24_review_progress", f"SELECT *, decided = candidates AND stale = 0 AND geometric_correct_rate >= 0.98 AS geometric_quality_met, pending = 0 AND stale = 0 AND trainable > 0 AND audit_pending = 0 AND decided = candidates AND geometric_correct_rate >= 0.98 AS ready FROM {PROGRESS} p")
def ag24(spark, d):
    return gv.review_progress(bridge(spark, d, "automatic_crops"), bridge(spark, d, "reviewed_crops"))


@query("ag24_states", f"SELECT stage, state, COUNT(*) AS n FROM {CROP} c GROUP BY 1, 2")
def ag24s(spark, d):
    return gv.crop_states(bridge(spark, d, "automatic_crops"), bridge(spark, d, "reviewed_crops")).groupBy("stage", "state").agg(F.count(F.lit(1)).alias("n"))


FIT = f"(SELECT r.crop_id FROM {RC} r JOIN {AC} a ON r.crop_id = a.crop_id WHERE COALESCE(a.model_trainable, true) AND r.review_state IN ('accepted', 'adjusted') AND r.label IS NOT NULL AND r.source_image_hash IS NOT DISTINCT FROM a.source_image_hash AND r.crop_image_hash IS NOT DISTINCT FROM a.crop_image_hash)"


@query("jn15_reviewed_trainable", f"SELECT crop_id FROM {FIT} f")
def jn15(spark, d):
    return gv.reviewed_trainable(bridge(spark, d, "automatic_crops"), bridge(spark, d, "reviewed_crops"))


@query("ag23_crop_summary", f"SELECT *, crops - labeled AS unlabeled FROM (SELECT (SELECT COUNT(*) FROM {AC} a) AS crops, (SELECT COUNT(*) FROM (SELECT crop_id FROM {AC} a WHERE status = 'labeled' UNION SELECT crop_id FROM {FIT} f) u) AS labeled, (SELECT COUNT(*) FROM {AC} a WHERE status = 'labeled') AS automatic_labeled, (SELECT COUNT(*) FROM {FIT} f) AS reviewed_labeled) x")
def ag23(spark, d):
    return gv.crop_summary(bridge(spark, d, "automatic_crops"), bridge(spark, d, "reviewed_crops"))


REG = "SELECT doc_id AS document_id, CONCAT('r', CAST(doc_id % 12 AS VARCHAR(20))) AS region, CASE WHEN doc_id % 4 = 0 THEN 'unusable' ELSE 'usable' END AS state, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 END AS boxed FROM {documents} b WHERE doc_id % 2 = 0"
REGIONS = tuple(f"r{k}" for k in range(10))


@query("ag25_geometry", f"""SELECT *, documents * 10 AS expected_regions, GREATEST(0, documents * 10 - reviewed_regions) AS pending_regions, reviewed_regions / (documents * 10) AS completion FROM (SELECT COUNT(*) AS documents, COUNT(*) FILTER (WHERE document_id % 2 = 0 AND document_id % 12 < 10) AS reviewed_regions,
  COUNT(*) FILTER (WHERE document_id % 2 = 0 AND document_id % 12 < 10 AND document_id % 4 = 0) AS unusable_regions FROM {CA} c WHERE status = 'ready') x""")
def ag25(spark, d):
    reg = spark.sql(REG, documents=spark.read.parquet(f"{d}/documents.parquet"))
    return gv.geometry_progress(bridge(spark, d, "catalog").filter("status = 'ready'"), reg, REGIONS)


@query("jn16_regions", f"""SELECT c.document_id, t.region, CASE WHEN g.boxed IS NULL THEN t.k / 20 ELSE 0.5 END AS x, CASE WHEN g.boxed IS NULL THEN 0.25 ELSE 0.125 END AS width FROM {CA} c CROSS JOIN (SELECT 'r' || k AS region, CAST(k AS DOUBLE) AS k FROM (SELECT UNNEST([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k) u) t
  LEFT JOIN ({REG.format(documents="documents")}) g ON c.document_id = g.document_id AND t.region = g.region WHERE COALESCE(g.state, '') <> 'unusable'""")
def jn16(spark, d):
    reg = spark.sql(REG, documents=spark.read.parquet(f"{d}/documents.parquet")).withColumn("box", F.when(F.col("boxed") == 1, F.array(*[F.lit(v) for v in (0.5, 0.5, 0.125, 0.125)])))
    template = spark.createDataFrame([(f"r{k}", k / 20, 0.25, 0.25, 0.25) for k in range(10)], "region string, x double, y double, width double, height double")
    return gv.regions_in_use(bridge(spark, d, "catalog"), template, reg).select("document_id", "region", "x", "width")


@query("st6_merged_regions", f"SELECT document_id, region, CASE WHEN document_id % 6 = 0 THEN 'new' ELSE state END AS state FROM ({REG.format(documents='documents')}) r UNION ALL SELECT document_id, 'extra', 'new' FROM ({REG.format(documents='documents')}) r WHERE document_id % 10 = 0")
def st6(spark, d):
    reg = spark.sql(REG, documents=spark.read.parquet(f"{d}/documents.parquet")).drop("boxed")
    new = reg.filter("document_id % 6 = 0").withColumn("state", F.lit("new")).unionByName(reg.filter("document_id % 10 = 0").withColumn("region", F.lit("extra")).withColumn("state", F.lit("new")))
    return gv.merged_regions(reg, new)


@query("st4_writer_exposure", f"SELECT document_id, writer AS writer_id, writer IS NOT NULL AS writer_known, COALESCE(writer IN ('de', 'en'), false) AS writer_seen FROM {CA} c")
def st4(spark, d):
    m = bridge(spark, d, "catalog").select("document_id", F.col("writer").alias("writer_id"), F.when(F.col("writer").isin("de", "en") & (F.col("document_id") % 2 == 0), "train").otherwise("test").alias("split"))
    return gv.with_writer_exposure(m.drop("split"), m).select("document_id", "writer_id", "writer_known", "writer_seen")


def _json(path: str) -> str:
    return f"json_type(j, '{path}')"


def _whole_sql(path: str, j: str = "j") -> str:
    return f"COALESCE(json_type({j}, '{path}') IN ('UBIGINT', 'BIGINT', 'BOOLEAN'), false)"


def _number_sql(path: str, j: str = "j") -> str:
    return f"CASE WHEN {_whole_sql(path, j)} THEN CASE json_extract_string({j}, '{path}') WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE CAST(json_extract_string({j}, '{path}') AS BIGINT) END END"


def _text_sql(path: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END"


def _issues_sql() -> str:
    """The codes in order, as DuckDB reads the same JSON."""
    told, obj = "st IN ('reviewed', 'verified')", lambda p: f"COALESCE({_json(p)} = 'OBJECT', false)"
    blank = lambda p: f"COALESCE(TRIM({_text_sql(p)}), '') = ''"
    out = [
        (f"{_text_sql('$.game_id')} IS DISTINCT FROM CAST(document_id AS VARCHAR)", "game_id_mismatch"), (f"{_text_sql('$.source_file')} IS DISTINCT FROM source_path", "source_file_mismatch"),
        (f"{told} AND NOT {obj('$.review')}", "review_metadata_missing"), (f"{told} AND {obj('$.review')} AND {blank('$.review.reviewed_at')}", "reviewed_at_missing"),
        (f"{told} AND {obj('$.review')} AND {blank('$.review.method')}", "review_method_missing"), ("pend", "pending_review_warning_present"), (f"NOT {obj('$.teams')}", "teams_missing"),
    ]
    late = []
    every = lambda p: " AND ".join(_whole_sql(f"{p}.Q{q}") for q in (1, 2, 3, 4))
    for s in "AB":
        t, o = f"$.teams.{s}", f"$.teams.{s}.individual_foul_observations"
        late += [
            (f"NOT {obj(t)}", f"team_{s}_missing"), (f"{obj(t)} AND COALESCE(json_array_length(j, '{t}.roster'), 0) = 0", f"team_{s}_roster_missing"), (f"{obj(t)} AND NOT ({every(t + '.team_fouls')})", f"team_{s}_team_fouls_incomplete"),
            (f"{obj(t)} AND json_extract_string(j, '{t}.individual_fouls_reviewed') IS DISTINCT FROM 'true'", f"team_{s}_individual_fouls_unreviewed"), (f"{obj(t)} AND {_json(o)} IS NOT NULL AND {_json(o)} <> 'OBJECT'", f"team_{s}_individual_foul_observations_invalid"),
            (f"{obj(t)} AND list_contains(list_transform(list_filter(json_extract(j, '{o}.*[*]'), lambda e: json_type(e) = 'OBJECT'), lambda e: COALESCE(json_extract_string(e, '$.review_state'), 'pending')), 'pending')", f"team_{s}_individual_foul_observations_pending"),
        ]
    late += [(f"NOT ({every(f'$.period_scores.{s}')})", f"team_{s}_period_scores_incomplete") for s in "AB"]
    late.append((f"NOT ({_whole_sql('$.final_score.A')} AND {_whole_sql('$.final_score.B')})", "final_score_incomplete"))
    n = "COALESCE(json_array_length(j, '$.scoring'), 0)"
    late.append((f"COALESCE({_json('$.scoring')} <> 'ARRAY', true)", "scoring_missing"))
    late.append((f"{n} = 0 AND GREATEST(COALESCE({_number_sql('$.final_score.A')}, 0), COALESCE({_number_sql('$.final_score.B')}, 0)) > 0", "scoring_empty"))
    late += [(" + ".join(_number_sql(f"$.period_scores.{s}.Q{q}") for q in (1, 2, 3, 4)) + f" <> {_number_sql(f'$.final_score.{s}')}", f"team_{s}_period_total_mismatch") for s in "AB"]
    for s in "AB":
        for q in (1, 2, 3, 4):
            own = f"list_filter(json_extract(j, '$.scoring[*]'), lambda e: COALESCE({_text_sql('$.team', 'e')} = '{s}' AND {_text_sql('$.period', 'e')} = 'Q{q}' AND {_whole_sql('$.points', 'e')}, false))"
            late.append((f"{n} > 0 AND COALESCE(list_sum(list_transform({own}, lambda e: {_number_sql('$.points', 'e')})), 0) <> {_number_sql(f'$.period_scores.{s}.Q{q}')}", f"team_{s}_Q{q}_scoring_mismatch"))
    split = (f"COALESCE({_json('$.evaluation_split')}, 'NULL') <> 'NULL' AND COALESCE({_text_sql('$.evaluation_split')} NOT IN ('train', 'validation', 'test'), true)", "evaluation_split_invalid")
    code = lambda c: f"CASE WHEN {c[0]} THEN '{c[1]}' END"
    return "concat_ws(',', " + ", ".join([*map(code, out), *(code((f"{obj('$.teams')} AND ({c[0]})", c[1])) for c in late), code(split)]) + ")"


AUDITED = f"""(SELECT *, {_issues_sql()} AS issues FROM (SELECT *, COALESCE(NULLIF(LOWER(TRIM({_text_sql('$.review.status')})), ''), CASE WHEN pend THEN 'pending' ELSE 'unverified' END) AS st FROM (
  SELECT document_id, source_path, CAST(text AS JSON) AS j, COALESCE(LOWER(CAST(json_extract(text, '$.warnings') AS VARCHAR)) LIKE '%pendente%', false) AS pend FROM {GT} g) a) b)"""


def audited_truth(spark, d) -> DataFrame:
    g = bridge(spark, d, "ground_truth").withColumn("document_id", F.col("document_id").cast("string"))
    return gt.audit_rows(g.withColumn("ground_truth_sha256", F.sha2("text", 256)).withColumn("source_sha256", F.lit(None).cast("string")), "s1")


@query("ag17_issues", f"SELECT CAST(document_id AS VARCHAR) AS document_id, st AS review_status, issues, issues = '' AS complete FROM {AUDITED} a")
def ag17(spark, d):
    return audited_truth(spark, d).select("document_id", "review_status", F.array_join("issues", ",").alias("issues"), F.col("ground_truth_complete").alias("complete"))


WRITER = f"CASE WHEN {_text_sql('$.writer_name')} IS NOT NULL THEN 'writer_' || SUBSTR(sha256('writer:' || LOWER(TRIM({_text_sql('$.writer_name')}))), 1, 12) END"
SPLITS_SQL = f"""(SELECT *, COALESCE(CASE WHEN {_text_sql('$.evaluation_split')} IN ('train', 'validation', 'test') THEN {_text_sql('$.evaluation_split')} END, {SPLIT}) AS split FROM (SELECT *, CAST(CAST(CONCAT('0x', SUBSTR(sha256(CONCAT('s1:', COALESCE('writer:' || writer, CAST(document_id AS VARCHAR)))), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS b
  FROM (SELECT *, {WRITER} AS writer FROM {AUDITED} a) w) z)"""


@query("ag20_manifest", f"SELECT CAST(document_id AS VARCHAR) AS document_id, writer AS writer_id, split FROM {SPLITS_SQL} s")
def ag20m(spark, d):
    return audited_truth(spark, d).select("document_id", "writer_id", "split")


@query("ag18_observation_counts", f"""SELECT CAST(document_id AS VARCHAR) AS document_id, s AS state, COUNT(*) AS n FROM (SELECT document_id, UNNEST(list_transform(list_filter(list_concat(json_extract(j, '$.teams.A.individual_foul_observations.*[*]'), json_extract(j, '$.teams.B.individual_foul_observations.*[*]')), lambda e: json_type(e) = 'OBJECT'),
  lambda e: COALESCE(json_extract_string(e, '$.review_state'), 'pending'))) AS s FROM {AUDITED} a) x GROUP BY 1, 2""")
def ag18o(spark, d):
    return audited_truth(spark, d).select("document_id", F.explode("individual_foul_observation_counts").alias("state", "n")).withColumn("n", F.col("n").cast("long"))


@query("ag20_report", f"""SELECT (SELECT COUNT(*) FROM {AUDITED} a) AS ground_truth_documents, (SELECT COUNT(*) FROM {AUDITED} a WHERE st IN ('reviewed', 'verified') AND issues = '') AS reviewed_ground_truth_documents, (SELECT COUNT(DISTINCT writer) FROM {SPLITS_SQL} s) AS known_writers,
  (SELECT COUNT(*) FROM documents) AS catalog_documents, (SELECT string_agg(st || '=' || n, ',' ORDER BY st) FROM (SELECT st, COUNT(*) AS n FROM {AUDITED} a GROUP BY st) c) AS by_status, (SELECT COUNT(*) FROM {SPLITS_SQL} s WHERE split = 'test') AS test_documents,
  NOT EXISTS (SELECT writer FROM {SPLITS_SQL} s WHERE writer IS NOT NULL GROUP BY writer HAVING COUNT(DISTINCT split) > 1) AS isolated, 'in_progress' AS status""")
def ag20(spark, d):
    g = bridge(spark, d, "ground_truth").withColumn("document_id", F.col("document_id").cast("string")).withColumn("ground_truth_sha256", F.sha2("text", 256))
    catalog = g.select("document_id", "source_path", F.sha2("document_id", 256).alias("sha256"), F.lit(0).alias("ord"))
    _, report = gt.audit(g.drop("source_path"), catalog, "s1")
    by = F.array_join(F.transform(F.map_entries("review_status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.select("ground_truth_documents", "reviewed_ground_truth_documents", "known_writers", "catalog_documents", by.alias("by_status"), F.col("split_counts.test").alias("test_documents"), F.col("exit_criteria.document_and_writer_isolation").alias("isolated"), "status")


@query("jn5_orphans", f"SELECT CAST(document_id AS VARCHAR) AS document_id, 'orphan' AS kind FROM {GT} g WHERE document_id % 9 = 0 UNION ALL SELECT CAST(document_id AS VARCHAR), 'duplicate' FROM {GT} g WHERE document_id % 9 <> 0 AND document_id % 4 = 0")
def jn5(spark, d):
    g = bridge(spark, d, "ground_truth").withColumn("document_id", F.col("document_id").cast("string"))
    c = g.filter("document_id % 9 <> 0").select("document_id", "source_path", F.lit("x").alias("sha256"), F.lit(0).alias("ord"))
    _, orphans, twice = gt.matched(g.drop("source_path"), c.unionByName(c.filter("document_id % 4 = 0").withColumn("ord", F.lit(1))))
    return orphans.withColumn("kind", F.lit("orphan")).unionByName(twice.withColumn("kind", F.lit("duplicate")))


# DuckDB hashes the same rows as one text; both sides name the columns in order.
@query("ag19_fingerprint", "SELECT sha256('[' || string_agg(json_object('k', doc_id, 's', source), ',' ORDER BY doc_id) || ']') AS fingerprint FROM documents WHERE source IS NOT NULL")
def ag19(spark, d):
    return gv.fingerprint(spark.read.parquet(f"{d}/documents.parquet").filter("source is not null").select(F.col("doc_id").alias("k"), F.col("source").alias("s")), "k")


@query("ag18_state_counts", f"SELECT field_type, review_state, COUNT(*) AS n FROM {RV} v GROUP BY 1, 2")
def ag18(spark, d):
    return gv.state_counts(bridge(spark, d, "reviews"))


@query("ag22_ingest_summary", f"SELECT status, COUNT(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, COALESCE((SELECT string_agg(document_id, ',' ORDER BY category) FROM ({ORACLE_SQL['tk1_pilots']}) t WHERE t.status = c.status), '') AS pilots FROM {CA} c GROUP BY status")
def ag22(spark, d):
    c = bridge(spark, d, "catalog")
    return gv.ingest_summary(c, gv.pilots(c, 5)).withColumn("pilots", F.array_join("pilots", ","))


@query("st1_uncovered", f"SELECT DISTINCT document_id FROM {CA} c WHERE document_id NOT IN (SELECT crop_id FROM {RV} v WHERE review_state <> 'pending')")
def st1(spark, d):
    return gv.uncovered(bridge(spark, d, "catalog"), bridge(spark, d, "reviews").filter("review_state <> 'pending'").select(F.col("crop_id").alias("document_id")), "document_id")


@query("ag26_elongation", f"""SELECT cell, n, CASE WHEN n > 1 AND d > 0 THEN SQRT((t + r) / (t - r)) END AS elongation FROM (SELECT *, SQRT(GREATEST(t * t - 4 * d, 0.0)) AS r FROM (SELECT cell, n, CAST(a + b AS DOUBLE) AS t, CAST(a * b - c * c AS DOUBLE) AS d FROM (
  SELECT cell, n, CAST(n * sxx - sx * sx AS BIGINT) AS a, CAST(n * syy - sy * sy AS BIGINT) AS b, CAST(n * sxy - sx * sy AS BIGINT) AS c FROM (SELECT cell, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(y * y) AS syy, SUM(x * y) AS sxy FROM {PX} p GROUP BY cell) m) q) u) v""")
def ag26(spark, d):
    return px.elongation(bridge(spark, d, "pixels"))


@query("ml1_constrain", """SELECT vec_id, value, round_even(w / s, 4) AS value_confidence, CASE WHEN w / s >= 0.7 THEN 'accepted' ELSE 'review' END AS value_status FROM (SELECT vec_id, i AS value, w, SUM(w) OVER (PARTITION BY vec_id) AS s, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY w DESC, i) AS r FROM (
  SELECT vec_id, CAST(g.i AS BIGINT) AS i, FLOOR(ABS(CAST(embedding[g.i + 1] AS DOUBLE)) * 1000) AS w FROM embeddings, (SELECT UNNEST([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i) g WHERE (vec_id + g.i) % 3 <> 0) x) y WHERE r = 1""")
def ml1(spark, d):
    e = bridge(spark, d, "candidates")
    digits = F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))
    c = e.withColumn("candidates", F.transform(digits, lambda i: F.struct(i.alias("label"), F.floor(F.abs(F.element_at("embedding", (i + 1).cast("int")).cast("double")) * 1000).cast("double").alias("probability"))))
    c = c.withColumn("allowed", F.filter(digits, lambda i: (F.col("vec_id") + i) % 3 != 0))
    return rc.constrained(c).select("vec_id", "value", "value_confidence", "value_status")


# Records of the core-field assessment; SQL that Spark and DuckDB read alike.
CORE = {
    "teams": "SELECT DISTINCT document_id, side, CASE WHEN document_id % 9 = 0 THEN NULL ELSE 'team' END AS name, CASE document_id % 3 WHEN 0 THEN 'review' ELSE 'accepted' END AS roster_status, CASE WHEN document_id % 5 < 2 THEN NULL ELSE document_id % 7 END AS final_score, CASE WHEN document_id % 5 = 0 THEN NULL ELSE document_id % 7 END AS final_candidate, CASE document_id % 4 WHEN 0 THEN 'review' ELSE 'accepted' END AS final_status FROM {players} b WHERE NOT (side = 'B' AND document_id % 10 = 0)",
    "players": "SELECT document_id, side, CASE WHEN document_id % 6 = 0 AND row_no = 3 THEN 'review' WHEN document_id % 8 = 0 AND row_no = 1 THEN 'unresolved' ELSE 'accepted' END AS participation_status, 'accepted' AS starter_status, starter FROM {players} b WHERE document_id % 12 <> 5",
    "fouls": "SELECT document_id, side, CASE WHEN symbol = 'F' THEN 'review' ELSE 'accepted' END AS status FROM {foul_cells} b",
    "events": "SELECT document_id, side, CASE WHEN jersey IS NULL THEN 'unresolved' WHEN ink_color = 'unknown' THEN 'review' ELSE 'accepted' END AS status FROM {scoring_events} b WHERE document_id % 4 <> 0",
    "team_fouls": "SELECT document_id, side, period FROM {team_foul_cells} b WHERE kind = 'x'",
    "periods": "SELECT document_id, side, period, CASE WHEN document_id % 8 = 4 THEN 0 ELSE value END AS written, CASE WHEN document_id % 2 = 0 THEN 1 ELSE value END AS candidate, CASE WHEN document_id % 3 = 0 THEN status ELSE 'accepted' END AS status FROM {written_scores} b",
}
_SIDES = ("scoring_events", "players", "foul_cells", "team_foul_cells", "written_scores")
_CORE_SQL = {k: "(" + v.format(**{n: bridge_sql(n) for n in _SIDES}) + ")" for k, v in CORE.items()}
_RANK = "MAX(CASE status WHEN 'unresolved' THEN 2 WHEN 'review' THEN 1 ELSE 0 END)"
_OPEN = "CASE {0} WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'unresolved' END"
CORE_FIELDS = f"""WITH s AS (SELECT document_id, side FROM (SELECT DISTINCT document_id FROM {PL} b) d, (SELECT UNNEST(['A', 'B']) AS side) x),
p AS (SELECT document_id, side, {_RANK.replace('status', 'participation_status')} AS played, {_RANK.replace('status', 'starter_status')} AS started, COUNT(*) FILTER (WHERE starter) AS starters FROM {_CORE_SQL['players']} q GROUP BY 1, 2),
f AS (SELECT document_id, side, {_RANK} AS v FROM {_CORE_SQL['fouls']} q GROUP BY 1, 2), e AS (SELECT document_id, side, {_RANK} AS v FROM {_CORE_SQL['events']} q GROUP BY 1, 2),
t AS (SELECT document_id, side, COUNT(DISTINCT period) AS n FROM {_CORE_SQL['team_fouls']} q WHERE period <= 4 GROUP BY 1, 2),
w AS (SELECT document_id, side, COUNT(written) AS nw, COUNT(candidate) AS nc, {_RANK} AS v, COUNT(*) FILTER (WHERE written = 0) AS zeros FROM {_CORE_SQL['periods']} q WHERE period <= 4 GROUP BY 1, 2),
j AS (SELECT s.document_id, s.side, m.document_id IS NULL AS gone, m.name, m.roster_status, m.final_score, m.final_candidate, m.final_status, p.document_id IS NOT NULL AS listed, played, started, COALESCE(starters, 0) AS starters,
  COALESCE(f.v, 0) AS foul, e.v AS scored, COALESCE(t.n, 0) AS boxes, COALESCE(nw, 0) AS nw, COALESCE(nc, 0) AS nc, w.v AS wrote, zeros
  FROM s LEFT JOIN {_CORE_SQL['teams']} m USING (document_id, side) LEFT JOIN p USING (document_id, side) LEFT JOIN f USING (document_id, side) LEFT JOIN e USING (document_id, side) LEFT JOIN t USING (document_id, side) LEFT JOIN w USING (document_id, side)),
r AS (SELECT *, CASE roster_status WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS ro, CASE final_status WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS fi FROM j),
x AS (SELECT document_id, side, gone, starters, 1 AS pos, 'name' AS field, CASE WHEN name IS NULL THEN 2 ELSE 0 END AS v FROM r
  UNION ALL SELECT document_id, side, gone, starters, 2, 'players', CASE WHEN listed THEN ro ELSE 2 END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 3, 'participation', CASE WHEN listed THEN played ELSE 2 END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 4, 'starters', CASE WHEN NOT listed THEN 2 WHEN starters <> 5 THEN GREATEST(started, 1) ELSE started END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 5, 'period_scoring', CASE WHEN nw = 4 THEN wrote WHEN nc = 4 THEN GREATEST(wrote, 1) ELSE 2 END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 6, 'scoring_events', CASE WHEN scored IS NOT NULL THEN scored WHEN final_score = 0 AND nw = 4 AND zeros = 4 THEN 0 ELSE 2 END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 7, 'individual_fouls', CASE WHEN listed THEN foul ELSE 2 END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 8, 'team_fouls', CASE WHEN boxes = 4 THEN 0 ELSE 2 END FROM r
  UNION ALL SELECT document_id, side, gone, starters, 9, 'final_score', CASE WHEN final_score IS NOT NULL THEN fi WHEN final_candidate IS NOT NULL THEN GREATEST(fi, 1) ELSE 2 END FROM r),
y AS (SELECT *, CASE WHEN gone THEN 2 ELSE v END AS u FROM x)
SELECT document_id, side, CAST(pos AS BIGINT) AS pos, 'teams.' || side || '.' || field AS path, {_OPEN.format('u')} AS status, CASE WHEN gone THEN '{asm.MISSING}' WHEN u = 0 THEN NULL ELSE CASE pos
  {' '.join(f"WHEN {k + 1} THEN " + ("replace('" + t + "', '%d', CAST(starters AS VARCHAR))" if '%d' in t else f"'{t}'") for k, t in enumerate(asm.REASONS.values()))} END END AS reason FROM y"""


def core_tables(spark, d) -> dict[str, DataFrame]:
    seen = {n: bridge(spark, d, n) for n in _SIDES}
    return {k: spark.sql(v, **{n: seen[n] for n in _SIDES if "{" + n + "}" in v}) for k, v in CORE.items()}


@query("core_fields", CORE_FIELDS)
def core_fields(spark, d):
    return asm.core_fields(bridge(spark, d, "players").select("document_id"), **core_tables(spark, d))


@query("core_document_status", f"SELECT document_id, {_OPEN.format('MAX(z)')} AS status, COUNT(*) FILTER (WHERE z > 0) AS n_open FROM (SELECT document_id, CASE status WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS z FROM ({CORE_FIELDS}) c) k GROUP BY document_id")
def core_document_status(spark, d):
    return asm.document_status(core_fields(spark, d))


# Half of the documents' warnings only, so that both outcomes occur.
@query("ag10_status", f"""SELECT document_id, CASE WHEN worst = 2 THEN 'unresolved' WHEN worst = 1 OR warned THEN 'review' ELSE 'accepted' END AS status FROM (SELECT document_id, MAX(z) AS worst, BOOL_OR(w.document_id IS NOT NULL) AS warned
  FROM (SELECT document_id, CASE WHEN document_id % 3 = 0 OR status = 'accepted' THEN 0 WHEN status = 'review' THEN 1 ELSE 2 END AS z FROM ({CORE_FIELDS}) c) k LEFT JOIN (SELECT DISTINCT document_id FROM {SIDE_WARNINGS} s WHERE document_id % 2 = 0) w USING (document_id) GROUP BY document_id) x""")
def ag10(spark, d):
    fields = core_fields(spark, d).withColumn("status", F.when(F.col("document_id") % 3 == 0, "accepted").otherwise(F.col("status")))
    return asm.document_status(fields, rec.document_warnings(warnings_of_sides(spark, d).filter("document_id % 2 = 0"))).drop("n_open")


@query("ag10_team_status", f"""SELECT document_id, side, {_OPEN.format('GREATEST(worst, CASE WHEN w.warnings IS NULL THEN 0 ELSE 1 END)')} AS status FROM (SELECT document_id, side, MAX(CASE status WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) AS worst
  FROM ({CORE_FIELDS}) c GROUP BY 1, 2) f LEFT JOIN {SIDE_WARNINGS} w USING (document_id, side)""")
def ag10t(spark, d):
    return rec.team_status(bridge(spark, d, "players"), warnings_of_sides(spark, d), core_fields(spark, d))
