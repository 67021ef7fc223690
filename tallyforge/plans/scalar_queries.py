"""Queries of the column functions and of the rules over measured cells, with SQL; registered beside the record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import images as im
from ..operators import ordered as od
from ..operators import pixels as px
from ..operators import recognition as rc
from .bridges import bridge, bridge_sql
from .queries import query

FO, PX = bridge_sql("foul_cells"), bridge_sql("pixels")


def table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("sc1_slug", "SELECT p_partkey, CASE WHEN s = '' THEN 'documento' ELSE s END AS slug FROM (SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' / ' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' !' ELSE '' END, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM part) x")
def sc1(spark, d):
    text = F.concat("p_name", F.lit(" / "), "p_type", F.when(F.col("p_partkey") % 5 == 0, " !").otherwise(""))
    return table(spark, d, "part").select("p_partkey", sc.slug(text).alias("slug"))


# Entry names of every kind: folders, backslashes, steps up, absolute ones and bare files.
NAMES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CONCAT('/', p_brand, '/1.pdf') WHEN 1 THEN CONCAT(p_type, '/', p_brand, '/1.pdf') WHEN 2 THEN CONCAT(p_brand, {slash}, '2.png') WHEN 3 THEN CONCAT('../', p_brand, '/3.jpg') WHEN 4 THEN '4.pdf' ELSE CONCAT('a/../', p_brand, '/5.pdf') END AS name FROM {part}"


@query("sc2_safe_path", "SELECT p_partkey, p_partkey % 6 IN (1, 2) AS safe, CASE WHEN p_partkey % 6 IN (1, 2) THEN p_brand END AS category FROM part")
def sc2(spark, d):
    n = spark.sql(NAMES.replace("{slash}", r"'\\'"), part=table(spark, d, "part")).withColumn("safe", sc.safe_path(F.col("name")))
    return n.select("p_partkey", "safe", F.when(F.col("safe"), F.element_at(sc.path_parts(F.col("name")), -2)).alias("category"))


@query("sc3_document_id", "SELECT doc_id, lower(replace(source, ' ', '-')) || '-' || lang || '-' || substr(sha256(text), 1, 8) AS document_id FROM documents WHERE regexp_full_match(source, '[a-z0-9]+') AND text IS NOT NULL AND lang IS NOT NULL")
def sc3(spark, d):
    t = table(spark, d, "documents").filter(F.col("source").rlike("^[a-z0-9]+$") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return t.select("doc_id", sc.document_id(F.col("source"), F.col("lang"), F.sha2("text", 256)).alias("document_id"))


@query("sc4_writer", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'writer_' || substr(sha256('writer:' || lower(trim(c_name))), 1, 12) END AS writer FROM customer")
def sc4(spark, d):
    return table(spark, d, "customer").select("c_custkey", sc.anonymous_writer(F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name"))).alias("writer"))


@query("sc6_crop_id", f"""SELECT document_id, side, jersey, slot, substr(sha256(document_id || '|' || CASE WHEN slot % 2 = 0 THEN 'jersey|' || side || ':' || jersey ELSE 'foul_event|' || side || ':None:' || slot END), 1, 20) AS crop_id, substr(sha1(document_id || '|' || side), 1, 12) AS result_id FROM {FO} f""")
def sc6(spark, d):
    kind, none = F.when(F.col("slot") % 2 == 0, "jersey").otherwise("foul_event"), F.lit(None).cast("string")
    pos = sc.position_of(kind, F.col("side"), F.col("jersey"), none, F.col("slot"), none)
    return bridge(spark, d, "foul_cells").select("document_id", "side", "jersey", "slot", sc.crop_id(F.col("document_id"), kind, pos).alias("crop_id"), sc.result_id(F.col("document_id").cast("string"), F.col("side")).alias("result_id"))


@query("sc9_period_of_foul", f"SELECT document_id, side, jersey, slot, CASE ink_color WHEN 'red' THEN CASE WHEN slot <= first_half_slots THEN 1 ELSE 3 END WHEN 'blue' THEN CASE WHEN slot <= first_half_slots THEN 2 ELSE 4 END END AS period FROM {FO} f")
def sc9(spark, d):
    return bridge(spark, d, "foul_cells").select("document_id", "side", "jersey", "slot", sc.period_of_foul(F.col("slot"), F.col("first_half_slots"), F.col("ink_color")).alias("period"))


@query("sc10_shot", """SELECT event_id, CASE WHEN k = 0 THEN 'free_throw' WHEN k = 1 AND event_id % 2 = 0 THEN 'three_point' WHEN k = 1 THEN 'two_point' ELSE 'ambiguous' END AS shot_type, CASE WHEN k = 0 THEN 1 WHEN k = 1 AND event_id % 2 = 0 THEN 3 WHEN k = 1 THEN 2 ELSE 0 END AS points,
  round_even(least(event_id % 100 / 128.0, event_id % 7 / 8.0), 4) AS confidence FROM (SELECT *, event_id % 4 AS k FROM events) e""")
def sc10(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    mark = F.when(k == 0, "free_throw").when(k == 1, "field_goal").when(k == 2, "ambiguous").otherwise("empty")
    sure = sc.three_point_confidence((F.col("event_id") % 100) / 128.0, (F.col("event_id") % 7) / 8.0)
    # Odd ids only are field goals by k = 1; a circle is told by another bit, so that both kinds occur.
    return e.select("event_id", sc.shot(mark, F.col("event_id") % 2 == 0).alias("s"), sure.alias("confidence")).select("event_id", "s.shot_type", "s.points", "confidence")


@query("sc12_indicator", "SELECT p_partkey, p_size % 5 AS x_count, p_size % 5 = 4 AS capped, CASE WHEN p_size % 5 = 4 THEN 4 WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size % 5 END AS minimum FROM part")
def sc12(spark, d):
    t = sc.team_foul_indicator(F.col("p_size") % 5, F.when(F.col("p_partkey") % 3 == 0, 1))
    return table(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.x_count", F.col("t.count_is_capped").alias("capped"), F.col("t.minimum_team_fouls").alias("minimum"))


@query("sc13_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) AND o_orderkey % 130 <= 99 AND NOT (o_orderkey % 5 = 2 AND o_orderkey % 130 > 0) THEN o_orderkey % 130 END AS n FROM orders")
def sc13(spark, d):
    n = (F.col("o_orderkey") % 130).cast("string")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit(" "), n)).when(k == 1, F.concat(F.lit("+0"), n, F.lit(" "))).when(k == 2, F.concat(F.lit("-"), n)).when(k == 3, F.concat(n, F.lit("x"))).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", sc.number_in(text).alias("n"))


@query("sc14_roster", "SELECT p_partkey, (p_partkey % 40) || ',' || (40 + p_size) AS roster, (p_size % 30) || ',0,7,' || (p_partkey % 20) AS scores FROM part")
def sc14(spark, d):
    p = table(spark, d, "part")
    text = F.concat_ws(" , ", (F.col("p_partkey") % 40).cast("string"), F.lit(""), (40 + F.col("p_size")).cast("string"))
    four = F.concat_ws(",", (F.col("p_size") % 30).cast("string"), F.lit(" 0"), F.lit("7 "), (F.col("p_partkey") % 20).cast("string"))
    return p.select("p_partkey", F.array_join(sc.parsed_roster(text).cast("array<string>"), ",").alias("roster"), F.array_join(sc.parsed_period_scores(four).cast("array<string>"), ",").alias("scores"))


@query("sc15_pixel_box", "SELECT p_partkey, CAST(round_even(x * 250, 0) AS BIGINT) AS l, CAST(round_even(y * 350, 0) AS BIGINT) AS t, CAST(round_even((x + 0.25) * 250, 0) AS BIGINT) AS r, CAST(round_even((y + 0.125) * 350, 0) AS BIGINT) AS b FROM (SELECT p_partkey, p_partkey % 64 / 128.0 AS x, p_size % 50 / 64.0 AS y FROM part) p")
def sc15(spark, d):
    x, y = F.col("p_partkey") % 64 / 128.0, F.col("p_size") % 50 / 64.0
    box = sc.pixel_box(x, y, F.lit(0.25), F.lit(0.125), F.lit(250), F.lit(350))
    return table(spark, d, "part").select("p_partkey", *[F.get(box, k).cast("long").alias(c) for k, c in enumerate("ltrb")])


@query("sc17_boxes", "SELECT p_partkey, (p_partkey % 60) || ',' || (p_size % 50) || ',' || (p_partkey % 60 + 40) || ',' || (p_size % 50 + 25) AS box FROM part")
def sc17(spark, d):
    """Percent to shares to pixels of an image of 100 by 200, where every side is whole, and back to percent and to pixels again."""
    p = table(spark, d, "part").select("p_partkey", sc.box_from_percent((F.col("p_partkey") % 60).cast("double"), (F.col("p_size") % 50) / 2.0, F.lit(40.0), F.lit(12.5)).alias("share"))
    p = p.withColumn("there", sc.box_to_pixels(F.col("share"), F.lit(100), F.lit(200))).withColumn("back", sc.box_to_percent(F.col("there"), F.lit(100), F.lit(200)))
    p = p.withColumn("again", sc.box_from_percent(*[F.col(f"back.{c}") for c in ("x", "y", "width", "height")]))
    return p.select("p_partkey", F.array_join(sc.box_to_pixels(F.col("again"), F.lit(100), F.lit(200)).cast("array<string>"), ",").alias("box"))


@query("sc18_labels", f"SELECT document_id, side, jersey, slot, CASE WHEN slot % 2 = 0 THEN CAST(jersey AS VARCHAR) ELSE CASE UPPER(REPLACE(symbol, ' ', '')) WHEN 'PC' THEN 'Pc' WHEN 'TC' THEN 'Tc' WHEN 'UC' THEN 'Uc' WHEN 'DC' THEN 'Dc' ELSE UPPER(REPLACE(symbol, ' ', '')) END END AS label FROM {FO} f WHERE symbol <> 'F'")
def sc18(spark, d):
    kind = F.when(F.col("slot") % 2 == 0, "scoring_event").otherwise("foul_event")
    label = sc.final_label(kind, F.when(F.col("slot") % 2 == 0, F.concat(F.lit(" "), F.col("jersey").cast("string"))).otherwise(F.lower("symbol")))
    return bridge(spark, d, "foul_cells").filter("symbol <> 'F'").select("document_id", "side", "jersey", "slot", label.alias("label"))


@query("sc19_review_status", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'unverified' END AS status FROM documents WHERE lang IS NOT NULL")
def sc19(spark, d):
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper("lang"))).when(k % 4 == 1, " ")
    warnings = F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("revisao Pendente"))).otherwise(F.array(F.lit("pend")))
    return table(spark, d, "documents").filter("lang is not null").select("doc_id", sc.review_status(status, warnings).alias("status"))


@query("sc20_capture", f"SELECT document_id, CASE WHEN extension = 'pdf' THEN 'pdf_scan' ELSE 'camera_image' END AS capture, CASE status WHEN 'ready' THEN 'ready' WHEN 'unreadable' THEN 'unreadable' ELSE 'alignment_review' END AS again FROM {bridge_sql('catalog')} c")
def sc20(spark, d):
    c = bridge(spark, d, "catalog")
    again = sc.catalogue_status(F.col("status") == "ready", F.when(F.col("status") == "unreadable", "E: x"))
    return c.select("document_id", sc.capture_condition(F.upper("extension")).alias("capture"), again.alias("again"))


@query("sc23_training", f"SELECT crop_id, label IS NOT NULL AND CASE WHEN crop_id % 3 = 0 THEN crop_id % 2 = 0 ELSE review_state IN ('accepted', 'adjusted') END AND field_type = 'de' AND crop_id % 5 <> 0 AS fits FROM {bridge_sql('reviews')} r")
def sc23(spark, d):
    r = bridge(spark, d, "reviews")
    k = F.col("crop_id")
    state, status = F.when(k % 3 != 0, F.col("review_state")), F.when(k % 2 == 0, "labeled").otherwise("unlabeled")
    return r.select("crop_id", sc.in_training(F.col("field_type"), F.when(k % 5 == 0, "test").otherwise("train"), F.col("label"), state, status, "de", "train").alias("fits"))


@query("sc24_position", f"SELECT document_id, side, jersey, slot, CASE WHEN slot = 1 THEN 'score:' || side || ':' || jersey ELSE 'foul:' || side || ':rowNone:slot' || slot END AS position, '/data/local-files/?d=crops/a%20' || jersey || '/' || slot || '%2B.png' AS url FROM {FO} f")
def sc24(spark, d):
    kind = F.when(F.col("slot") == 1, "jersey").otherwise("foul_symbol")
    path = F.concat(F.lit("crops/a "), F.col("jersey").cast("string"), F.lit("/"), F.col("slot").cast("string"), F.lit("+.png"))
    position = sc.position_text(kind, F.col("side"), F.col("jersey"), F.lit(None), F.col("slot"))
    return bridge(spark, d, "foul_cells").select("document_id", "side", "jersey", "slot", position.alias("position"), sc.media_url(path).alias("url"))


PIXEL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey * 7 % 256 AS INT) AS r, CAST(l_suppkey * 13 % 256 AS INT) AS g, CAST(l_orderkey * 11 % 256 AS INT) AS b FROM {lineitem}"


def _ink_sql(rules: tuple[int, ...]) -> str:
    s, rg, rb, rl, br, bg, bl = rules
    some = f"greatest(r, g, b) - least(r, g, b) >= {s}"
    return f"CASE WHEN {some} AND r >= g + {rg} AND r >= b + {rb} AND r >= {rl} THEN 'red' WHEN {some} AND b >= r + {br} AND b >= g + {bg} AND b >= {bl} THEN 'blue' END"


@query("sc26_ink", f"SELECT r, g, b, {_ink_sql(sc.INK)} AS ink, {_ink_sql(sc.PARTICIPATION_INK)} AS strict, r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE) < 145 AS dark FROM (SELECT DISTINCT r, g, b FROM ({PIXEL.format(lineitem='lineitem')}) q) p")
def sc26(spark, d):
    p = spark.sql(PIXEL, lineitem=table(spark, d, "lineitem")).select("r", "g", "b").distinct()
    c = [F.col(x) for x in "rgb"]
    return p.select("r", "g", "b", sc.red_blue_ink(*c).alias("ink"), sc.red_blue_ink(*c, sc.PARTICIPATION_INK).alias("strict"), (sc.gray(*c) < 145).alias("dark"))


@query("sc28_colour", f"""SELECT l_orderkey, red, blue, CASE WHEN red + blue = 0 THEN 'unknown' WHEN red / (red + blue) >= 0.62 THEN 'red' WHEN blue / (red + blue) >= 0.62 THEN 'blue' ELSE 'unknown' END AS colour
  FROM (SELECT l_orderkey, COUNT(*) FILTER (WHERE k = 'red') AS red, COUNT(*) FILTER (WHERE k = 'blue') AS blue FROM (SELECT *, {_ink_sql(sc.INK)} AS k FROM ({PIXEL.format(lineitem='lineitem')}) p) q GROUP BY 1) x""")
def sc28(spark, d):
    p = spark.sql(PIXEL, lineitem=table(spark, d, "lineitem")).withColumn("k", sc.red_blue_ink(F.col("r"), F.col("g"), F.col("b")))
    g = p.groupBy("l_orderkey").agg(F.count_if(F.col("k") == "red").alias("red"), F.count_if(F.col("k") == "blue").alias("blue"))
    return g.withColumn("colour", sc.dominant_colour(F.col("red"), F.col("blue")))


@query("sc30_jersey_slots", "SELECT o_orderkey, CASE WHEN k < 10 THEN k ELSE CAST(floor(k / 10) AS BIGINT) END AS first, CASE WHEN k < 10 THEN 10 ELSE k % 10 END AS second FROM (SELECT o_orderkey, o_orderkey % 100 AS k FROM orders) o")
def sc30(spark, d):
    s = sc.jersey_slots((F.col("o_orderkey") % 100).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.get(s, 0).cast("long").alias("first"), F.get(s, 1).cast("long").alias("second"))


@query("wn10_first_label_slots", f"""SELECT document_id, side, jersey, slot, COALESCE(o.symbol, b.symbol) AS symbol FROM (SELECT document_id, side, jersey, symbol, ROW_NUMBER() OVER (PARTITION BY document_id, side, jersey ORDER BY slot) AS slot FROM {FO} f) b
  FULL JOIN (SELECT document_id, side, jersey, slot, 'X' AS symbol FROM {FO} f WHERE document_id % 3 = 0) o USING (document_id, side, jersey, slot)""")
def wn10(spark, d):
    f = bridge(spark, d, "foul_cells")
    return od.first_label_slots(f.withColumn("ord", F.col("slot")), f.filter("document_id % 3 = 0").withColumn("symbol", F.lit("X")))


@query("wn8_longest_run", f"SELECT cell, MAX(n) AS longest FROM (SELECT cell, COUNT(*) AS n FROM (SELECT cell, x, x - ROW_NUMBER() OVER (PARTITION BY cell ORDER BY x) AS i FROM (SELECT DISTINCT cell, x FROM {PX} p) a) b GROUP BY cell, i) c GROUP BY cell")
def wn8l(spark, d):
    return od.longest_run(bridge(spark, d, "pixels"), "x", ("cell",))


@query("tk5_nearest", f"SELECT cell, target, nearest FROM (SELECT cell, target, x AS nearest, ROW_NUMBER() OVER (PARTITION BY cell, target ORDER BY abs(x - target), x) AS r FROM (SELECT DISTINCT cell, x FROM {PX} p) p, (SELECT UNNEST([5.5, 20.0, 33.0]) AS target) t) q WHERE r = 1")
def tk5(spark, d):
    p = bridge(spark, d, "pixels")
    wanted = p.select("cell").distinct().withColumn("target", F.explode(F.array(F.lit(5.5), F.lit(20.0), F.lit(33.0))))
    return od.nearest(p, wanted, "x", "target", ("cell",)).select("cell", F.col("target").cast("decimal(3,1)").cast("double").alias("target"), "nearest")


@query("ag27_coverage", f"""SELECT cell, COUNT(DISTINCT CAST(floor((atan2(y - 19.5, x - 19.5) + pi()) / (2 * pi()) * 24) AS BIGINT) % 24) / 24 AS coverage FROM {PX} p WHERE sqrt((x - 19.5) * (x - 19.5) + (y - 19.5) * (y - 19.5)) BETWEEN 9 AND 20 GROUP BY cell""")
def ag27(spark, d):
    return px.angular_coverage(bridge(spark, d, "pixels"), 19.5, 19.5, 9, 20)


DIGITS = "SELECT vec_id, CAST(g.i AS BIGINT) AS i, (1 + FLOOR(ABS(CAST(embedding[g.i + 1] AS DOUBLE)) * 1000)) / 1024 AS p FROM embeddings, (SELECT UNNEST([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS i) g"


def candidates(spark, d) -> DataFrame:
    digits = F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))
    p = lambda i: ((1 + F.floor(F.abs(F.element_at("embedding", (i + 1).cast("int")).cast("double")) * 1000)) / 1024).cast("double")
    return bridge(spark, d, "candidates").select("vec_id", F.transform(digits, lambda i: F.struct(i.cast("string").alias("label"), p(i).alias("probability"))).alias("candidates"))


@query("tk3_top_ten", f"SELECT vec_id, string_agg(i, ',' ORDER BY r) AS labels FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM ({DIGITS}) c) x WHERE r <= 10 GROUP BY vec_id")
def tk3(spark, d):
    return candidates(spark, d).select("vec_id", F.array_join(F.transform(rc.top_ten(F.col("candidates")), lambda c: c["label"]), ",").alias("labels"))


@query("ml2_reweighted", f"""SELECT vec_id, CAST(i AS VARCHAR) AS label, round_even(q / s, 9) AS p FROM (SELECT *, SUM(q) OVER (PARTITION BY vec_id) AS s, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS r FROM (SELECT vec_id, i,
  CASE WHEN vec_id % 4 = 0 THEN p ELSE p * ((1 - w) + w * CASE WHEN i % 3 = 0 THEN 0.9 ELSE 0.0001 END) END AS q FROM (SELECT *, least(0.3, 0.3 * (vec_id % 4 * 40) / 100) AS w FROM ({DIGITS}) c) y) x) z WHERE r = 1""")
def ml2(spark, d):
    priors = F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(0, 12, 3)]), F.array(*[F.lit(0.9)] * 4))
    moved = rc.normalised(rc.reweighted(F.col("candidates"), priors, (F.col("vec_id") % 4 * 40).cast("int")))
    best = F.element_at(rc.top_ten(moved), 1)
    return candidates(spark, d).select("vec_id", best["label"].alias("label"), F.bround(best["probability"], 9).alias("p"))


@query("ag30_accuracy", "SELECT label, COUNT(*) AS n, AVG(CASE WHEN best = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM (SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS best FROM embeddings WHERE embedding IS NOT NULL) e GROUP BY label")
def ag30(spark, d):
    """Accuracy by class of the digit with the greatest of ten outputs."""
    e = table(spark, d, "embeddings").filter("embedding is not null").withColumn("ten", F.slice("embedding", 1, 10))
    best = F.array_position("ten", F.array_max("ten")) - 1
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((best == F.col("label")).cast("double")).alias("accuracy"))


# Measured cells: counts and extents of ink from the pixel table on a cell of 40 by 40, each pixel once, the others from keys. Spark and DuckDB read the SQL alike.
CELLS = """SELECT cell, COUNT(*) AS n, CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(y) AS DOUBLE) AS sy, CAST(SUM(x * x) AS DOUBLE) AS sxx, CAST(SUM(y * y) AS DOUBLE) AS syy, CAST(SUM(x * y) AS DOUBLE) AS sxy, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1, COUNT(*) * 2 + cell % 3 * 9 AS red, cell % 5 * 3 AS blue,
  cell % 101 / 101.0 AS row_max, cell % 4 AS rows_65, cell % 25 AS ring_bins, cell % 9 AS ring_points, cell % 89 / 88.0 AS a, cell % 83 / 82.0 AS b, cell % 79 / 78.0 AS c FROM (SELECT DISTINCT cell, x, y FROM {pixels} p) q GROUP BY cell"""
_SIDE_PX = 40


def cells(spark, d) -> DataFrame:
    c = spark.sql(CELLS, pixels=bridge(spark, d, "pixels"))
    had = {k: k for k in ("n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1", "red", "blue", "row_max", "rows_65", "ring_bins", "ring_points")}
    had |= {"column_max": "a", "top_max": "b", "middle_max": "c", "top_run": "a", "middle_run": "b", "right_quarter": "c", "right_eighth": "b", "changes": "a", "strict_ring": "b"}
    return c.withColumn("m", F.struct(F.lit(_SIDE_PX).alias("width"), F.lit(_SIDE_PX).alias("height"), *[F.col(v).cast("double" if v in "abc" else c.schema[v].dataType).alias(k) for k, v in had.items()], (F.col("cell") % 6).cast("int").alias("top_52"), (F.col("cell") % 5).cast("int").alias("middle_42"), (F.col("cell") % 30).alias("strict_red"), (F.col("cell") % 31).alias("strict_blue")))


# The rules as SQL over the same measures.
_E = "sqrt(greatest(big, small) / small)"
MEASURED = f"""(SELECT *, {_E} AS e, n / 1600 AS ratio, (x1 - x0 + 1) AS w, (y1 - y0 + 1) AS h, CASE WHEN red + blue = 0 THEN 'unknown' WHEN red / (red + blue) >= 0.62 THEN 'red' WHEN blue / (red + blue) >= 0.62 THEN 'blue' ELSE 'unknown' END AS colour FROM (SELECT *, greatest((p + q - rt) / 2, 0.000001) AS small, (p + q + rt) / 2 AS big FROM (
  SELECT *, sqrt((p - q) * (p - q) + 4 * o * o) AS rt FROM (SELECT *, (sxx - sx * sx / n) / greatest(n - 1, 1) AS p, (syy - sy * sy / n) / greatest(n - 1, 1) AS q, (sxy - sx * sy / n) / greatest(n - 1, 1) AS o FROM ({CELLS.format(pixels=PX)}) u) t) s) r)"""


@query("im7_score_mark", f"""SELECT cell, CASE WHEN ratio < 0.0025 THEN 'empty' WHEN n < 4 THEN 'ambiguous' WHEN dot >= 0.58 AND dot > slash + 0.05 THEN 'free_throw' WHEN slash >= 0.58 AND slash > dot THEN 'field_goal' ELSE 'ambiguous' END AS kind, CASE WHEN ratio < 0.0025 THEN 'unknown' ELSE colour END AS ink_color
  FROM (SELECT *, 0.45 / greatest(e, 1) + 0.35 * least(n / (w * h) / 0.55, 1) + 0.2 * greatest(0, 1 - greatest(w, h) / 40 / 0.62) AS dot, 0.6 * least(e / 4, 1) + 0.4 * least(greatest(w, h) / 40 / 0.7, 1) AS slash FROM {MEASURED} m) x""")
def im7(spark, d):
    return cells(spark, d).select("cell", im.score_mark(least=0.0025).alias("t")).select("cell", "t.kind", "t.ink_color")


@query("im8_circle", "SELECT cell, seen AND bins / 24.0 >= 0.54 AS detected, round_even(greatest(0, least(1, (CASE WHEN seen THEN bins / 24.0 ELSE 0 END - 0.28) / 0.5)), 4) AS confidence FROM (SELECT cell, cell % 25 AS bins, COUNT(*) / 1600 >= 0.002 AND COUNT(*) >= 8 AND cell % 9 >= 6 AS seen FROM (SELECT DISTINCT cell, x, y FROM " + PX + " p) q GROUP BY cell) r")
def im8(spark, d):
    return cells(spark, d).select("cell", im.jersey_circle(least=0.002).alias("t")).select("cell", "t.detected", "t.confidence")


@query("im9_closure", f"SELECT cell, n >= 4 AND (e > 3 OR (e > 2 AND w / 40 > 0.84 AND h / 40 < 0.86 AND ratio < 0.16)) AS closure FROM {MEASURED} m")
def im9(spark, d):
    return cells(spark, d).select("cell", im.closure_stroke().alias("closure"))


@query("im11_team_foul", f"""SELECT cell, CASE WHEN ratio < 0.002 THEN 'empty' WHEN n < 5 THEN 'ambiguous' WHEN row_max >= 0.75 AND rows_65 >= 2 THEN 'unused' WHEN x >= 0.57 AND x > u + 0.04 THEN 'x' WHEN u >= 0.57 AND u > x THEN 'unused' ELSE 'ambiguous' END AS kind FROM (
  SELECT *, 0.55 * greatest(0, 1 - abs(e - 1) / 1.8) + 0.2 * least(w / 40 / 0.65, 1) + 0.25 * least(h / 40 / 0.65, 1) AS x, 0.55 * least(e / 4, 1) + 0.3 * least(w / 40 / 0.7, 1) + 0.15 * greatest(0, 1 - h / 40 / 0.65) AS u FROM {MEASURED} m) z""")
def im11(spark, d):
    return cells(spark, d).select("cell", im.team_foul_mark(least=0.002).alias("t")).select("cell", "t.kind")


@query("im15_terminal", f"""SELECT cell, CASE WHEN ratio >= 0.002 THEN CASE WHEN row_max >= 0.72 THEN 'closure_stroke' WHEN 0.45 * least(a / 0.6, 1) + 0.3 * least(b / 0.5, 1) + 0.25 * least(c / 0.38, 1) >= 0.92 AND a >= 0.72 AND b >= 0.52 AND c >= 0.42 AND cell % 6 >= 3 AND cell % 5 >= 3 AND a >= 0.48 AND b >= 0.34 AND ratio <= 0.38
  AND c <= 0.48 AND b <= 0.3 THEN 'disqualification' END END AS kind FROM {MEASURED} m""")
def im15(spark, d):
    return cells(spark, d).select("cell", im.foul_terminal(least=0.002).alias("t")).select("cell", "t.kind")


@query("im19_participation", f"""SELECT cell, CASE WHEN hb AND hr AND b >= 0.015 THEN 'blue_x_red_circle' WHEN hb AND NOT hr THEN 'blue_x' WHEN hr AND NOT hb THEN 'red_x' WHEN hb THEN 'ambiguous' ELSE 'none' END AS mark, hb OR hr AS participated, hb AND hr AND b >= 0.015 AS starter
  FROM (SELECT cell, cell % 83 / 82.0 AS b, cell % 31 / 1600 >= 0.008 AS hb, cell % 30 / 1600 >= 0.008 AS hr FROM (SELECT DISTINCT cell FROM {PX} p) q) x""")
def im19(spark, d):
    return cells(spark, d).select("cell", im.participation().alias("t")).select("cell", "t.mark", "t.participated", "t.starter")


@query("ag29_alteration", f"""SELECT cell, concat_ws(',', CASE WHEN ratio >= 0.003 THEN 'dense_ink' END, CASE WHEN least(red, blue) / 1600 >= 0.0025 THEN 'mixed_red_blue' END, CASE WHEN a >= 0.34 THEN 'high_stroke_complexity' END) AS reasons FROM {MEASURED} m""")
def ag29(spark, d):
    return cells(spark, d).select("cell", im.alteration(dense=0.003, mixed=0.0025).alias("t")).select("cell", F.array_join("t.reasons", ",").alias("reasons"))
