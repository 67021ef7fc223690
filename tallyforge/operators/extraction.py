"""Observations of cells to records: the rules that turn marks, candidates and their confidences into events, fouls, rosters and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import FOUL_LABELS, foul_symbol, period_of_foul, shot, three_point_confidence
from .ordered import SIDE, color_run_periods, plausible_sequence, recognised_rows
from .recognition import constrained, profiled

#: An engine: decides rows that the rules leave ambiguous; adds choice and answer_confidence to them.
Engine = Callable[[DataFrame], DataFrame]
#: Answers below this are not taken.
SURE = 0.85


def _asked(rows: DataFrame, open_: Column, engine: Engine | None) -> DataFrame:
    """rows with an engine's choice and answer_confidence, asked for open rows only; without an engine there is none."""
    none = (F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("answer_confidence"))
    if engine is None:
        return rows.select("*", *none)
    is_open = F.coalesce(open_, F.lit(False))
    answered = engine(rows.filter(is_open)).select(*rows.columns, "choice", "answer_confidence")
    return rows.filter(~is_open).select("*", *none).unionByName(answered)


def jerseys(rows: DataFrame, rosters: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """rows(document_id, side, candidates, ...) with jersey and jersey_confidence: the best candidate on the side's roster, moved by the writer's priors.

    rosters: (document_id, side, jersey); a side without one allows every label. priors: (document_id, label_priors, sample_count).
    """
    lists = rosters.groupBy(*SIDE).agg(F.collect_set(F.col("jersey").cast("string")).alias("allowed"))
    r = rows.join(lists, list(SIDE), "left").withColumn("allowed", F.coalesce("allowed", F.transform("candidates", lambda c: c["label"])))
    r = profiled(constrained(r), priors) if priors is not None else constrained(r)
    number = F.when(F.col("value").rlike("^[0-9]{1,4}$"), F.col("value").cast("long"))
    return r.withColumn("jersey", number).withColumn("jersey_confidence", F.col("value_confidence")).drop("allowed", "ranked", "value", "value_confidence", "value_status")


def foul_symbols(rows: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """rows(document_id, candidates, ...) with symbol, symbol_confidence and symbol_status: the best of the labels that a foul may be given."""
    r = constrained(rows.withColumn("allowed", F.array(*[F.lit(x) for x in FOUL_LABELS])))
    r = profiled(r, priors) if priors is not None else r
    return r.withColumnsRenamed({"value": "symbol", "value_confidence": "symbol_confidence", "value_status": "symbol_status"}).drop("allowed", "ranked")


def scoring_events(cells: DataFrame, engine: Engine | None = None) -> DataFrame:
    """Scoring events of cells, with their periods and doubts.

    cells: document_id, side, running_score, mark (struct of score_mark), circle (of jersey_circle), jersey_ink, jersey_color, closure, grid_aligned, jersey, jersey_confidence.
    On a detected grid a cell counts if its jersey has ink that is no closing stroke; else if its mark is not empty. An engine may settle ambiguous marks, or drop them as closures.
    """
    keep = F.when(F.col("grid_aligned"), (F.col("jersey_ink") >= 0.025) & ~F.col("closure")).otherwise(F.col("mark.kind") != "empty")
    e = cells.filter(keep).withColumn("s", shot(F.col("mark.kind"), F.col("circle.detected")))
    color = F.when(F.col("grid_aligned") & (F.col("mark.ink_color") == "unknown"), F.col("jersey_color")).otherwise(F.col("mark.ink_color"))
    e = _asked(e.withColumn("ink_color", color), F.col("s.shot_type") == "ambiguous", engine)
    taken = F.coalesce(F.col("answer_confidence") >= SURE, F.lit(False))
    e = e.filter(~(taken & F.coalesce(F.col("choice") == "closure_stroke", F.lit(False))))
    settled = taken & F.coalesce(F.col("choice").isin("free_throw", "two_point", "three_point"), F.lit(False))
    kind = F.when(settled, F.col("choice")).otherwise(F.col("s.shot_type"))
    points = F.when(kind == "free_throw", 1).when(kind == "two_point", 2).when(kind == "three_point", 3).otherwise(0)
    sure = F.when(settled, F.col("answer_confidence")).otherwise(F.col("mark.confidence"))
    e = e.select(
        *SIDE, "running_score", F.col("running_score").alias("seq"), kind.alias("shot_type"), points.cast("long").alias("points"), "ink_color", F.when(kind == "three_point", three_point_confidence(sure, F.col("circle.confidence"))).otherwise(F.bround(sure, 4)).alias("confidence"),
        "jersey", "jersey_confidence", F.when(kind == "ambiguous", "review").otherwise("accepted").alias("status"))
    return color_run_periods(plausible_sequence(e)).drop("delta")


def settled_boxes(cells: DataFrame, engine: Engine | None = None) -> DataFrame:
    """Team-foul boxes (document_id, side, period, slot, mark) as (kind, confidence); an engine may settle ambiguous ones as x or unused."""
    c = _asked(cells, F.col("mark.kind") == "ambiguous", engine)
    taken = F.coalesce((F.col("answer_confidence") >= SURE) & F.col("choice").isin("x", "unused"), F.lit(False))
    return c.select(*SIDE, "period", "slot", F.when(taken, F.col("choice")).otherwise(F.col("mark.kind")).alias("kind"), F.when(taken, F.bround("answer_confidence", 4)).otherwise(F.col("mark.confidence")).alias("confidence"))


def player_fouls(cells: DataFrame, least: float = 0.015) -> tuple[DataFrame, DataFrame]:
    """Fouls and terminals of foul cells, slot by slot up to a row's first terminal.

    cells: document_id, side, jersey, slot, terminal (struct of foul_terminal or null), ink_ratio and ink_color of the cleaned cell, separator (struct of half_separator), symbol, symbol_confidence, symbol_status, grid_aligned.
    A terminal is a stroke or an F, drawn or read. A foul is accepted if its period, a known symbol, the recogniser, the separator and the grid all are sure.
    """
    row = (*SIDE, "jersey")
    read_f = F.coalesce(F.upper(F.trim("symbol")) == "F", F.lit(False)) & (F.col("ink_ratio") >= least)
    ends = F.col("terminal").isNotNull() | read_f
    c = cells.withColumn("first", F.min(F.when(ends, F.col("slot"))).over(Window.partitionBy(*row)))
    t = c.filter(F.col("slot") == F.col("first"))
    drawn = F.col("terminal").isNotNull()
    kind = F.when(drawn, F.col("terminal.kind")).otherwise("disqualification")
    status = F.when(drawn, F.when(F.col("grid_aligned") & (F.col("terminal.confidence") >= 0.85), "accepted").otherwise("review")).otherwise(F.col("symbol_status"))
    terminals = t.select(
        *row, "slot", kind.alias("kind"), F.when(kind == "disqualification", "F").otherwise("-").alias("raw_symbol"), F.when(drawn, F.col("terminal.ink_color")).otherwise(F.col("ink_color")).alias("ink_color"),
        F.when(drawn, F.col("terminal.confidence")).otherwise(F.col("symbol_confidence")).alias("confidence"), status.alias("status"))
    f = c.filter((F.col("first").isNull() | (F.col("slot") < F.col("first"))) & (F.col("ink_ratio") >= least))
    f = f.withColumn("period", period_of_foul(F.col("slot"), F.col("separator.first_half_slots"), F.col("ink_color"))).withColumn("f", foul_symbol(F.col("symbol")))
    half = F.when(F.col("period").isNotNull(), F.col("separator.confidence"))
    ok = F.col("period").isNotNull() & (F.col("f.kind") != "unknown") & (F.col("symbol_status") == "accepted") & (half >= 0.60) & F.col("grid_aligned")
    fouls = f.select(
        *row, "slot", "period", "f.kind", "f.free_throws", F.col("symbol").alias("raw_symbol"), "ink_color", F.col("f.cancelled").alias("cancelled"), F.col("f.counts").alias("counts"), F.col("f.fighting").alias("fighting"),
        F.least(half, F.col("symbol_confidence")).alias("confidence"), F.when(F.coalesce(ok, F.lit(False)), "accepted").otherwise("review").alias("status"))
    return fouls, terminals


def players(roster: DataFrame, marks: DataFrame) -> DataFrame:
    """Roster rows (document_id, side, row_no, jersey) with what was marked beside them (struct mark of participation); more than twelve rows are refused by parsed_roster."""
    p = marks.select(*SIDE, "row_no", F.col("mark").alias("p"))
    j = roster.join(p, [*SIDE, "row_no"], "left")
    return j.select(*roster.columns, "p.mark", "p.participated", "p.starter", "p.participation_confidence", "p.starter_confidence", F.col("p.status").alias("participation_status"), F.col("p.status").alias("starter_status"))


def read_roster(rows: DataFrame, threshold: float | None, least: float = 0.004) -> DataFrame:
    """Roster rows (row_no, ink, value, confidence, recognised) that hold ink, with jersey and row_status."""
    number = F.when(F.col("value").rlike("^[0-9]{1,2}$"), F.col("value").cast("long"))
    return recognised_rows(rows.filter(F.col("ink") >= least).withColumn("jersey", number), threshold)


def written_scores(cells: DataFrame, threshold: float | None, least: float = 0.004) -> DataFrame:
    """Written scores (document_id, side, period or null, ink, value, confidence, recognised) as candidate, written, confidence and status.

    Without ink or a number up to 99 a score is unresolved; it is accepted, and then written, if the recogniser and a given threshold do.
    """
    ink = F.col("ink") >= least
    number = F.when(ink & F.col("value").rlike("^[0-9]{1,2}$"), F.col("value").cast("long"))
    ok = F.lit(False) if threshold is None else (F.col("recognised") == "accepted") & (F.col("confidence") >= threshold)
    c = cells.withColumn("candidate", number)
    status = F.when(F.col("candidate").isNull(), "unresolved").when(F.coalesce(ok, F.lit(False)), "accepted").otherwise("review")
    c = c.withColumn("status", status)
    return c.select(*SIDE, "period", "candidate", F.when(F.col("status") == "accepted", F.col("candidate")).alias("written"), F.when(ink, F.col("confidence")).alias("confidence"), "status")
