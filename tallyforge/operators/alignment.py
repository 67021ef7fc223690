"""Reviewed labels beside what was read: one prediction row for each labelled field, and labels for crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import prediction_row
from .ordered import SIDE


def _last(rows: DataFrame, keys: tuple[str, ...], *values: str, by: str = "seq") -> DataFrame:
    """Of rows that share keys the last by `by`, as struct p; without such a column any, as keys are then unique."""
    order = F.struct(by) if by in rows.columns else F.struct(F.lit(0))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("p"))


def _quarter(period: Column) -> Column:
    return F.when(period.isNotNull(), F.concat(F.lit("Q"), period.cast("string")))


def _fields(joined: DataFrame, *fields: tuple[Column, str, Column, Column, Column]) -> DataFrame:
    """Rows of (field_id, field_type, expected, predicted, confidence); several fields of a row are exploded from one join."""
    rows = [F.struct(i.alias("field_id"), F.lit(t).alias("field_type"), *prediction_row(e, p, c)) for i, t, e, p, c in fields]
    return joined.select("document_id", F.inline(F.array(*rows)))


def _id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def roster_fields(truth: DataFrame, read: DataFrame) -> DataFrame:
    """truth: (document_id, side, row_no, jersey), rows from 1; read: the same with confidence."""
    j = truth.join(_last(read, (*SIDE, "row_no"), "jersey", "confidence"), [*SIDE, "row_no"], "left")
    return _fields(j, (_id("roster", F.col("side"), F.col("row_no")), "roster_jersey", F.col("jersey"), F.col("p.jersey"), F.col("p.confidence")))


def scoring_fields(truth: DataFrame, read: DataFrame) -> DataFrame:
    """truth: (document_id, side, running_score, points, period as Q1.., jersey); read: events with seq, a number as period, confidence and jersey_confidence.

    Every labelled event has its points and period, and its jersey if one is labelled; what was read beside them counts for nothing.
    """
    j = truth.join(_last(read, (*SIDE, "running_score"), "points", "period", "jersey", "confidence", "jersey_confidence"), [*SIDE, "running_score"], "left")
    at = lambda what: _id("scoring", F.col("side"), F.col("running_score"), what)
    both = _fields(
        j, (at("points"), "scoring_points", F.col("points"), F.col("p.points"), F.col("p.confidence")), (at("period"), "scoring_period", F.col("period"), _quarter(F.col("p.period")), F.col("p.confidence")),
        (at("jersey"), "scoring_jersey", F.col("jersey"), F.col("p.jersey"), F.col("p.jersey_confidence")))
    return both.filter("field_type <> 'scoring_jersey' or expected is not null")


def period_fields(truth: DataFrame, read: DataFrame) -> DataFrame:
    """truth: (document_id, side, period, score); read: (period, score, candidate, confidence). The calculated score takes the written cell's confidence."""
    j = truth.join(_last(read, (*SIDE, "period"), "score", "candidate", "confidence"), [*SIDE, "period"], "left")
    at = lambda what: _id(what, F.col("side"), _quarter(F.col("period")))
    return _fields(
        j, (at("period_score"), "period_score", F.col("score"), F.col("p.score"), F.col("p.confidence")), (at("written_period_score"), "written_period_score", F.col("score"), F.col("p.candidate"), F.col("p.confidence")))


def final_fields(truth: DataFrame, events: DataFrame, written: DataFrame) -> DataFrame:
    """truth: (document_id, side, score); events: points and confidence; written: (candidate, confidence).

    The calculated score is never missing: without events it is 0, at confidence 0; else it has that of its least certain event.
    """
    e = events.groupBy(*SIDE).agg(F.sum(F.when(F.col("points") > 0, F.col("points"))).alias("calculated"), F.min(F.coalesce("confidence", F.lit(0.0))).alias("least"))
    j = truth.join(e, list(SIDE), "left").join(_last(written, SIDE, "candidate", "confidence"), list(SIDE), "left")
    return _fields(
        j, (_id("final_score", F.col("side")), "final_score", F.col("score"), F.coalesce("calculated", F.lit(0)), F.col("least")),
        (_id("written_final_score", F.col("side")), "written_final_score", F.col("score"), F.col("p.candidate"), F.col("p.confidence")))


def team_foul_fields(truth: DataFrame, read: DataFrame) -> DataFrame:
    """truth: (document_id, side, period, fouls); read: (period, x_count, confidence)."""
    j = truth.join(_last(read, (*SIDE, "period"), "x_count", "confidence"), [*SIDE, "period"], "left")
    return _fields(j, (_id("team_fouls", F.col("side"), _quarter(F.col("period"))), "team_fouls", F.col("fouls"), F.col("p.x_count"), F.col("p.confidence")))


def foul_fields(truth: DataFrame, read: DataFrame) -> DataFrame:
    """truth: (document_id, side, jersey, slot, period as Q1.., symbol); read: (jersey, slot, symbol, a number as period, confidence)."""
    j = truth.join(_last(read, (*SIDE, "jersey", "slot"), "symbol", "period", "confidence"), [*SIDE, "jersey", "slot"], "left")
    at = lambda what: _id("individual_foul", F.col("side"), F.col("jersey"), F.col("slot"), what)
    return _fields(
        j, (at("symbol"), "individual_foul_symbol", F.col("symbol"), F.col("p.symbol"), F.col("p.confidence")), (at("period"), "individual_foul_period", F.col("period"), _quarter(F.col("p.period")), F.col("p.confidence")))


def labelled_crops(crops: DataFrame, scoring: DataFrame, fouls: DataFrame) -> DataFrame:
    """crops(document_id, side, field_type, running_score, jersey, slot, ...) with label: the scorer of a scoring crop, the symbol of a foul crop, null where none is labelled."""
    s = scoring.groupBy(*SIDE, "running_score").agg(F.max(F.col("jersey").cast("string")).alias("_scorer"))
    f = fouls.groupBy(*SIDE, "jersey", "slot").agg(F.max("symbol").alias("_symbol"))
    j = crops.join(s, [*SIDE, "running_score"], "left").join(f, [*SIDE, "jersey", "slot"], "left")
    label = F.when(F.col("field_type").isin("jersey", "scoring_event"), F.col("_scorer")).when(F.col("field_type").isin("foul_symbol", "foul_event"), F.col("_symbol"))
    return j.select(*crops.columns, label.alias("label"))
