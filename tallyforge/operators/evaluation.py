"""Labels against predictions: metrics at a threshold, threshold sweeps and slices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Above every confidence.
REVIEW_ALL = math.nextafter(1.0, 2.0)


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metric_columns(threshold: Column) -> list[Column]:
    """Total, accepted, reviewed, errors and rates; a missing prediction is never accepted and never right."""
    accepted = F.col("predicted").isNotNull() & (F.col("confidence") >= threshold)
    right = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    total, n, wrong = F.count(F.lit(1)), F.count_if(accepted), F.count_if(accepted & ~right)
    return [
        total.alias("total"), n.alias("accepted"), (total - n).alias("reviewed"), wrong.alias("errors"), _rate(n.cast("double"), total).alias("automation"),
        _rate(wrong.cast("double"), n).alias("error_rate"), _rate(F.count_if(right).cast("double"), total).alias("accuracy"), _rate((total - n).cast("double"), total).alias("review_rate"),
    ]


def metrics(predictions: DataFrame, threshold: float, *by: str) -> DataFrame:
    return predictions.groupBy(*by).agg(*metric_columns(F.lit(threshold)))


#: Bins of confidences: running sums go over a slice's bins, and within a bin over its confidences, so that no task holds a whole slice.
BINS = 1024


def sweep(predictions: DataFrame, *by: str) -> DataFrame:
    """Accepted and errors at every confidence and at 0 and 1: one aggregate, and running sums over bins and within them."""
    ok = F.col("predicted").isNotNull()
    right = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    each = predictions.groupBy(*by, F.col("confidence").alias("threshold")).agg(F.count_if(ok).alias("a"), F.count_if(ok & ~right).alias("e"), F.count(F.lit(1)).alias("t"))
    slices = predictions.select(*by).distinct() if by else predictions.sparkSession.range(1).select()
    ends = slices.withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).select(*by, "threshold", *[F.lit(0).cast("long").alias(c) for c in "aet"])
    grid = each.unionByName(ends).groupBy(*by, "threshold").agg(*[F.sum(c).alias(c) for c in "aet"]).withColumn("bin", F.floor(F.col("threshold") * BINS))
    above = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = grid.groupBy(*by, "bin").agg(*[F.sum(c).alias("b" + c) for c in "aet"])
    bins = bins.select(*by, "bin", *[F.coalesce(F.sum("b" + c).over(above), F.lit(0)).alias(c + "0") for c in "ae"], F.sum("bt").over(Window.partitionBy(*by)).alias("total"))
    down = Window.partitionBy(*by, "bin").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(bins, [*by, "bin"]).select(*by, "threshold", (F.col("a0") + F.sum("a").over(down)).alias("accepted"), (F.col("e0") + F.sum("e").over(down)).alias("errors"), "total")


def chosen_threshold(swept: DataFrame, max_error: float, min_automation: float, *by: str) -> DataFrame:
    """Of thresholds within both gates, most automation, then least error, then the lowest; else all go to review."""
    automation, error = F.col("accepted") / F.col("total"), _rate(F.col("errors").cast("double"), F.col("accepted"))
    s = swept.withColumn("automation", automation).withColumn("error_rate", error)
    fits = (F.col("automation") >= min_automation) & (F.col("error_rate") <= max_error)
    best = F.max(F.when(fits, F.struct(F.col("automation"), (-F.col("error_rate")).alias("e"), (-F.col("threshold")).alias("t"))))
    return s.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b").isNotNull().alias("found"), F.coalesce(-F.col("b.t"), F.lit(REVIEW_ALL)).alias("threshold"))


def sliced(predictions: DataFrame, threshold: float, by_field_type: DataFrame | None = None) -> DataFrame:
    """The same metrics over all, by field type, by capture, and by both writer flags, in one pass of grouping sets.

    by_field_type: (field_type, threshold), the thresholds chosen for each field type, which its own slice is measured at; the other
    slices take the one threshold. Both values of the writer flags are there, also without rows.
    """
    p = predictions.withColumn("known", F.when(F.col("writer_known"), "yes").otherwise("no")).withColumn("seen", F.when(F.col("writer_seen"), "yes").otherwise("no"))
    if by_field_type is not None:
        p = p.join(by_field_type.select("field_type", F.col("threshold").alias("own")), "field_type", "left")
    else:
        p = p.withColumn("own", F.lit(threshold))
    g = p.groupingSets([[], ["field_type"], ["capture"], ["known"], ["seen"]], "field_type", "capture", "known", "seen")
    every, own = metric_columns(F.lit(threshold)), metric_columns(F.col("own"))
    g = g.agg(F.grouping_id().alias("gid"), F.struct(*every).alias("m"), F.struct(*own).alias("o"))
    kind = F.when(F.col("gid") == 15, "all").when(F.col("gid") == 7, "field_type").when(F.col("gid") == 11, "capture").when(F.col("gid") == 13, "writer_known").otherwise("writer_seen")
    g = g.select(kind.alias("slice"), F.coalesce("field_type", "capture", "known", "seen", F.lit("*")).alias("value"), F.when(F.col("gid") == 7, F.col("o")).otherwise(F.col("m")).alias("m"))
    fixed = predictions.sparkSession.createDataFrame([(a, b) for a in ("writer_known", "writer_seen") for b in ("yes", "no")], "slice string, value string")
    none = fixed.join(F.broadcast(g.filter("slice like 'writer%'").select("slice", "value")), ["slice", "value"], "left_anti")
    names = ("total", "accepted", "errors", "automation", "error_rate", "accuracy")
    zeros = [F.lit(0).cast(g.schema["m"].dataType[n].dataType).alias(n) for n in names]
    return g.select("slice", "value", *[F.col(f"m.{n}").alias(n) for n in names]).unionByName(none.select("slice", "value", *zeros))


def by_writer(predictions: DataFrame, threshold: float) -> DataFrame:
    """(writer, metrics): known_writer and unknown_writer, both always there."""
    keys = predictions.sparkSession.createDataFrame([("known_writer",), ("unknown_writer",)], "writer string")
    p = predictions.withColumn("writer", F.when(F.col("writer_known"), "known_writer").otherwise("unknown_writer"))
    got = metrics(p, threshold, "writer")
    return keys.join(got, "writer", "left").select("writer", *[F.coalesce(F.col(f.name), F.lit(0)).cast(f.dataType).alias(f.name) for f in got.schema if f.name != "writer"])


def decision_states(predictions: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Accepted, to review, without a candidate, and how many have one."""
    has = F.col("predicted").isNotNull()
    return predictions.groupBy(*by).agg(
        F.count_if(has & (F.col("confidence") >= threshold)).alias("accepted"), F.count_if(has & ~(F.col("confidence") >= threshold)).alias("review"),
        F.count_if(~has).alias("unresolved"), _rate(F.count_if(has).cast("double"), F.count(F.lit(1))).alias("coverage"))


def aligned(truth: DataFrame, predicted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Truth with the last prediction (by seq) of its key; a miss has no value and confidence 0."""
    last = predicted.groupBy(*keys).agg(F.max_by(F.struct("value", "confidence"), "seq").alias("p"))
    return truth.join(last, list(keys), "left").select(*truth.columns, F.col("p.value").alias("predicted"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.confidence", F.lit(0.0)))).alias("confidence"))
