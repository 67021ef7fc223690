"""Shape statistics over a table of ink pixels (cell, x, y)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elongation(pixels: DataFrame, key: str = "cell") -> DataFrame:
    """Root of the ratio of the covariance's eigenvalues, from integer moments; null below two pixels or on a line."""
    m = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    a, b, c = (F.col("n") * F.col(p) - F.col(q) * F.col(r) for p, q, r in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    trace, det = (a + b).cast("double"), (a * b - c * c).cast("double")
    root = F.sqrt(F.greatest(trace * trace - 4 * det, F.lit(0.0)))
    return m.select(key, "n", F.when((F.col("n") > 1) & (det > 0), F.sqrt((trace + root) / (trace - root))).alias("elongation"))


def angular_coverage(pixels: DataFrame, cx: float, cy: float, low: float, high: float, bins: int = 24, key: str = "cell") -> DataFrame:
    """Share of angle bins that have ink in a ring about a centre."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    r = F.sqrt(dx * dx + dy * dy)
    bin_no = F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * bins) % bins
    return pixels.filter((r >= low) & (r <= high)).groupBy(key).agg((F.count_distinct(bin_no) / bins).alias("coverage"))
