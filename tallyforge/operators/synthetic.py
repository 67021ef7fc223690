"""Drawn jersey numbers with their labels, for training and for tests; the same index and seed give the same image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import IMAGE

#: Strokes of each digit on a board of two by four: (x0, y0, x1, y1).
_BARS = {"a": (0, 0, 2, 0), "b": (2, 0, 2, 2), "c": (2, 2, 2, 4), "d": (0, 4, 2, 4), "e": (0, 2, 0, 4), "f": (0, 0, 0, 2), "g": (0, 2, 2, 2)}
_DIGITS = ("abcdef", "bc", "abged", "abgcd", "fgbc", "afgcd", "afgedc", "abc", "abcdefg", "abcdfg")


def drawn_number(label: str, seed: int, width: int = 64, height: int = 32) -> np.ndarray:
    """A number in coloured strokes that jitter, lean and vary in width."""
    rng = np.random.default_rng([seed, len(label), *label.encode()])
    out = np.full((height, width, 3), 255, np.uint8)
    y, x = np.mgrid[:height, :width]
    color = (200, 35, 35) if rng.random() < 0.5 else (20, 60, 190)
    step, lean, thick = height / 7, rng.uniform(-0.15, 0.15), rng.uniform(1.0, 2.2)
    left = (width - step * (3.2 * len(label) - 1.2)) / 2 + rng.uniform(-3, 3)
    for k, digit in enumerate(label):
        for bar in _DIGITS[int(digit)]:
            x0, y0, x1, y1 = np.array(_BARS[bar], float) + rng.uniform(-0.15, 0.15, 4)
            ends = [(left + step * (3.2 * k + u) - lean * step * v, height / 2 + step * (v - 2) * 1.3) for u, v in ((x0, y0), (x1, y1))]
            (ax, ay), (bx, by) = ends
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / max((bx - ax) ** 2 + (by - ay) ** 2, 1e-9), 0, 1)
            out[np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= thick] = color
    return out


def numbers(spark: SparkSession, n: int, seed: int, partitions: int = 8) -> DataFrame:
    """(id, label, image) of n drawn numbers from 0 to 99."""

    @F.pandas_udf(IMAGE)
    def draw(label: pd.Series, at: pd.Series) -> pd.DataFrame:
        images = [drawn_number(a, int(b)) for a, b in zip(label, at, strict=True)]
        return pd.DataFrame([(i.shape[1], i.shape[0], i.tobytes()) for i in images], columns=["width", "height", "rgb"])

    rows = spark.range(0, n, 1, partitions).withColumn("label", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100)).cast("string"))
    return rows.withColumn("image", draw("label", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 31))))
