"""The form's geometry as small tables: regions, cells of scores, points and team fouls. Each is made from constants on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The canonical page in pixels, and each region's left, top, width and height in shares of it.
PAGE = (2480, 3508)
REGIONS = {
    "team_a_roster": (0.000, 0.212, 0.492, 0.232),
    "team_a_jersey": (0.320, 0.212, 0.042, 0.232),
    "team_a_participation": (0.362, 0.212, 0.022, 0.232),
    "team_a_player_fouls": (0.384, 0.212, 0.108, 0.232),
    "team_a_team_fouls": (0.276, 0.166, 0.216, 0.045),
    "team_b_roster": (0.000, 0.561, 0.492, 0.222),
    "team_b_jersey": (0.320, 0.561, 0.042, 0.222),
    "team_b_participation": (0.362, 0.561, 0.022, 0.222),
    "team_b_player_fouls": (0.384, 0.561, 0.108, 0.222),
    "team_b_team_fouls": (0.276, 0.466, 0.216, 0.045),
    "scoring_table": (0.511, 0.151, 0.489, 0.645),
    "period_scores": (0.000, 0.783, 0.492, 0.060),
    "final_score": (0.511, 0.783, 0.489, 0.060),
    "apontador": (0.000, 0.843, 0.492, 0.023),
}
# Within period_scores, left and width of each side's cells in the left and right half, top and height of both rows; within final_score, each side's cell.
PERIOD_COLUMNS = {("A", 0): (0.245, 0.080), ("B", 0): (0.345, 0.080), ("A", 1): (0.690, 0.090), ("B", 1): (0.820, 0.090)}
PERIOD_ROWS = ((0.22, 0.30), (0.53, 0.32))
FINAL_CELLS = {"A": (0.450, 0.18, 0.140, 0.38), "B": (0.650, 0.18, 0.140, 0.38)}
# Panels and rows of the points' grid, its header, and where a panel's columns end; of the team fouls, left of both groups, their width, top of both rows, their height.
PANELS, ROWS, HEADER, ENDS = 4, 40, 0.047, (0.265, 0.505, 0.745, 1.0)
GROUP_LEFT, GROUP_WIDTH, ROW_TOP, ROW_HEIGHT = (0.045, 0.615), 0.385, (0.18, 0.61), 0.34

RECT = "x double, y double, width double, height double"


def template(spark: SparkSession) -> DataFrame:
    """(region, x, y, width, height)"""
    return spark.createDataFrame([(k, *v) for k, v in REGIONS.items()], f"region string, {RECT}")


def period_score_cells(spark: SparkSession) -> DataFrame:
    """(side, period, x, y, width, height) within the region of period scores."""
    rows = [(side, 2 * row + half + 1, x, PERIOD_ROWS[row][0], w, PERIOD_ROWS[row][1]) for (side, half), (x, w) in PERIOD_COLUMNS.items() for row in (0, 1)]
    return spark.createDataFrame(rows, f"side string, period int, {RECT}")


def final_score_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in FINAL_CELLS.items()], f"side string, {RECT}")


def scoring_cells(spark: SparkSession) -> DataFrame:
    """(side, running_score, part, x, y, width, height) of the 160 rows within the table of points: of each side the score's cell and the jersey's."""
    parts = spark.createDataFrame([("A", "jersey", 0.0, ENDS[0]), ("A", "score", ENDS[0], ENDS[1]), ("B", "score", ENDS[1], ENDS[2]), ("B", "jersey", ENDS[2], ENDS[3])], "side string, part string, a double, b double")
    rows = spark.range(PANELS * ROWS).select((F.col("id") + 1).alias("running_score"), F.floor(F.col("id") / ROWS).alias("panel"), (F.col("id") % ROWS).alias("line"), F.lit(1).alias("one"))
    step = (1 - HEADER) / ROWS
    j = rows.join(F.broadcast(parts.withColumn("one", F.lit(1))), "one")
    return j.select("side", "running_score", "part", ((F.col("panel") + F.col("a")) / PANELS).alias("x"), (F.col("line") * step + HEADER).alias("y"), ((F.col("b") - F.col("a")) / PANELS).alias("width"), F.lit(step).alias("height"))


def team_foul_cells(spark: SparkSession) -> DataFrame:
    """(period, slot, x, y, width, height) of the 16 boxes within a side's region of team fouls."""
    w = GROUP_WIDTH / 4
    return spark.createDataFrame([(2 * r + g + 1, k + 1, GROUP_LEFT[g] + k * w, ROW_TOP[r], w, ROW_HEIGHT) for r in (0, 1) for g in (0, 1) for k in range(4)], f"period int, slot int, {RECT}")
