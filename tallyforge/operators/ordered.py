"""Ordered operators: window forms of the ledger's state machines. Keys default to a document's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDE = ("document_id", "side")


def plausible_sequence(events: DataFrame, keys=SIDE) -> DataFrame:
    """Events whose score does not rise by 1 to 3, or by other than their points, go to review at confidence 0.69 or less."""
    w = Window.partitionBy(*keys).orderBy("running_score", "seq")
    delta = F.col("running_score") - F.lag("running_score", 1, 0).over(w)
    odd = ~delta.between(1, 3) | ((F.col("points") > 0) & (F.col("points") != delta))
    return events.withColumn("delta", delta).withColumn("status", F.when(odd, "review").otherwise(F.col("status"))).withColumn(
        "confidence", F.when(odd, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.69))).otherwise(F.col("confidence")))


def color_run_periods(events: DataFrame, keys=SIDE) -> DataFrame:
    """Adds period: the number of the ink-colour run, starting at 2 if blue comes first; past the fourth only blue stays."""
    by = Window.partitionBy(*keys).orderBy("running_score", "seq")
    here, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    ink = F.when(F.col("ink_color").isin("red", "blue"), F.col("ink_color"))
    e = events.withColumn("ink", ink)
    e = e.withColumn("prev", F.last("ink", ignorenulls=True).over(before)).withColumn("lead", F.first("ink", ignorenulls=True).over(here))
    new = F.col("ink").isNotNull() & (F.col("prev").isNull() | (F.col("prev") != F.col("ink")))
    e = e.withColumn("run", F.sum(new.cast("int")).over(here))
    p = F.when(F.col("lead") == "red", 1).otherwise(2) + F.col("run") - 1
    period = F.when(F.col("ink").isNotNull(), F.when(p <= 4, p).when(F.col("ink") == "blue", 4))
    return e.withColumn("period", period.cast("long")).withColumn("status", F.when(F.col("period").isNull(), "review").otherwise(F.col("status"))).drop("ink", "prev", "lead", "run")


def with_jumps(events: DataFrame, keys=SIDE) -> DataFrame:
    """Adds counts, and for events that count (points, not ambiguous) the rise over the last one that does, and whether it is a jump; one window."""
    before = Window.partitionBy(*keys).orderBy("running_score", "seq").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("counts", F.coalesce((F.col("points") > 0) & (F.col("shot_type") != "ambiguous"), F.lit(False)))
    last = F.coalesce(F.max(F.when(F.col("counts"), F.col("running_score"))).over(before), F.lit(0))
    e = e.withColumn("delta", F.when(F.col("counts"), F.col("running_score") - last))
    return e.withColumn("jump", F.col("delta") != F.col("points"))


def reconcile_delta(events: DataFrame, keys=SIDE) -> DataFrame:
    """Of events that count: the rise over the last one that counts, and whether it is a jump."""
    return with_jumps(events, keys).filter("counts").drop("counts")


def _to_first_terminal(cells: DataFrame, terminal: str, keys) -> DataFrame:
    first = F.min(F.when(F.col("symbol") == terminal, F.col("slot"))).over(Window.partitionBy(*keys))
    return cells.withColumn("terminal_slot", first)


def stop_at_terminal(cells: DataFrame, terminal: str = "F", keys=(*SIDE, "jersey")) -> DataFrame:
    """Slots before the first terminal symbol of a row."""
    return _to_first_terminal(cells, terminal, keys).filter(F.col("terminal_slot").isNull() | (F.col("slot") < F.col("terminal_slot")))


def terminals(cells: DataFrame, terminal: str = "F", keys=(*SIDE, "jersey")) -> DataFrame:
    """The first terminal of each row that has one: it is no foul."""
    return _to_first_terminal(cells, terminal, keys).filter(F.col("slot") == F.col("terminal_slot")).drop("terminal_slot")


def recognised_rows(rows: DataFrame, threshold: float | None, keys=SIDE) -> DataFrame:
    """Roster rows (row_no, jersey, confidence, recognised) with acceptable: accepted by the recogniser and, where a threshold is given, by it."""
    ok = F.lit(False) if threshold is None else (F.col("recognised") == "accepted") & (F.col("confidence") >= threshold)
    return roster_duplicates(rows.withColumn("acceptable", F.coalesce(ok, F.lit(False)) & F.col("jersey").isNotNull()), keys)


def roster_status(sides: DataFrame, rows: DataFrame, keys=SIDE) -> DataFrame:
    """The worst row_status of each side, and its accepted jerseys in order of rows; a side without rows is unresolved."""
    worst = F.max(F.when(F.col("row_status") == "unresolved", 2).when(F.col("row_status") == "review", 1).otherwise(0))
    jerseys = F.array_sort(F.collect_list(F.when(F.col("row_status") == "accepted", F.struct("row_no", "jersey"))))
    g = rows.groupBy(*keys).agg(worst.alias("worst"), F.transform(jerseys, lambda x: x["jersey"]).alias("jerseys"))
    status = F.when(F.col("worst") == 0, "accepted").when(F.col("worst") == 1, "review").otherwise("unresolved")
    return sides.select(*keys).distinct().join(g, list(keys), "left").select(*keys, status.alias("roster_status"), F.coalesce("jerseys", F.array().cast(g.schema["jerseys"].dataType)).alias("jerseys"))


def roster_duplicates(rows: DataFrame, keys=SIDE) -> DataFrame:
    """Adds row_status: unresolved without a jersey or after an accepted row of the same one, else accepted or review."""
    w = Window.partitionBy(*keys, "jersey")
    first = F.min(F.when(F.col("acceptable"), F.col("row_no"))).over(w)
    again = F.col("jersey").isNull() | (first < F.col("row_no"))
    return rows.withColumn("row_status", F.when(F.coalesce(again, F.lit(False)), "unresolved").when(F.col("acceptable"), "accepted").otherwise("review"))


def runs(values: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Consecutive integers as (first, last, n, center), the center's halves rounded to even."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = values.select(*keys, value).distinct().withColumn("island", F.col(value) - F.row_number().over(w))
    return d.groupBy(*keys, "island").agg(F.min(value).alias("first_value"), F.max(value).alias("last_value"), F.count(F.lit(1)).alias("n"), F.bround((F.min(value) + F.max(value)) / 2, 0).cast("long").alias("center")).drop("island")


def longest_run(values: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """The length of the longest run of consecutive integers of each key."""
    return runs(values, value, keys).groupBy(*keys).agg(F.max("n").alias("longest"))


def gap_clusters(values: DataFrame, value: str, gap: float | Column, keys: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Values no further than gap from the one before share a cluster: (cluster, n, low, high, total, center).

    gap is a number, or a column where it is a share of something, such as a width. center: the mean weighted by `weight`, each of at
    least a millionth, or the median where none is given; halves are rounded to even.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    d = values.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    share = None if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    center = F.median(value) if share is None else F.sum(F.col(value) * share) / F.sum(share)
    return d.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), F.bround(center, 0).cast("long").alias("center"))


def nearest(candidates: DataFrame, predicted: DataFrame, value: str, target: str, keys: tuple[str, ...]) -> DataFrame:
    """predicted with `nearest`, the candidate of its keys at the least distance, the smaller on ties; null where there is none.

    A key's candidates are the few lines of one image: they are sorted into an array, once, before the join.
    """
    lines = candidates.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_lines"))
    best = F.array_min(F.transform("_lines", lambda x: F.struct(F.abs(x - F.col(target)).alias("d"), x.alias("v"))))["v"]
    return predicted.join(lines, list(keys), "left").withColumn("nearest", best).drop("_lines")


def first_label_slots(fouls: DataFrame, observed: DataFrame, keys=(*SIDE, "jersey")) -> DataFrame:
    """Fouls in order get slots 1, 2, ...; observed (keys, slot, symbol) take their slots instead."""
    w = Window.partitionBy(*keys).orderBy("ord")
    base = fouls.select(*keys, F.row_number().over(w).cast("long").alias("slot"), "symbol", F.lit(0).alias("rank"))
    both = base.unionByName(observed.select(*keys, F.col("slot").cast("long").alias("slot"), "symbol", F.lit(1).alias("rank")))
    return both.groupBy(*keys, "slot").agg(F.max_by("symbol", "rank").alias("symbol"))


def latest_annotation(tasks: DataFrame, array: str = "annotations") -> DataFrame:
    """Adds latest: the last element that was not cancelled."""
    live = F.filter(array, lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    return tasks.withColumn("latest", F.when(F.size(live) > 0, F.element_at(live, -1)))


def local_maxima(profile: DataFrame, least: float, keys: tuple[str, ...], reach: int = 2) -> DataFrame:
    """Positions whose value is at least `least`, above 0, and no smaller than any within reach; absent positions are 0."""
    w = Window.partitionBy(*keys).orderBy("pos").rangeBetween(-reach, reach)
    return profile.withColumn("around", F.max("value").over(w)).filter((F.col("value") >= least) & (F.col("value") >= F.col("around"))).drop("around")
