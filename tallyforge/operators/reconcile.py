"""Reconciling events with rosters, fouls and written scores, and rolling them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import foul_symbol, severity, status_of
from .ordered import SIDE, with_jumps


def event_status(events: DataFrame, players: DataFrame, keys=SIDE) -> DataFrame:
    """Adds final_status: ambiguous, then missing jersey, unknown player, missing period, jump, else as it was.

    And warnings: what an event is doubted for, in the order jump, period, jersey or roster; an ambiguous one for that alone.
    """
    roster = players.select(*keys, "jersey").distinct().withColumn("on_roster", F.lit(True))
    e = with_jumps(events, keys).join(roster, [*keys, "jersey"], "left")
    ambiguous = ~F.col("counts")
    final = (
        F.when(ambiguous, "review").when(F.col("jersey").isNull(), "unresolved").when(F.col("on_roster").isNull(), "review")
        .when(F.col("period").isNull(), "unresolved").when(F.col("jump"), "review").otherwise(F.col("status"))
    )
    # The texts of the warnings.
    say = lambda form, *args: F.format_string("Score %d: " + form, F.col("running_score"), *args)
    off = F.when(F.col("jersey").isNull(), say("jersey is unresolved")).when(F.col("on_roster").isNull(), say("jersey %d is not in the supplied roster", F.col("jersey")))
    said = F.when(ambiguous, F.array(say("ambiguous shot type"))).otherwise(
        F.array_compact(F.array(
            F.when(F.col("jump"), say("jump of %d is incompatible with a %d-point event", F.col("delta"), F.col("points"))),
            F.when(F.col("period").isNull(), say("period is unresolved")), off)))
    return e.withColumn("ambiguous", ambiguous).withColumn("final_status", final).withColumn("warnings", said).drop("counts")


def box_score(events: DataFrame, players: DataFrame, keys=SIDE) -> DataFrame:
    """Points and made shots of each player, from events that count; players without any have zeros."""
    e = events.filter((F.col("points") > 0) & (F.col("shot_type") != "ambiguous"))
    made = lambda kind: F.count_if(F.col("shot_type") == kind).alias(f"{kind}s")
    got = e.groupBy(*keys, "jersey").agg(F.sum("points").alias("points"), made("free_throw"), made("two_point"), made("three_point"))
    cols = ["points", "free_throws", "two_points", "three_points"]
    return players.join(got, [*keys, "jersey"], "left").select(*keys, "jersey", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])


def period_scores(events: DataFrame, keys=SIDE) -> DataFrame:
    """Points by period, of events with a period that are not ambiguous."""
    e = events.filter(F.col("period").isNotNull() & (F.col("points") > 0) & (F.col("shot_type") != "ambiguous"))
    return e.groupBy(*keys, "period").agg(F.sum("points").cast("long").alias("score"))


def period_spine(scores: DataFrame, written: DataFrame, sides: DataFrame, keys=SIDE) -> DataFrame:
    """Periods 1 to 4 or to the last with points, zero filled, beside the written ones; without a written one unresolved.

    Points, written rows and sides meet in one aggregate of a side's few periods. Written periods beyond the spine are dropped.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = scores.select(*keys, F.col("period").cast("long").alias("period"), F.col("score").cast("long").alias("score"), none("long").alias("written"), none("string").alias("s"))
    rows = rows.unionByName(written.select(*keys, F.col("period").cast("long").alias("period"), none("long").alias("score"), F.col("value").cast("long").alias("written"), F.col("status").alias("s")))
    if sides is not written:  # else its rows name the sides
        rows = rows.unionByName(sides.select(*keys, none("long").alias("period"), none("long").alias("score"), none("long").alias("written"), none("string").alias("s")))
    one = rows.groupBy(*keys, "period").agg(F.max("score").alias("score"), F.max(F.struct(F.col("s").isNotNull().alias("is"), "written", "s")).alias("w"))
    by = one.groupBy(*keys).agg(F.max(F.when(F.col("score").isNotNull(), F.col("period"))).alias("last"), F.map_from_entries(F.collect_list(F.when(F.col("period").isNotNull(), F.struct("period", F.struct("score", "w"))))).alias("m"))
    last = F.greatest(F.lit(4).cast("long"), F.coalesce("last", F.lit(4).cast("long")))
    out = by.select(*keys, "m", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("period")).withColumn("x", F.try_element_at("m", F.col("period")))
    return out.select(*keys, "period", F.coalesce("x.score", F.lit(0)).cast("long").alias("score"), F.col("x.w.written").alias("written"), F.coalesce("x.w.s", F.lit("unresolved")).alias("status"), F.when(F.col("period") > 4, "overtime").otherwise("regular").alias("kind"))


def calculated_scores(events: DataFrame, keys=SIDE) -> DataFrame:
    """All points, whatever their period or jersey."""
    return events.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("points") > 0, F.col("points"))), F.lit(0)).cast("long").alias("calculated"))


def derived_fouls(fouls: DataFrame, keys=SIDE) -> DataFrame:
    """Team fouls by period from individual symbols that count."""
    return fouls.withColumn("f", foul_symbol(F.col("symbol"))).filter(F.col("f.counts") & F.col("period").isNotNull()).groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("fouls"))


def team_foul_boxes(cells: DataFrame, keys=(*SIDE, "period")) -> DataFrame:
    """The last marked box is the count; gaps before it or doubt after it ask for review; confidence is the least."""
    last = F.coalesce(F.max(F.when(F.col("kind") == "x", F.col("slot"))), F.lit(0)).cast("long")
    g = cells.groupBy(*keys).agg(last.alias("x_count"), F.count_if(F.col("kind") == "x").alias("marked"), F.max(F.when(F.col("kind") == "ambiguous", F.col("slot"))).alias("doubt"), F.min("confidence").alias("confidence"))
    review = (F.col("marked") < F.col("x_count")) | F.coalesce(F.col("doubt") > F.col("x_count"), F.lit(False))
    return g.select(*keys, "x_count", review.alias("review"), (F.col("x_count") == 4).alias("capped"), "confidence")


def foul_mismatches(boxes: DataFrame, derived: DataFrame, keys=(*SIDE, "period")) -> DataFrame:
    """Periods whose boxes disagree with the individual fouls: four boxes mean four or more."""
    j = boxes.join(derived, list(keys), "left").withColumn("fouls", F.coalesce("fouls", F.lit(0)).cast("long"))
    return j.filter(F.when(F.col("x_count") == 4, F.col("fouls") < 4).otherwise(F.col("fouls") != F.col("x_count"))).select(*keys, "x_count", "fouls")


def assigned_fouls(players: DataFrame, fouls: DataFrame, keys=SIDE) -> DataFrame:
    """Fouls or terminals of listed players, with the row of the last player of that jersey; others are dropped."""
    last = players.groupBy(*keys, "jersey").agg(F.max("row_no").alias("row_no"))
    return fouls.join(last, [*keys, "jersey"])


def starters_warnings(players: DataFrame, keys=SIDE) -> DataFrame:
    """Sides without exactly five starters."""
    return players.groupBy(*keys).agg(F.count_if("starter").alias("starters")).filter("starters <> 5")


def validation_warnings(teams: DataFrame, players: DataFrame, fouls: DataFrame, events: DataFrame, periods: DataFrame, keys=SIDE) -> DataFrame:
    """(keys, ord, code, text): what a side's parts contradict, in the order of the rules.

    teams: written_final; players: row_no, jersey, participated, starter, points; fouls: jersey; events: points; periods: period, score,
    written. Rules 1 to 5: not five starters; a starter, then a scorer or fouler, without participation; points that do not add up
    to the calculated score; that against the written one; a period against its written one.
    """
    k = list(keys)
    row = lambda no, at, code, text: (F.struct(F.lit(no).alias("rule"), at.cast("long").alias("place")).alias("ord"), F.lit(code).alias("code"), text.alias("text"))
    # The texts of the warnings.
    by_player = players.join(fouls.select(*keys, "jersey").distinct().withColumn("fouled", F.lit(True)), [*k, "jersey"], "left")
    totals = events.groupBy(*k).agg(F.sum("points").cast("long").alias("event_score"), F.coalesce(F.sum(F.when(F.col("points") > 0, F.col("points"))), F.lit(0)).cast("long").alias("positive"))
    t = teams.join(players.groupBy(*k).agg(F.count_if("starter").alias("starters")), k, "left").join(totals, k, "left")
    t = t.withColumn("starters", F.coalesce("starters", F.lit(0))).withColumn("calculated", F.coalesce("positive", F.lit(0)))
    zero = F.lit(0)
    parts = [
        t.filter("starters <> 5").select(*k, *row(1, zero, "starters", F.format_string("Detected %d starters; expected 5", F.col("starters")))),
        by_player.filter("starter and not participated").select(*k, *row(2, F.col("row_no") * 2, "starter_absent", F.format_string("Jersey %d: starter without participation", F.col("jersey")))),
        by_player.filter("(coalesce(points, 0) > 0 or fouled) and not participated").select(*k, *row(2, F.col("row_no") * 2 + 1, "event_absent", F.format_string("Jersey %d: has a game event without a participation mark", F.col("jersey")))),
        t.filter("event_score <> calculated").select(*k, *row(3, zero, "event_score", F.format_string("Event score (%d) differs from calculated score (%d)", F.col("event_score"), F.col("calculated")))),
        t.filter("written_final <> calculated").select(*k, *row(4, zero, "final_score", F.format_string("Calculated score (%d) differs from written score (%d)", F.col("calculated"), F.col("written_final")))),
        periods.filter("written <> score").select(*k, *row(5, F.col("period"), "period_score", F.format_string("Q%d: calculated period score (%d) differs from written score (%d)", F.col("period"), F.col("score"), F.col("written")))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def side_warnings(statused: DataFrame, mismatches: DataFrame, validation: DataFrame, keys=SIDE) -> DataFrame:
    """(keys, warnings): texts of one side in order: events by score, then team fouls by period, then the rules of validation_warnings."""
    k = list(keys)
    at = lambda no, *by: F.array(F.lit(no).cast("long"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) for c in by])
    a = statused.select(*k, "running_score", "seq", F.posexplode("warnings").alias("i", "text")).select(*k, at(0, "running_score", "seq", "i").alias("at"), "text")
    said = F.format_string("Q%d: derived team fouls (%d) differ from the X boxes (%d)", F.col("period"), F.col("fouls"), F.col("x_count"))
    b = mismatches.select(*k, at(1, "period").alias("at"), said.alias("text"))
    c = validation.select(*k, at(2, "ord.rule", "ord.place").alias("at"), "text")
    rows = a.unionByName(b).unionByName(c)
    return rows.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("warnings"))


def team_status(sides: DataFrame, warnings: DataFrame, fields: DataFrame, keys=SIDE) -> DataFrame:
    """(keys, status): review with any warning, else accepted; then only raised by what the side's core fields lack."""
    k = list(keys)
    worst = fields.groupBy(*k).agg(F.max(severity(F.col("status"))).alias("worst"))
    t = sides.select(*k).distinct().join(warnings, k, "left").join(worst, k, "left")
    warned = F.when(F.coalesce(F.size("warnings"), F.lit(0)) > 0, 1).otherwise(0)
    return t.select(*k, status_of(F.greatest(warned, F.coalesce("worst", F.lit(0)))).alias("status"))


def document_warnings(warnings: DataFrame) -> DataFrame:
    """(document_id, warnings): those of all sides, in order of sides, each with its side's name before it."""
    named = warnings.select("document_id", "side", F.transform("warnings", lambda w: F.concat(F.lit("Team "), F.col("side"), F.lit(": "), w)).alias("w"))
    return named.groupBy("document_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("side", "w"))), lambda x: x["w"])).alias("warnings"))


def worst_status(rows: DataFrame, keys: tuple[str, ...], status: str = "status") -> DataFrame:
    """The worst status of each key."""
    return rows.groupBy(*keys).agg(status_of(F.max(severity(F.col(status)))).alias("status"), F.count(F.lit(1)).alias("n"))
