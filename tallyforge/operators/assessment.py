"""Whether the nine core fields of each side of a document were extracted, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity, status_of

SIDE = ("document_id", "side")

# The fields in their order, and the reason given for a field that is not accepted.
REASONS = {
    "name": "team name was not extracted",
    "players": "player roster is empty or contains unresolved rows",
    "participation": "one or more participation marks are unavailable or require review",
    "starters": "starter evidence requires review; detected %d starters",
    "period_scoring": "written period scores are unavailable or require review",
    "scoring_events": "one or more scoring events are unavailable or require review",
    "individual_fouls": "individual foul data is unavailable or requires review",
    "team_fouls": "team-foul indicators for all regular periods were not extracted",
    "final_score": "written final score is unavailable or requires review",
}
MISSING = "team result is missing"


def _worst(status: str) -> Column:
    return status_of(F.max(severity(F.col(status))))


def _doubted(status: Column) -> Column:
    """What rests on a candidate only is never accepted."""
    return F.when(status == "accepted", "review").otherwise(status)


def core_fields(documents: DataFrame, teams: DataFrame, players: DataFrame, fouls: DataFrame, events: DataFrame, team_fouls: DataFrame, periods: DataFrame) -> DataFrame:
    """(document_id, side, pos, path, status, reason): 18 rows for every document.

    teams: name, roster_status, final_score, final_candidate, final_status; players: participation_status, starter_status,
    starter; fouls and events: status; team_fouls: period; periods: period (unique), written, candidate, status. All but
    documents also carry document_id and side. A side without a row in teams has nine unresolved fields. Each table is
    aggregated by side before the sides are joined, all on the same keys.
    """
    keys = list(SIDE)
    by = {
        "p": players.groupBy(keys).agg(F.count(F.lit(1)).alias("n_players"), _worst("participation_status").alias("played"), _worst("starter_status").alias("started"), F.count_if("starter").alias("starters")),
        "f": fouls.groupBy(keys).agg(_worst("status").alias("fouls")),
        "e": events.groupBy(keys).agg(_worst("status").alias("scored")),
        "t": team_fouls.filter("period between 1 and 4").groupBy(keys).agg(F.expr("bit_or(shiftleft(1, cast(period as int)))").alias("periods")),
        "w": periods.filter("period between 1 and 4").groupBy(keys).agg(
            F.count("written").alias("n_written"), F.count("candidate").alias("n_candidates"), _worst("status").alias("wrote"), F.count_if(F.col("written") == 0).alias("zeros")
        ),
    }
    rows = documents.select("document_id").distinct().withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    rows = rows.join(teams.select(*keys, "name", "roster_status", "final_score", "final_candidate", "final_status", F.lit(True).alias("present")), keys, "left")
    for part in by.values():
        rows = rows.join(part, keys, "left")
    some, ok, no = F.col("n_players").isNotNull(), F.lit("accepted"), F.lit("unresolved")
    written = F.coalesce(F.col("n_written") == 4, F.lit(False))
    starters = F.coalesce("starters", F.lit(0))
    zero_game = written & (F.col("zeros") == 4) & F.coalesce(F.col("final_score") == 0, F.lit(False))
    status = {
        "name": F.when(F.col("name").isNotNull(), ok).otherwise(no),
        "players": F.when(some, F.col("roster_status")).otherwise(no),
        "participation": F.when(some, F.col("played")).otherwise(no),
        "starters": F.when(~some, no).when(starters != 5, _doubted(F.col("started"))).otherwise(F.col("started")),
        "period_scoring": F.when(written, F.col("wrote")).when(F.col("n_candidates") == 4, _doubted(F.col("wrote"))).otherwise(no),
        "scoring_events": F.coalesce("scored", F.when(zero_game, ok).otherwise(no)),
        "individual_fouls": F.when(some, F.coalesce("fouls", ok)).otherwise(no),
        "team_fouls": F.when(F.col("periods") == 30, ok).otherwise(no),
        "final_score": F.when(F.col("final_score").isNotNull(), F.col("final_status")).when(F.col("final_candidate").isNotNull(), _doubted(F.col("final_status"))).otherwise(no),
    }
    fields = []
    for k, (name, reason) in enumerate(REASONS.items()):
        s = F.when(F.col("present"), F.coalesce(status[name], no)).otherwise(no)
        why = F.format_string(reason, starters) if "%d" in reason else F.lit(reason)
        why = F.when(F.col("present").isNull(), MISSING).when(s != "accepted", why)
        fields.append(F.struct(F.lit(k + 1).cast("long").alias("pos"), F.concat(F.lit("teams."), F.col("side"), F.lit("." + name)).alias("path"), s.alias("status"), why.alias("reason")))
    return rows.select(*keys, F.inline(F.array(*fields)))


def document_status(fields: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(document_id, status, n_open): the worst status of a document's core fields, and how many are not accepted.

    warnings: (document_id, warnings); a document with any is not accepted.
    """
    out = fields.groupBy("document_id").agg(F.max(severity(F.col("status"))).alias("worst"), F.count_if(F.col("status") != "accepted").alias("n_open"))
    if warnings is not None:
        warned = warnings.filter(F.size("warnings") > 0).select("document_id", F.lit(1).alias("warned"))
        out = out.join(warned, "document_id", "left").withColumn("worst", F.greatest("worst", F.coalesce("warned", F.lit(0))))
    return out.select("document_id", status_of(F.col("worst")).alias("status"), "n_open")
