"""Recogniser candidates as arrays of struct(label, probability): constraints, writer priors and the best ten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jersey_probability

ACCEPT = 0.70


def top_ten(candidates: Column) -> Column:
    """By probability, ties in the order given."""
    keyed = F.transform(candidates, lambda c, i: F.struct((-c["probability"]).alias("p"), i.alias("i"), c["label"].alias("label")))
    return F.transform(F.slice(F.array_sort(keyed), 1, 10), lambda c: F.struct(c["label"].alias("label"), (-c["p"]).alias("probability")))


def normalised(candidates: Column) -> Column:
    total = F.aggregate(candidates, F.lit(0.0), lambda s, c: s + F.greatest(c["probability"], F.lit(0.0)))
    return F.when(total > 0, F.transform(candidates, lambda c: F.struct(c["label"].alias("label"), (F.greatest(c["probability"], F.lit(0.0)) / total).alias("probability"))))


def constrained(rows: DataFrame, candidates: str = "candidates", allowed: str = "allowed") -> DataFrame:
    """Adds value, value_confidence and value_status of the candidates among the allowed labels."""
    kept = normalised(F.filter(candidates, lambda c: F.array_contains(allowed, c["label"])))
    r = rows.withColumn("ranked", top_ten(kept))
    best = F.when(F.size("ranked") > 0, F.element_at("ranked", 1))
    p = F.coalesce(best["probability"], F.lit(0.0))
    # The confidence that is told is rounded, halves to even; what is accepted is not.
    status = F.when(best.isNotNull() & (p >= ACCEPT), "accepted").otherwise("review")
    return r.withColumn("value", best["label"]).withColumn("value_status", status).withColumn("value_confidence", F.bround(p, 4))


def reweighted(candidates: Column, priors: Column, samples: Column) -> Column:
    """Probabilities moved towards a writer's label priors, by at most 0.3, in full from 100 samples on."""
    w = F.least(F.lit(0.30), F.lit(0.30) * samples / 100)
    moved = F.transform(candidates, lambda c: F.struct(c["label"].alias("label"), (c["probability"] * ((1 - w) + w * F.greatest(F.coalesce(F.try_element_at(priors, c["label"]), F.lit(0.0)), F.lit(1e-4)))).alias("probability")))
    return F.when(F.coalesce(samples, F.lit(0)) > 0, normalised(moved)).otherwise(candidates)


def profiled(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Rows of constrained with the document's writer priors applied to what was ranked; without priors, samples or candidates nothing changes.

    priors: (document_id, label_priors map<string,double>, sample_count).
    """
    r = rows.join(priors.select("document_id", "label_priors", "sample_count"), "document_id", "left")
    moves = (F.coalesce("sample_count", F.lit(0)) > 0) & (F.size("ranked") > 0)
    r = r.withColumn("moved", F.when(moves, top_ten(reweighted(F.col("ranked"), F.col("label_priors"), F.col("sample_count")))))
    best = F.try_element_at("moved", F.lit(1))
    some = best.isNotNull()
    r = r.withColumn("value", F.when(some, best["label"]).otherwise(F.col("value"))).withColumn("value_status", F.when(some, F.when(best["probability"] >= ACCEPT, "accepted").otherwise("review")).otherwise(F.col("value_status")))
    r = r.withColumn("value_confidence", F.when(some, F.bround(best["probability"], 4)).otherwise(F.col("value_confidence"))).withColumn("ranked", F.coalesce("moved", "ranked"))
    return r.drop("moved", "label_priors", "sample_count")


def top_of_slots(first: Column, second: Column, allowed: Column) -> Column:
    """Candidates of the allowed jersey numbers: products of two slots' digit probabilities, as shares of their sum, the ten best."""
    digits = F.filter(allowed, lambda a: a.rlike("^[0-9]{1,2}$"))
    return top_ten(normalised(F.transform(digits, lambda a: F.struct(a.alias("label"), jersey_probability(first, second, a).alias("probability")))))
