"""Connected components of an edge table by alternating hooking and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written

#: Parts that the nodes of one label are dealt in where they look up the label's own label.
SALTS = 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Nodes without an edge are absent.

    Each round gives a node the smallest label among its own and its neighbours', then the label's label, until
    nothing changes; chains halve, so rounds grow with the logarithm of a component's diameter. Every round is
    written to the shared folder. A hot node is a partial aggregate on one side and a splittable join on the other; the nodes
    of a hot label look its label up in SALTS parts, to which only labels that point further are copied.
    """
    both = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "cc-edges"
    )
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "cc")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("m"))
        hooked = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("next"))
        hooked = written(hooked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "cc-hooked")
        # Nodes that are some node's label and have a smaller one themselves.
        further = hooked.select(F.col("next").alias("node")).distinct().join(hooked.filter(F.col("next") < F.col("node")).select("node", F.col("next").alias("beyond")), "node")
        jump = further.select(F.col("node").alias("next"), "beyond", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        nxt = written(hooked.join(jump, ["next", "salt"], "left").select("node", "old", F.least("next", F.coalesce("beyond", "next")).alias("comp")), "cc")
        dropped(hooked)
        changed = not nxt.filter(F.col("old") != F.col("comp")).isEmpty()
        dropped(labels)
        labels = nxt
        if not changed:
            dropped(both)
            return _kept(labels)


def _kept(labels: DataFrame) -> DataFrame:
    out = labels.select("node", "comp")
    out._scratch_path = labels._scratch_path
    return out
