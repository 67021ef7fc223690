"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is cut into blocks of consecutive words. Its target, in blocks, is its quota: more than its blocks where it is to
be repeated. A binary tree over the output shards splits the quotas of all sources: a node that holds a quota of each source
gives its left shards as many blocks as they have room for, of each source a multivariate-hypergeometric number, and its
right shards the rest. So a leaf, a shard, has an exact quota of each source, and all shards are equally full.

A source's blocks are permuted by a hash; repeated, the permutation gives the places 0, 1, ... of its quota, which the
shards take in turn, each as many as its own: draws are disjoint, and no block comes twice before all others came once.
Where a shard's share begins is a rank in the permutation, and so a block: whoever holds a block's hash and these few blocks of
its source knows its shards. They are found by counting blocks by leaves of hash values and ranking those of the leaves that hold one;
nothing else is sorted or joined by document, and texts travel once, to their shards, which shuffle them by another hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .near_dedup import one_row_each
from .scratch import dropped, small_batches, written

WORD = r"[^ \t-\r]+"
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words; a source gives at most CAP times its own.
TOTAL, CAP = 1.5, 2.0
#: Words in a block: a source's words / GRAIN, within these.
BLOCK_MIN, BLOCK_MAX, GRAIN = 1, 256, 4096
#: Blocks of a leaf of hash values, about; output shards; parts of a shard that are sorted each in a task.
LEAF, SHARDS, PARTS, SEED = 1 << 14, 8, 64, 17


def _log_factorial_ratio(a: float, b: float) -> float:
    """ln(a!) - ln(b!), without the loss of a difference of two large logarithms."""
    if min(a, b) < 1e6:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    return (b + 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(a) - 1) + (1 / a - 1 / b) / 12


def by_ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric number by the ratio of uniforms (Stadlober 1990), for counts of any size; each is positive."""
    total = good + bad
    m = min(draws, total - draws)
    mean = m * (good / total)
    var = mean * (bad / total) * ((total - m) / (total - 1))
    # Fixed values of the method: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
    width = 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    mode = (m + 1) * (good + 1) // (total + 2)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not max(0, m - bad) <= k <= min(m, good):
            continue
        pairs = ((k, mode), (good - k, good - mode), (m - k, m - mode), (bad - m + k, bad - m + mode))
        if 2 * math.log(u) <= -sum(_log_factorial_ratio(float(x), float(y)) for x, y in pairs):
            return k if m == draws else good - k


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good; one law for counts of any size."""
    if not good or not draws:
        return 0
    if not bad or draws == good + bad:
        return min(good, draws)
    if max(good, bad) < 10**9:  # as far as numpy's generator, of the same law, goes
        return int(rng.hypergeometric(good, bad, draws))
    return by_ratio_of_uniforms(rng, good, bad, draws)


def drawn_of_each(rng: np.random.Generator, counts: list[int], draws: int) -> list[int]:
    """A multivariate-hypergeometric vector: of each count, how many are among the draws."""
    rest, out = sum(counts), []
    for n in counts:
        rest -= n
        out.append(hypergeometric(rng, n, rest, draws))
        draws -= out[-1]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Quotas of sources (rows) split among shards (columns) of equal room by a binary tree; seeded by node."""
    total = sum(quotas)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(0, shards, list(quotas))]
    while todo:
        a, b, own = todo.pop()
        if b - a == 1:
            out[:, a] = own
            continue
        mid = (a + b) // 2
        left = drawn_of_each(np.random.default_rng([seed, a, b]), own, sum(room[a:mid]))
        todo += [(a, mid, left), (mid, b, [x - y for x, y in zip(own, left, strict=True)])]
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, no, source_size, target): one row a source, of sizes(source, size).

    Sources with the smallest cap to weight ratio reach their caps first, so the fixed point of resharing is found with
    running sums in that order: the first k sources are at their caps where what is left, by weight, still exceeds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    up = Window.orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    per = per.withColumn("goal", F.sum("source_size").over(every) * F.lit(total))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    # Each source's share per weight if exactly the sources before it are at their caps.
    per = per.withColumn("rate", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("rate_at", F.min(F.when(F.col("rate") < F.col("ratio"), F.struct("ratio", "no", "rate"))).over(every)["rate"])
    return per.select("source", "no", "source_size", F.coalesce(F.least(F.col("most"), F.col("w") * F.col("rate_at")), F.col("most")).alias("target"))


def _tree(shards: int):
    """One row a source (no, quota) to (no, ends): the place in its quota where each shard's share ends."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        ends = np.cumsum(split_quotas(table["quota"].to_pylist(), shards), axis=1)
        return pa.table({"no": table["no"], "ends": pa.array(ends.tolist(), pa.list_(pa.int64()))})

    return run


def _key(doc_id: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, block)


def _leaf(key: Column, leaves: Column) -> Column:
    return F.floor(F.shiftrightunsigned(key, 11) / float(1 << 53) * leaves).cast("long")


def block_plan(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, source, size, no, source_size, target, block_words, blocks), and by source its part of the plan.

    plan: (source, no, block_words, all_blocks, quota, leaves, ends, cuts). ends: the places in the quota where each shard's share ends; cuts: by rank, the
    blocks (rank, leaf, key, doc_id, block) that shares begin with. docs has one row for each doc_id. One row a source is ranked, summed and split
    in one task each (targets, the tree: some 100 bytes and 10 microseconds a source and shard).
    """
    small_batches(docs.sparkSession, 10_000)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = written(sizes, "sizes")
    block = F.greatest(F.lit(BLOCK_MIN), F.least(F.lit(BLOCK_MAX), F.floor(F.col("source_size") / GRAIN))).cast("long")
    per = written(targets(sizes).withColumn("block_words", block), "sources")
    known = sizes.join(per.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    known = written(known.withColumn("blocks", F.ceil(F.col("size") / F.col("block_words")).cast("long")), "known")
    dropped(sizes)
    shares = known.groupBy("no").agg(F.sum("blocks").alias("all_blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("source").alias("source"), F.first("block_words").alias("block_words"))
    shares = shares.withColumn("quota", F.coalesce(F.round(F.col("target") / F.nullif("source_size", F.lit(0)) * F.col("all_blocks")), F.lit(0)).cast("long"))
    shares = written(shares.withColumn("leaves", F.greatest(F.lit(1), F.ceil(F.col("all_blocks") / LEAF)).cast("long")), "shares")
    tree = shares.select("no", "quota", F.lit(0).alias("every")).groupBy("every").applyInArrow(_tree(shards), "no int, ends array<long>")
    ranks = F.array_distinct(F.transform(F.concat(F.array(F.lit(0).cast("long")), "ends"), lambda e: e % F.col("all_blocks")))
    quotas = written(shares.join(tree, "no").filter("quota > 0").withColumn("ranks", ranks), "quotas")
    each = known.filter("size > 0").join(quotas.select("no", "leaves"), "no").select("doc_id", "no", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    each = each.withColumn("key", _key(F.col("doc_id"), F.col("block"))).withColumn("leaf", _leaf(F.col("key"), F.col("leaves")))
    before = Window.partitionBy("no").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("no", "leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.filter("ranks", lambda r: (r >= F.col("offset")) & (r < F.col("offset") + F.col("n")))
    wanted = written(counts.join(quotas.select("no", "ranks"), "no").withColumn("ranks", inside).filter(F.size("ranks") > 0).select("no", "leaf", "offset", "ranks"), "cut-leaves")
    order = Window.partitionBy("no", "leaf").orderBy("key", "doc_id", "block")
    ranked = each.join(wanted, ["no", "leaf"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("offset")).filter(F.array_contains("ranks", F.col("rank").cast("long")))
    cuts = ranked.groupBy("no").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "leaf", "key", "doc_id", "block"))).alias("cuts"))
    plan = written(quotas.join(cuts, "no").select("source", "no", "block_words", "all_blocks", "quota", "leaves", "ends", "cuts"), "plan")
    dropped(shares, quotas, wanted, per)
    return known, plan


def _drawn(size: Column) -> Column:
    """array(struct(shard, place, block, first_word, words)) of a document's draws, beside its source's plan and its doc_id.

    Blocks between two cuts have the same shards: turn after turn of the permutation while its places are in the quota.
    """
    words, every = F.col("block_words"), F.col("all_blocks")

    def of_block(block: Column) -> Column:
        key = _key(F.col("doc_id"), block)

        def of_key(k: Column) -> Column:
            me = F.struct(_leaf(k, F.col("leaves")).alias("leaf"), k.alias("key"), F.col("doc_id").alias("doc_id"), block.alias("block"))
            rank = F.element_at(F.filter("cuts", lambda c: F.struct(c["leaf"].alias("leaf"), c["key"].alias("key"), c["doc_id"].alias("doc_id"), c["block"].alias("block")) <= me), -1)["rank"]

            def of_rank(r: Column) -> Column:
                turns = F.when(r < F.col("quota"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - r) / every).cast("long"))).otherwise(F.array().cast("array<bigint>"))
                return F.transform(turns, lambda t: F.struct(
                    F.size(F.filter("ends", lambda e: e <= r + t * every)).alias("shard"), F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), block, t).alias("place"), block.alias("block"), (block * words).alias("first_word"),
                    F.least(words, size - block * words).alias("words")))

            return F.transform(F.array(rank), of_rank)[0]

        # An array of one value binds it.
        return F.transform(F.array(key), of_key)[0]

    blocks = F.when(size > 0, F.sequence(F.lit(0).cast("long"), F.ceil(size / words).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(blocks, of_block))


def draws(known: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, no, shard, place, block, first_word, words): every draw; places are in no order."""
    j = known.select("doc_id", "no", "size").join(plan, "no")
    return j.select("doc_id", "no", F.explode(_drawn(F.col("size"))).alias("d")).select("doc_id", "no", "d.*")


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for every doc_id of docs(doc_id, text, source, ...).

    taken: words of the document in the mix, repeats counted; shards: in how many shards some are. A null or empty text has
    size 0 and gives nothing. The null source comes last. Of repeated rows of one doc_id the one with the greatest text is mixed,
    of equal ones that of the last source; rows without one are left out. Empty tables have no rows. Other columns are not looked at.
    """
    known, plan = block_plan(one_row_each(docs.select("doc_id", "text", "source")), shards)
    j = known.join(plan.select("no", "all_blocks", "quota", "leaves", "ends", "cuts"), "no", "left").withColumn("d", F.coalesce(_drawn(F.col("size")), F.array()))
    taken = F.aggregate("d", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return j.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0).cast("long")).alias("taken"), F.size(F.array_distinct(F.transform("d", lambda x: x["shard"]))).cast("long").alias("shards"))


def mixed_texts(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, place, doc_id, text) of the mix: drawn blocks, words joined by blanks, shuffled within shards.

    Null and empty texts and rows without doc_id give none; repeated rows are reduced as in mixed.
    """
    docs = one_row_each(docs.select("doc_id", "text", "source"))
    _, plan = block_plan(docs, shards)
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("_source"))
    j = texts.join(plan, F.col("_source").eqNullSafe(F.col("source")))
    words = F.filter(F.split(F.col("text"), r"[ \t-\r]+"), lambda w: F.length(w) > 0)
    cut = lambda w: F.transform(_drawn(F.size(w).cast("long")), lambda d: F.struct(d["shard"].alias("shard"), d["place"].alias("place"), F.array_join(F.slice(w, (d["first_word"] + 1).cast("int"), d["words"].cast("int")), " ").alias("text")))
    out = j.select("doc_id", F.explode(F.transform(F.array(words), cut)[0]).alias("p")).select("p.shard", "p.place", "doc_id", "p.text")
    return out.repartition(F.col("shard"), F.pmod("place", F.lit(PARTS))).sortWithinPartitions("shard", "place")


def op10(spark, sf_dir: str) -> DataFrame:
    """mixed over the whole documents table."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
