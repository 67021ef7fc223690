"""Exact top-k inner products by Fagin's threshold algorithm.

Rows lie in shards of at most SHARD vectors. A shard holds, for each dimension, its rows in sorted order. A query reads the
lists of its non-zero components from the end that each sign favours, all to the same depth, scores the rows that it meets
for the first time, and goes deeper only while the sum of what an unseen row could have in each list may beat its k-th
score, which it carries from shard to shard. A task takes one slice of the rows and one block of the queries.

The fewer dimensions weigh, the earlier a query stops. Over 64 dimensions of equal weight nearly every row leads some list early:
then nearly all are scored, and the lists are read on top (README: share of rows scored).
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import small_batches, written

K, EVERY, SCALE = 20, 20, 64
SHARD = 4096
#: Queries of a block, and rows of a slice: a task holds one of each, of 8 bytes a component. Small tables are still dealt in LEAST slices.
BLOCK, SLICE, LEAST = 1 << 14, 1 << 16, 16
#: Depth of the first sorted access; it doubles.
DEPTH = 16
NONE = np.iinfo(np.int64).min


def scaled(column: pa.ChunkedArray) -> np.ndarray:
    """floor(64 * x) of lists as rows of integers; shorter vectors end in zeros. Components whose inner products could leave 64 bits are an error."""
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lists = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists
    out = np.floor(SCALE * out)
    most = isqrt((2**63 - 1) // max(out.shape[1], 1))
    if out.size and np.abs(out).max() > most:
        raise ValueError(f"a component times {SCALE} is beyond {most}: scores of {out.shape[1]} dimensions would not fit 64 bits")
    return out.astype(np.int64)


class Lists:
    """A shard's sorted lists: by dimension, its rows and their values from the largest."""

    def __init__(self, vectors: np.ndarray):
        self.n = len(vectors)
        self.order = np.ascontiguousarray(np.argsort(-vectors, axis=0, kind="stable").T.astype(np.int32))
        self.down = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, axis=1)

    def read(self, up: np.ndarray, low: np.ndarray, done: int, depth: int) -> np.ndarray:
        """Rows that sorted access from done to depth meets: from the top in the lists `up`, from the bottom in `low`."""
        return np.concatenate([self.order[up, done:depth].ravel(), self.order[low, self.n - depth : self.n - done].ravel()])

    def bounds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """Most that a row not met before that depth can score, for each query."""
        at = min(depth, self.n - 1)
        return np.maximum(queries, 0) @ self.down[:, at] + np.minimum(queries, 0) @ self.down[:, self.n - 1 - at]


def search(q_ids, queries, ids, vectors, best: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> int:
    """Take a shard into best, by query (scores, ids) of the k best so far in order; returns how many scores were computed."""
    n, dims = vectors.shape
    lists = Lists(vectors)
    kth = np.array([b[0][k - 1] if len(b[0]) >= k else NONE for b in best])
    # Sums that a float holds exactly are computed in floats.
    most = int(abs(queries).max(initial=0)) * int(abs(vectors).max(initial=0)) * max(dims, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    x, q = vectors.astype(kind), queries.astype(kind)
    depths = [min(DEPTH << j, n) for j in range(max((n - 1) // DEPTH, 0).bit_length() + 1)]
    limits = {d: lists.bounds(queries, d) for d in depths}
    computed = 0
    for i in np.flatnonzero(lists.bounds(queries, 0) >= kth):
        up, low = np.flatnonzero(queries[i] > 0), np.flatnonzero(queries[i] < 0)
        met, done = np.zeros(n, bool), 0
        for depth in depths:
            if len(up) + len(low):
                here = np.zeros(n, bool)
                here[lists.read(up, low, done, depth)] = True
                new = np.flatnonzero(here & ~met)
                met |= here
            else:  # no list favours any row
                new = np.arange(n)
            done = depth
            s = (x[new] @ q[i]).astype(np.int64)
            computed += len(new)
            good = (s >= kth[i]) & (ids[new] != q_ids[i])
            new, s = new[good], s[good]
            if len(new):
                s, v = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], ids[new]])
                if len(s) > 4 * k:
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    s, v = s[s >= cut], v[s >= cut]
                top = np.lexsort((v, -s))[:k]
                best[i] = (s[top], v[top])
                if len(top) == k:
                    kth[i] = s[top[-1]]
            # An unseen row with an equal score could have a smaller id.
            if limits[depth][i] < kth[i] or not len(up) + len(low):
                break
    return computed


def searched(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """By query (scores, ids) of its k best rows in order, shard after shard; and how many scores were computed."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    d = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (queries, vectors))
    return best, sum(search(q_ids, queries, ids[a : a + SHARD], vectors[a : a + SHARD], best, k) for a in range(0, len(ids), SHARD))


def _searched(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        q_ids, ids = (t["vec_id"].to_numpy().astype(np.int64) for t in (asked, rows))
        best, _ = searched(q_ids, scaled(asked["vector"]), ids, scaled(rows["vector"]), k) if len(ids) and len(q_ids) else ([], 0)
        sizes = [len(s) for s, _ in best]
        cat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
        return pa.table({"query_id": cat([np.repeat(q_ids[: len(sizes)], sizes)]), "vec_id": cat([v for _, v in best]), "score": cat([s for s, _ in best])})

    return run


def top_k(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of table(vec_id, embedding, ...) with vec_id divisible by every.

    Null vectors, vectors with null or non-finite components and rows without vec_id take no part; shorter vectors end
    in zeros. A query's own vec_id is no candidate for it. Of repeated vec_ids one row counts, the one with the greatest
    vector in order. Ties go to the smaller vec_id. Other columns are not looked at. An empty table has no result. Components so large
    that a score may not fit 64 bits (beyond 2 to 28.5 times 64 in 64 dimensions) are an error.
    """
    small_batches(table.sparkSession, 1024)
    vector = F.col("embedding").cast("array<double>")
    good = F.expr("not exists(vector, x -> x is null or isnan(x) or x = double('infinity') or x = -double('infinity'))")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id is not null and vector is not null").filter(good)
    rows = written(rows.groupBy("vec_id").agg(F.max("vector").alias("vector")), "vectors")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n, blocks = rows.count(), max(1, -(-asked.count() // BLOCK))
    slices = max(-(-n // SLICE), min(LEAST, -(-n // SHARD)), 1)
    place = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    # Each block meets each slice: rows are copied once for each block of 16,384 queries, queries once for each slice of 65,536 rows.
    dealt = rows.withColumn("slice", place(slices, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", place(blocks, 2)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    found = dealt.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    """top_k over the whole embeddings table."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
