"""MinHash near-duplicates with b-bit signatures.

Candidate pairs come from bands of full minima; what is kept of each minimum for the estimate is its low BITS bits,
packed, and a pair's similarity is estimated from the count of equal fields, corrected for chance collisions. Beside
it stand the counts of the set's shingles by a byte of their hashes: two sets share no more than the sum of the smaller
counts. Only pairs whose estimate and bound are within reach of the threshold have their full shingle sets compared.

Texts with equal shingle sets form one class before any pair is made. Within a band bucket not all pairs are made:
members are compared with one leader, and what is then connected needs no further comparison. Members of buckets that still
hold several components are dealt by classes of their sets' sizes, as only sets of one class or of neighbouring ones can be
similar enough, and a class in pairs of blocks; a task compares two blocks' signatures and emits only the pairs of
different components that are within reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .components import connected_components
from .scratch import dropped, frugal, small_batches, written

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Minima in a band, and low bits kept of each. Long bands keep texts that share only a common passage apart: at
#: similarity 0.4 a pair shares one of 40 with 3 %.
ROWS, BITS = 8, 2
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-5
#: Estimates this far (standard errors) below the threshold are not verified: a true link is lost with 1e-7.
SIGMAS = 5.2
#: Shingles are counted by that many values of a byte of their hashes; a count stops at FULL, and then bounds nothing.
PARTS, FULL = 256, 255
#: Members of a block of a bucket; a task holds two blocks, of some 0.4 KB a member.
BLOCK = 512

#: The lowest bit of each field of a packed word.
_LOWEST = np.uint64(int(("0" * (BITS - 1) + "1") * (64 // BITS), 2))


def bands_for(percent: int) -> int:
    """The least number of bands that keeps to MISS at this threshold, their low bits filling words of 64: 40 at 85, 64 at 80."""
    per_word = 64 // (ROWS * BITS)
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)) / per_word) * per_word if percent < 100 else per_word


#: Bands at PERCENT.
BANDS = bands_for(PERCENT)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, and offsets into them; a row of fewer words is one shingle."""
    starts, ends, at = tk.word_spans(buf, offsets, tk.BLANK)
    words = tk.word_hashes(buf, starts, ends, lower=True)
    counts = np.diff(at)
    many = tk.window_hashes(words, width)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(out_at[-1], np.uint64)
    long = np.flatnonzero(counts >= width)
    if len(long):
        rank = tk.ramp(n[long])
        out[np.repeat(out_at[long], n[long]) + rank] = many[np.repeat(at[long], n[long]) + rank]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[i])
        for w in words[at[i] : at[i + 1]]:
            h = tk.mixed(np.array([h]) * tk.U(0x9E3779B97F4A7C15) + w)[0]
        out[out_at[i]] = h
    return out, out_at


def distinct_sets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repeats."""
    parts = []
    for i in range(len(at) - 1):
        s = np.sort(hashes[at[i] : at[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        parts.append(s)
    out_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out_at


def _signatures(bands: int):
    n_minima = bands * ROWS
    mult, add = _permutations(n_minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffer_of(batch.column(1))
            for a, b in tk.chunks(off):
                hashes, at = shingle_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                sets, at = distinct_sets(hashes, at)
                counts = np.diff(at)
                full = np.flatnonzero(counts)
                minima = np.zeros((b - a, n_minima), np.uint64)
                s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                spread = tk.mixed(sets)
                parts = np.bincount(np.repeat(np.arange(b - a), counts) * PARTS + (spread >> tk.U(56)).astype(np.int64), minlength=(b - a) * PARTS)
                parts = np.minimum(parts, FULL).astype(np.uint8).reshape(b - a, PARTS)
                if len(full):
                    lead = at[full]
                    for k in range(n_minima):
                        minima[full, k] = np.minimum.reduceat(sets * mult[k] + add[k], lead)
                    s1[full] = np.add.reduceat(spread, lead)
                    s2[full] = np.add.reduceat(tk.mixed(sets ^ tk.U(0x5851F42D4C957F2D)), lead)
                minima = tk.mixed(minima)
                keys = np.zeros((b - a, bands), np.uint64)
                for j in range(bands):
                    h = np.full(b - a, j + 1, np.uint64)
                    for k in range(j * ROWS, (j + 1) * ROWS):
                        h = tk.mixed(h * tk.U(0xD1342543DE82EF95) + minima[:, k])
                    keys[:, j] = h
                low = (minima & tk.U((1 << BITS) - 1)).astype(np.uint8)
                packed = np.packbits(((low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1).reshape(b - a, -1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts.astype(np.int64)),
                        pa.array(tk.as_long(s1)),
                        pa.array(tk.as_long(s2)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(tk.as_long(keys.reshape(-1)))),
                        pa.array([x.tobytes() + y.tobytes() for x, y in zip(packed, parts, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return run


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands, sig) of (doc_id, text): h1 and h2 name the shingle set; sig holds low bits and counts."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        frugal(_signatures(bands_for(percent))), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"
    )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tk.buffer_of(batch.column(1))
        for a, b in tk.chunks(off):
            sets, at = distinct_sets(*shingle_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["doc_id", "shingles"]
            )


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities from packed signatures (words of 64 bits on the last axis), corrected for fields that agree by chance."""
    x = left ^ right
    for _ in range(BITS - 1):
        x = x | (x >> tk.U(1))
    differ = np.bitwise_count(x & _LOWEST).sum(axis=-1, dtype=np.int64)
    chance = 0.5**BITS
    return ((1 - differ / (left.shape[-1] * left.itemsize * 8 // BITS)) - chance) / (1 - chance)


def estimate_floor(percent: int) -> float:
    j, chance = percent / 100, 0.5**BITS
    p = j + (1 - j) * chance
    return j - SIGMAS * (p * (1 - p) / (bands_for(percent) * ROWS)) ** 0.5 / (1 - chance)


def within_bound(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these counts (rows of PARTS) and sums of sizes can be similar enough; never false for a link."""
    least = np.minimum(left, right)
    most = least.sum(axis=1, dtype=np.int64)
    return ((100 + percent) * most >= percent * sizes) | (least == FULL).any(axis=1)


def _unpacked(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Low bits (as words) and counts of signatures."""
    every = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    return np.ascontiguousarray(every[:, :-PARTS]).view(np.uint64), every[:, -PARTS:]


def _estimated(percent: int):
    floor = estimate_floor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, cx), (y, cy) = (_unpacked(batch.column(k).to_pylist()) for k in (2, 3))
                keep = (estimates(x, y) >= floor) & within_bound(cx, cy, batch.column(4).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _block_pairs(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of one group's members, of different components and within reach: across its two sides, or within its only one."""
    rep, comp, n = (rows[c].to_numpy() for c in ("rep", "comp", "n_shingles"))
    sig, parts = _unpacked(rows["sig"].to_pylist())
    side = rows["side"].to_numpy()
    single = rows["i"][0].as_py() == rows["j"][0].as_py()
    left, right = (np.arange(len(rep)),) * 2 if single else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    floor, out = estimate_floor(percent), []
    for k in range(0, len(left), 64):
        at = left[k : k + 64]
        keep = (comp[at][:, None] != comp[right][None]) & ((rep[at][:, None] < rep[right][None]) if single else True)
        r, c = np.nonzero(keep)
        for m in range(0, len(r), 1 << 13):
            x, y = at[r[m : m + (1 << 13)]], right[c[m : m + (1 << 13)]]
            ok = np.flatnonzero(estimates(sig[x], sig[y]) >= floor)
            x, y = x[ok], y[ok]
            ok = within_bound(parts[x], parts[y], n[x] + n[y], percent)
            out.append(np.stack([np.minimum(rep[x[ok]], rep[y[ok]]), np.maximum(rep[x[ok]], rep[y[ok]])]))
    found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _compared(percent: int):
    """Groups (key, cls, i, j), whose rows follow each other, to pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ids = np.stack([table[c].to_numpy() for c in ("key", "cls", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = tuple(ids[a])
                if held and name != last:
                    yield _block_pairs(pa.concat_tables(held), percent)
                    held = []
                last = name
                held.append(table.slice(a, b - a))
        if held:
            yield _block_pairs(pa.concat_tables(held), percent)

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose signatures are within reach; written."""
    sig = reps.select("rep", "sig", "n_shingles")
    return written(
        pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a")
        .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b")
        .filter(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")
        .select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("sizes"))
        .mapInArrow(frugal(_estimated(percent)), "a long, b long"),
        "near",
    )


def _links(near: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), which are dropped, those whose full sets are similar enough; written."""
    need = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(need, "doc_id", "left_semi").select("doc_id", "text")
    sets = written(texts.mapInArrow(frugal(_set_batches), "doc_id long, shingles binary"), "sets")
    links = written(
        near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
        .mapInArrow(frugal(_verified(percent)), "a long, b long"),
        "links",
    )
    dropped(near, sets)
    return links


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row for each doc_id that is not null: of repeated ids the greatest text, then the greatest other columns in order.

    Ids alone are shuffled; only rows of repeated ids, which are reduced and written, travel with their texts. Other columns must be orderable.
    """
    docs = docs.filter("doc_id is not null")
    again = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        dropped(again)
        return docs
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    text = F.col("text").cast("string").alias("t")
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(text, *rest)).alias("s"))
    one = written(one.select(*[F.col(f"s.c{k}").alias(c) for k, c in enumerate(docs.columns)]), "reduced")
    return docs.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_size) for every row of docs(doc_id, text, ...).

    Null and empty texts, and texts of blanks, have no shingles and stay alone. Repeated rows (equal doc_id) appear
    once, as the row with the greatest text. Rows without doc_id are left out; an empty table has no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = one_row_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    every = written(signatures(docs, percent), "signatures")
    # A class holds the texts of one shingle set; equal sets have equal bands and signatures.
    reps = written(
        every.filter("n_shingles > 0")
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("class_size")),
        "classes",
    )
    keyed = reps.select(F.explode("bands").alias("key"), "rep")
    # Written, so that the join deals both sides anew and a bucket of very many members can be split.
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    buckets = written(keyed.join(shared, "key").select("key", "rep", "n"), "buckets")
    # A text that meets many others leads first: the origin of a group of copies shares more bands with each than they share.
    mass = buckets.groupBy("rep").agg(F.sum("n").alias("mass"))
    members = written(buckets.join(mass, "rep").select("key", F.struct((-F.col("mass")).alias("mass"), F.col("rep")).alias("ord")), "members")
    first = written(members.groupBy("key").agg(F.min("ord").alias("upto")), "first")
    dropped(shared, buckets)
    members = members.join(first, "key").filter("ord > upto")
    links = _links(_near(members.select(F.col("upto.rep").alias("a"), F.col("ord.rep").alias("b")).distinct(), reps, percent), docs, percent)
    labels = connected_components(links)
    # Buckets of several components, by classes of sizes: each pair of blocks of a class, or of neighbouring classes, is a group.
    # A little wider than the ratio of sizes that a link allows, so that no rounding puts linked sets two classes apart.
    sizes = reps.select("rep", F.floor(F.log(F.col("n_shingles")) / (math.log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.col("n_shingles")).cast("long").alias("cls"))
    placed = members.withColumn("rep", F.col("ord.rep")).join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = written(placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key"), "several")
    rest = written(placed.join(several, "key").join(sizes, "rep"), "rest")
    # A class is met by the next smaller one; a class of one component that no neighbour has others than needs no group.
    met = rest.select("key", "cls", "comp").unionByName(rest.select("key", (F.col("cls") + 1).alias("cls"), "comp"))
    met = met.groupBy("key", "cls").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key", "cls")
    counts = rest.groupBy("key", "cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    blocks = counts.join(counts.select("key", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("under")), ["key", "cls"], "full").join(met, ["key", "cls"], "left_semi")
    blocks = written(blocks.select("key", "cls", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"), F.coalesce("under", F.lit(0).cast("long")).alias("under")), "blocks")
    own = rest.join(blocks.filter("blocks > 0"), ["key", "cls"]).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    # Within a class: blocks i <= j; with the class under it, whose blocks are numbered from -1 down.
    within = own.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", "cls", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp")
    above = own.filter("under > 0").withColumn("other", F.explode(F.expr("sequence(-under, -1L)"))).select("key", "cls", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "rep", "comp")
    under = rest.withColumn("cls", F.col("cls") + 1).join(blocks.filter("blocks > 0 and under > 0"), ["key", "cls"]).withColumn("own", -1 - F.pmod(F.xxhash64("rep"), "under"))
    under = under.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", "cls", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "rep", "comp")
    dealt = within.unionByName(above).unionByName(under)
    groups = dealt.join(reps.select("rep", "n_shingles", "sig"), "rep").select("key", "cls", "i", "j", "side", "rep", "comp", "n_shingles", "sig")
    near = groups.repartition("key", "cls", "i", "j").sortWithinPartitions("key", "cls", "i", "j").mapInArrow(frugal(_compared(percent)), "a long, b long")
    more = _links(written(near.distinct(), "near"), docs, percent)
    if not more.isEmpty():
        old, links = links, written(links.unionByName(more), "links")
        dropped(old, labels)
        labels = connected_components(links)
    dropped(more, several, rest, blocks, first)
    classes = reps.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("h1", "h2", "n_shingles", "class_size", F.coalesce("comp", "rep").alias("comp"))
    out = every.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2", "n_shingles"], "left")
    out = written(
        out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), (F.coalesce("comp", "doc_id") == F.col("doc_id")).alias("kept"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")),
        "components",
    )
    dropped(every, reps, links, labels)
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_size")
