"""Benchmark decontamination with an FM-index per training shard.

A shard is a stretch of texts. Its words are named by the benchmark's vocabulary; a word outside it can be in no
test phrase, so only runs of known words as long as the shortest phrase are kept, with separators between them. Over
these a suffix array gives the Burrows-Wheeler transform, held in a wavelet matrix. All test phrases are searched
backwards together; occurrences are located by sampled suffix positions, and covered words are merged to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .scratch import dropped, frugal, small_batches, written

WIDTH = 10
#: Every SAMPLE-th text position has its suffix kept.
SAMPLE = 8
SHARD_BYTES = 2 << 20
#: Benchmark text that the driver holds and sends to the executors at once; a larger benchmark is searched for in groups of items, one after another.
GROUP_BYTES = 8 << 20


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for k in reversed(range(bits)):
            bit = (seq >> k) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            order = np.argsort(bit, kind="stable")
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = seq[order]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before at (arrays)."""
        lo, hi = np.zeros_like(at), at
        for i, k in enumerate(reversed(range(self.bits))):
            ones, one = self.levels[i], ((symbol >> k) & 1).astype(bool)
            l1, h1 = ones[lo], ones[hi]
            lo = np.where(one, self.zeros[i] + l1, lo - l1)
            hi = np.where(one, self.zeros[i] + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for i in range(self.bits):
            ones = self.levels[i]
            one = ones[at + 1] > ones[at]
            out = (out << 1) | one
            at = np.where(one, self.zeros[i] + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; text ends with a unique smallest symbol."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        step *= 2
        if rank.max() == n - 1 or step >= n:
            return np.argsort(rank, kind="stable")


class FMIndex:
    """text: symbols of at least 1 (1 separates); phrases never hold 1."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(text)
        self.n = len(text)
        self.wave = WaveletMatrix(text[sa - 1], max(int(symbols).bit_length(), 1))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.marked = np.concatenate([[0], np.cumsum(sa % SAMPLE == 0)])
        self.sampled = sa[sa % SAMPLE == 0]

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase, words[start:start + length]."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = words[starts[live] + lengths[live] - 1 - k].astype(np.int64)
            lo[live], hi[live] = self.before[c] + self.wave.rank(c, lo[live]), self.before[c] + self.wave.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, todo, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.marked[at + 1] > self.marked[at]
            out[todo[known]] = self.sampled[self.marked[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                c = self.wave.access(at)
                at = self.before[c] + self.wave.rank(c, at)
                steps += 1
        return out


@dataclass
class Phrases:
    """Distinct test phrases as places in the items' words (vocabulary ids from 2 up), and the items that hold each: some 30 bytes a word."""

    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items_at: np.ndarray
    items: np.ndarray


def phrases_of(items: list[tuple[int, str]], width: int = WIDTH) -> Phrases | None:
    buf, off = tk.buffer_of(pa.array([t for _, t in items], pa.large_string()))
    starts, ends, at = tk.word_spans(buf, off, tk.NOT_ALNUM)
    if not len(starts):
        return None
    vocabulary, ids = np.unique(tk.word_hashes(buf, starts, ends, lower=True), return_inverse=True)
    words = (ids + 2).astype(np.int32)
    size = np.diff(at)
    n = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(items)), n)
    start = np.repeat(at[:-1], n) + tk.ramp(n)
    length = np.minimum(size, width)[owner]
    rows = np.zeros((len(start), width), np.int32)
    for k in range(width):
        held = length > k
        rows[held, k] = words[start[held] + k]
    _, first, phrase = np.unique(rows.view(f"V{4 * width}").ravel(), return_index=True, return_inverse=True)
    del rows
    numbers = np.array([i for i, _ in items], np.int64)
    pair = np.unique(np.stack([phrase.ravel(), numbers[owner]]), axis=1)
    return Phrases(vocabulary, words, start[first], length[first], np.searchsorted(pair[0], np.arange(len(first) + 1)), pair[1])


def occurrences(ids: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word position) of all occurrences in words named ids (0: none), rows from at."""
    least = int(phrases.lengths.min())
    known = ids > 0
    edge = np.zeros(len(ids) + 1, bool)
    edge[at] = True
    first = known.copy()
    first[1:] &= ~known[:-1] | edge[1:-1]
    last = known.copy()
    last[:-1] &= ~known[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = (b - a) >= least
    a, size = a[long], (b - a)[long]
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none
    start = np.cumsum(size + 1) - (size + 1)
    place = np.repeat(start, size) + tk.ramp(size)
    text = np.ones(int((size + 1).sum()), np.int64)
    where = np.zeros(len(text), np.int64)
    where[place] = np.repeat(a, size) + tk.ramp(size)
    text[place] = ids[where[place]]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.words, phrases.starts, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(lo)), count)
    return phrase, where[index.locate(np.repeat(lo, count) + tk.ramp(count))]


def _without(raw: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text of raw but for these byte ranges, which are in order."""
    kept, done = [], 0
    for x, y in cuts:
        kept.append(raw[done:x])
        done = y
    return b"".join([*kept, raw[done:]]).decode("utf-8", "replace")


def _scan(phrases: Phrases | None, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffer_of(batch.column(1))
            for a, b in tk.chunks(off, SHARD_BYTES):
                part = buf[off[a] : off[b]]
                starts, ends, at = tk.word_spans(part, off[a : b + 1] - off[a], tk.NOT_ALNUM)
                n, hit, items = len(starts), np.zeros(len(starts), bool), [[] for _ in range(b - a)]
                if phrases is not None and n:
                    h = tk.word_hashes(part, starts, ends, lower=True)
                    slot = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
                    ids = np.where(phrases.vocabulary[slot] == h, slot + 2, 0)
                    phrase, pos = occurrences(ids, at, phrases)
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + phrases.lengths[phrase], -1)
                    hit = np.cumsum(cover)[:n] > 0
                    doc = np.searchsorted(at, pos, side="right") - 1
                    pairs = np.unique(doc * len(phrases.lengths) + phrase) if len(pos) else np.zeros(0, np.int64)
                    for d, p in zip(*np.divmod(pairs, len(phrases.lengths)), strict=True):
                        items[d] += phrases.items[phrases.items_at[p] : phrases.items_at[p + 1]].tolist()
                # Merged spans of hit words, by row.
                lead = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]])) if n else np.zeros(0, np.int64)
                edge = np.zeros(n + 1, bool)
                edge[at] = True
                first, last = hit.copy(), hit.copy()
                if n:
                    first[1:] &= ~hit[:-1] | edge[1:n]
                    last[:-1] &= ~hit[1:] | edge[1:n]
                lead, tail = np.flatnonzero(first), np.flatnonzero(last) + 1
                span_at = np.searchsorted(lead, at)
                spans = [[(int(x - at[d]), int(y - at[d])) for x, y in zip(lead[span_at[d] : span_at[d + 1]], tail[span_at[d] : span_at[d + 1]], strict=True)] for d in range(b - a)]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(at)),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())),
                ]
                names = ["doc_id", "n_words", "spans", "items"]
                if clean:
                    texts = batch.column(1).slice(a, b - a).to_pylist()
                    base = off[a : b + 1] - off[a]
                    for d in np.flatnonzero(np.diff(span_at)):
                        words = zip(lead[span_at[d] : span_at[d + 1]], tail[span_at[d] : span_at[d + 1]], strict=True)
                        texts[d] = _without(part[base[d] : base[d + 1]].tobytes(), [(starts[x] - base[d], ends[y - 1] - base[d]) for x, y in words])
                    cols.append(pa.array(texts, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _groups(benchmark: DataFrame) -> list[DataFrame]:
    """The items in groups of about GROUP_BYTES by their hash; an item alone is never split."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    n = int(size // GROUP_BYTES) + 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g) for g in range(n)]


SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<long>"


def _phrases(group: DataFrame) -> Phrases | None:
    return phrases_of(sorted((r.item_id, r.text) for r in group.collect()))


#: Overlapping and touching spans of several groups as one.
MERGED = """aggregate(s, cast(array() as array<struct<first:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).end >= x.first,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, x.end)))),
           concat(acc, array(x))))"""


def _found_in_groups(docs: DataFrame, groups: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(row, docs' columns), written, and (row, n_words, spans, items): each group is searched for in the text as it was given.

    The driver holds one group's phrases at a time; of a group, only rows with a hit are written, and the first one's counts of words.
    """
    given = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string").alias("_text"), F.struct(*given).alias("_given")), "rows")
    texts = rows.select("_row", "_text")
    parts = [written(texts.mapInArrow(frugal(_scan(_phrases(g), False)), SCHEMA).filter(F.lit(k == 0) | (F.size("items") > 0)), "hits") for k, g in enumerate(groups)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = written(every.select(F.col("doc_id").alias("_row"), "n_words", F.expr(MERGED).alias("spans"), "items"), "found")
    dropped(*parts)
    return rows, found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs(doc_id, text, ...); benchmark: (item_id, text, ...).

    spans: merged word ranges inside occurrences of windows; items: ids of items with an occurring window. Null and
    empty texts have no words. An item without words or id has no window; items with equal ids count once. Repeated
    rows of docs, and rows without doc_id, are judged each; without an item nothing is hit, and an empty table has no rows. Other columns
    are not looked at. Results are the same however many groups the items make.
    """
    small_batches(docs.sparkSession, 1024)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = _groups(benchmark)
    if len(groups) == 1:
        return docs.mapInArrow(frugal(_scan(_phrases(groups[0]), False)), SCHEMA)
    rows, found = _found_in_groups(docs, groups)
    return rows.select("_row", F.col("_given.c0").alias("doc_id")).join(found, "_row").select("doc_id", "n_words", "spans", "items")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(text, ...) with every span that contaminated finds cut from the text.

    Rows and their number, null and empty texts and all other columns stay, whatever their names; repeated rows are cut each. A text of which
    nothing is hit stays as it is.
    """
    small_batches(docs.sparkSession, 1024)
    groups = _groups(benchmark)
    if len(groups) == 1:
        return docs.mapInArrow(frugal(_cleaner(_phrases(groups[0]), docs.columns)), docs.schema)
    rows, found = _found_in_groups(docs, groups)
    marked = rows.join(found.select("_row", "spans"), "_row").select(*[F.col(f"_given.c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("spans").alias("_spans"))
    return marked.mapInArrow(frugal(_cutter(docs.columns)), docs.schema)


def _cutter(columns: list[str]):
    """Cuts the word ranges of the last column, spans, from the text."""
    t = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = tk.buffer_of(batch.column(t))
            texts, spans = batch.column(t).to_pylist(), batch.column(len(columns)).to_pylist()
            for a, b in tk.chunks(off, SHARD_BYTES):
                part, base = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                starts, ends, at = tk.word_spans(part, base, tk.NOT_ALNUM)
                for d in range(b - a):
                    if spans[a + d]:
                        texts[a + d] = _without(part[base[d] : base[d + 1]].tobytes(), [(starts[at[d] + x["first"]] - base[d], ends[at[d] + x["end"] - 1] - base[d]) for x in spans[a + d]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == t else batch.column(k) for k in range(len(columns))], columns)

    return run


def _cleaner(phrases: Phrases | None, columns: list[str]):
    scan = _scan(phrases, True)
    t = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = list(scan(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(t)], ["doc_id", "text"])])))
            text = pa.concat_arrays([x.column(4) for x in got])
            yield pa.RecordBatch.from_arrays([text if k == t else batch.column(k) for k in range(len(columns))], columns)

    return run


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op9(spark, sf_dir: str) -> DataFrame:
    """contaminated over the whole documents and benchmark tables."""
    return digest(contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
