"""Repeated passages by recompression.

Rounds name runs of equal symbols, then pairs of a left and a right symbol (a coin by the symbol's own hash decides
which it is). Names are hashes of what they stand for, so they are the same in every task without an exchange: equal stretches
of words have equal interior symbols in every text. Of a window of words, each round drops what the words outside could still
join: the first and the last run, then a leading right and a trailing left symbol. What is left is the same wherever the
window occurs. The longest symbol of its last non-empty level, with the symbols on either side, is the window's high-level
symbol; all that was dropped and left, in order, is its description, which equal windows share and others do not.

Spark counts high-level symbols over the corpus: only those that occur twice or more can lie in repeated windows. Consecutive
windows around one occurrence form a run, named by its description: a run that occurs earlier is repeated as a whole. Where a
symbol has runs of different names, the windows of each name's first run are described and held against each other. The
first of each name by (document, position) stays. Descriptions are held as hashes of 64 and 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .near_dedup import one_row_each
from .scratch import dropped, small_batches, written

WIDTH = 20
#: Rounds at most: each further one leaves fewer, longer symbols in a window. With two, the longest of the some ten left is the same for many
#: windows in a row, so that a text has few runs.
LEVELS = 2
_MIX1, _MIX2 = tk.U(0x9E3779B97F4A7C15), tk.U(0xC2B2AE3D27D4EB4F)
CHUNK = 1 << 18


class Level:
    """One level of a chunk of texts: its symbols, where they start, and what the next round makes of them.

    pos: starts in words, and the end; index: by word position, the symbol that starts there; runs of equal symbols with their
    names, sides and starts.
    """

    def __init__(self, sym: np.ndarray, pos: np.ndarray, top: np.ndarray, number: int):
        self.sym, self.pos, self.number = sym, pos, number
        n, m = int(pos[-1]), len(sym)
        self.index = np.zeros(n + 1, np.int64)
        self.index[pos] = np.arange(m + 1)
        first = np.ones(m, bool)
        first[1:] = (sym[1:] != sym[:-1]) | top[pos[1:m]]
        self.run_at = np.append(np.flatnonzero(first), m)
        self.run = np.cumsum(first) - 1
        size = np.diff(self.run_at)
        lead = sym[self.run_at[:-1]]
        self.run_sym = np.where(size > 1, tk.mixed(lead * _MIX1 + size.astype(np.uint64)), lead)
        self.run_pos = pos[self.run_at]
        self.right = (tk.mixed(self.run_sym + tk.U(number + 1)) >> tk.U(63)).astype(bool)

    def next(self, top: np.ndarray) -> Level:
        """The level that pairs of a left and a right run make."""
        r = len(self.run_sym)
        pair = np.zeros(r, bool)
        if r > 1:
            pair[:-1] = ~self.right[:-1] & self.right[1:] & ~top[self.run_pos[1:r]]
        keep = np.ones(r, bool)
        keep[1:] = ~pair[:-1]
        sym, lead = self.run_sym.copy(), np.flatnonzero(pair)
        sym[lead] = tk.mixed(tk.mixed(self.run_sym[lead] * _MIX2 + tk.U(self.number + 1)) + self.run_sym[lead + 1])
        return Level(sym[keep], np.append(self.run_pos[:-1][keep], self.pos[-1]), top, self.number + 1)

    def cores(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of stretches [s, e) of whole symbols, what no word outside can join: starts, ends; and which dropped a leading right, a trailing left run."""
        r = len(self.run_sym)
        after = np.minimum(self.run[self.index[s]] + 1, r)
        led = self.right[np.minimum(after, r - 1)] & (after < r)
        own = self.run[self.index[e] - 1]
        trailed = ~self.right[np.maximum(own - 1, 0)] & (own > 0)
        return self.run_pos[np.minimum(after + led, r)], self.run_pos[np.maximum(own - trailed, 0)], led, trailed


class Levels:
    """The levels of a chunk of texts, made as they are asked for."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.n = len(words)
        self.top = np.zeros(self.n + 1, bool)
        self.top[at] = True
        self.made = [Level(words, np.arange(self.n + 1), self.top, 0)] if self.n else []

    def __getitem__(self, k: int) -> Level:
        while len(self.made) <= k:
            self.made.append(self.made[-1].next(self.top))
        return self.made[k]


def high_symbols(levels: Levels, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch [s, e) of words: its high-level symbol, and which occurrence of it that is."""
    key, occurrence = np.zeros(len(s), np.uint64), np.zeros(len(s), np.int64)
    s, e, live, number = s.copy(), e.copy(), np.arange(len(s)), 0
    while len(live):
        level = levels[number]
        s2, e2, _, _ = level.cores(s[live], e[live])
        core = (s2 < e2) & (number < LEVELS)
        ends = live[~core]
        if len(ends):
            a, b = level.index[s[ends]], level.index[e[ends]]
            m = len(level.sym)
            span = (level.pos[1:] - level.pos[:-1]).astype(np.uint64)
            rank = (span << tk.U(57)) | (tk.mixed(level.sym + tk.U(number)) >> tk.U(7))
            best = a.copy()
            for j in range(1, int((b - a).max())):
                k = a + j
                better = (k < b) & (rank[np.minimum(k, m - 1)] > rank[best])
                best = np.where(better, k, best)
            name = level.sym[best] + tk.U(number)
            if number:
                low = levels[number - 1]
                name = tk.mixed(name * _MIX1 + low.sym[low.index[level.pos[best]] - 1]) * _MIX2 + low.sym[np.minimum(low.index[level.pos[best + 1]], len(low.sym) - 1)]
            key[ends] = tk.mixed(name)
            occurrence[ends] = (level.pos[best] << 4) | number
        s[live], e[live] = s2, e2
        live = live[core]
        number += 1
    return key, occurrence


def descriptions(levels: Levels, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each stretch's description: by level, the runs and symbols dropped on either side, then the symbols left."""
    one, two = np.full(len(s), 1, np.uint64), np.full(len(s), 2, np.uint64)

    def add(rows: np.ndarray, value: np.ndarray) -> None:
        one[rows] = tk.mixed(one[rows] * _MIX1 + value)
        two[rows] = tk.mixed((two[rows] ^ value) * _MIX2 + tk.U(0x5851F42D4C957F2D))

    s, e, live, number = s.copy(), e.copy(), np.arange(len(s)), 0
    while len(live):
        level = levels[number]
        s2, e2, led, trailed = level.cores(s[live], e[live])
        core = (s2 < e2) & (number < LEVELS)
        a, b = level.index[s[live]], level.index[e[live]]
        ends, x, y = live[~core], a[~core], b[~core]
        add(ends, np.uint64(2 * number + 1) + np.zeros(len(ends), np.uint64))
        for j in range(int((y - x).max(initial=0))):
            more = x + j < y
            add(ends[more], level.sym[x[more] + j])
        add(ends, (y - x).astype(np.uint64))
        live, a, b, led, trailed, s2, e2 = live[core], a[core], b[core], led[core], trailed[core], s2[core], e2[core]
        first, last = level.run[a], level.run[b - 1]
        # How long a run is outside the stretch does not matter: only its part inside is told.
        add(live, level.sym[a])
        add(live, (level.run_at[first + 1] - a).astype(np.uint64) * tk.U(4) + led.astype(np.uint64) * tk.U(2) + trailed)
        add(live[led], level.run_sym[first[led] + 1])
        add(live, level.sym[b - 1])
        add(live, (b - level.run_at[last]).astype(np.uint64))
        add(live[trailed], level.run_sym[last[trailed] - 1])
        s[live], e[live] = s2, e2
        number += 1
    return one, two


def all_windows(at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Starts of all windows within the texts that begin at `at`."""
    n = int(at[-1])
    return np.flatnonzero(np.repeat(at[1:], np.diff(at)) - np.arange(n) >= width)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    buf, off = tk.buffer_of(batch.column(column))
    for a, b in tk.chunks(off, CHUNK):
        part = buf[off[a] : off[b]]
        starts, ends, at = tk.word_spans(part, off[a : b + 1] - off[a], tk.BLANK)
        yield a, b, part, starts, ends, at, tk.word_hashes(part, starts, ends, lower=False)


def _joined(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> list[str]:
    """SHA-256 of each row's (kept) words joined by one blank."""
    if keep is not None:
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        starts, ends, at = starts[keep], ends[keep], kept_before[at]
    size = ends - starts + 1
    out = np.full(int(size.sum()), 0x20, np.uint8)
    begin = np.cumsum(size) - size
    place = np.repeat(begin, size - 1) + tk.ramp(size - 1)
    out[place] = part[np.repeat(starts, size - 1) + tk.ramp(size - 1)]
    edge = np.append(begin, len(out))
    raw = out.tobytes()
    return [hashlib.sha256(raw[edge[x] : max(edge[y] - 1, edge[x])]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By text, runs of windows with one high-level symbol occurrence: its key, the run's name, first window and number, and 1 at the occurrence's first run."""
    for batch in batches:
        for a, b, part, starts, ends, at, words in _texts(batch, 1):
            levels, win = Levels(words, at), all_windows(at)
            key, occurrence = high_symbols(levels, win, win + WIDTH)
            new = np.ones(len(win), bool)
            new[1:] = (occurrence[1:] != occurrence[:-1]) | (win[1:] != win[:-1] + 1)
            lead = np.flatnonzero(new)
            once = np.zeros(len(lead), np.int32)
            once[np.unique(occurrence[lead], return_index=True)[1]] = 1
            lists = pa.array(np.searchsorted(win[lead], at).astype(np.int32))
            base = np.repeat(at[:-1], np.diff(np.searchsorted(win[lead], at)))
            count = np.diff(np.append(lead, len(win)))
            name = descriptions(levels, win[lead], win[lead] + count + WIDTH - 1)[0]
            cols = [tk.as_long(key[lead]), tk.as_long(name), (win[lead] - base).astype(np.int32), count.astype(np.int32), once]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(_joined(part, starts, ends, at)), *(pa.ListArray.from_arrays(lists, pa.array(c)) for c in cols)],
                ["doc_id", "n_words", "sha", "key", "name", "start", "count", "once"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the windows in the wanted runs of each text."""
    for batch in batches:
        runs_at = np.asarray(batch.column(2).offsets).astype(np.int64)
        runs = batch.column(2).values
        start, count = (runs.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        for a, b, _part, _starts, _ends, at, words in _texts(batch, 1):
            own = slice(runs_at[a], runs_at[b])
            row = np.repeat(np.arange(b - a), np.diff(runs_at[a : b + 1]))
            n = count[own]
            pos = np.repeat(start[own], n) + tk.ramp(n)
            row = np.repeat(row, n)
            hit = pos + at[row]
            name, mark = descriptions(Levels(words, at), hit, hit + WIDTH)
            ids = batch.column(0).slice(a, b - a).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(tk.as_long(name)), pa.array((mark >> tk.U(32)).astype(np.uint32).view(np.int32)), pa.array(ids[row]), pa.array(pos.astype(np.int32))],
                ["name", "mark", "doc_id", "start"],
            )


def _grouped(run):
    """Small batches joined to ones of at least 64k rows."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def _kept(clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_at = np.asarray(batch.column(2).offsets).astype(np.int64)
            start, count = (batch.column(2).values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            for a, b, part, starts, ends, at, words in _texts(batch, 1):
                cover = np.zeros(len(words) + 1, np.int64)
                own = slice(runs_at[a], runs_at[b])
                lead = start[own] + np.repeat(at[:-1], np.diff(runs_at[a : b + 1]))
                np.add.at(cover, lead, 1)
                np.add.at(cover, lead + count[own] + WIDTH - 1, -1)
                keep = np.cumsum(cover)[: len(words)] <= 0
                before = np.concatenate([[0], np.cumsum(~keep)])
                cols = [batch.column(0).slice(a, b - a), pa.array(before[at[1:]] - before[at[:-1]]), pa.array(_joined(part, starts, ends, at, keep))]
                names = ["doc_id", "n_removed", "sha"]
                if clean:
                    texts = [b" ".join(part[starts[k] : ends[k]].tobytes() for k in range(at[i], at[i + 1]) if keep[k]).decode("utf-8", "replace") for i in range(b - a)]
                    cols.append(pa.array(texts, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, sha) of all texts, and (doc_id, runs: starts and numbers of windows that occur earlier)."""
    small_batches(docs.sparkSession, 1024)
    arrays = "key array<long>, name array<long>, start array<int>, count array<int>, once array<int>"
    symbols = written(docs.mapInArrow(_symbols, f"doc_id long, n_words long, sha string, {arrays}"), "symbols")
    each = symbols.select("doc_id", F.explode(F.arrays_zip("key", "name", "start", "count", "once")).alias("x")).select("doc_id", "x.*")
    # Written, so that the join below deals both sides anew and a very common symbol can be split.
    shared = written(each.groupBy("key").agg(F.sum("once").alias("n")).filter("n > 1").select("key"), "shared")
    runs = written(each.drop("once").join(shared, "key"), "runs")
    plain = written(symbols.select("doc_id", "n_words", "sha"), "plain")
    dropped(symbols, shared)
    same = ["key", "name", "count"]
    where = F.struct("doc_id", "start")
    firsts = written(runs.groupBy(*same).agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    again = written(runs.join(firsts.filter("n > 1").drop("n"), same).filter(where > F.col("first")).select("doc_id", "start", "count"), "again")
    dropped(runs)
    # Written for the same reason.
    several = written(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "several")
    open_runs = firsts.join(several, "key").select("first.doc_id", "first.start", "count")
    wanted = open_runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    windows = written(docs.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(_grouped(_windows), "name long, mark int, doc_id long, start int"), "windows")
    dropped(firsts, several)
    earliest = windows.groupBy("name", "mark").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(earliest, ["name", "mark"]).filter(where > F.col("first")).select("doc_id", "start", F.lit(1).alias("count"))
    repeats = written(again.unionByName(later).groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs")), "repeats")
    dropped(windows, again)
    return plain, repeats


def _columns(docs: DataFrame) -> DataFrame:
    return one_row_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every doc_id of docs(doc_id, text, ...).

    Null and empty texts have no words; the hash is that of the empty string, as it is where all words go. Texts shorter than
    a window lose nothing. Of rows with equal doc_id the one with the greatest text counts, rows without doc_id are left out, an empty
    table has no rows. Other columns are not looked at.
    """
    docs = _columns(docs)
    plain, repeats = repeated_windows(docs)
    cut = docs.join(repeats, "doc_id").select("doc_id", "text", "runs").mapInArrow(_kept(False), "doc_id long, n_removed long, sha string")
    out = plain.join(cut.withColumnRenamed("sha", "cut"), "doc_id", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut", "sha").alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with repeated words cut; texts that lose words have the others joined by one blank, null and empty texts stay. Rows as in removed."""
    docs = _columns(docs)
    plain, repeats = repeated_windows(docs)
    dropped(plain)
    cut = docs.join(repeats, "doc_id").select("doc_id", "text", "runs").mapInArrow(_kept(True), "doc_id long, n_removed long, sha string, text string")
    return docs.join(cut.select("doc_id", F.col("text").alias("cut")), "doc_id", "left").select("doc_id", F.coalesce("cut", "text").alias("text"))


def op3(spark, sf_dir: str) -> DataFrame:
    """removed over the whole documents table."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
