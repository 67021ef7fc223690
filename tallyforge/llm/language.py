"""Language identification with segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. Texts are taken as words of letters, each after the
vocabulary's word-start mark; pieces of digits and signs cannot occur in them. A word's probability is the sum over all its
segmentations into pieces (forward algorithm, rescaled as it goes); a text's is the product over its words. Probabilities
are fitted by expectation-maximisation (forward-backward) on a bounded sample of labelled texts. Distinct words
are scored for all languages together, and a task keeps a bounded table of words it has scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import tokens as tk
from .fit import held_out, sampled_texts
from .scratch import frugal, small_batches
from .words import NOT_LETTER, Words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: At most so many labelled texts of each language, of at most so many characters, and so many in all, are learned from.
PER_LANG, MAX_CHARS, MAX_ROWS = 400, 20_000, 20_000
ROUNDS = 4
#: Bytes after which sums are rescaled: even bytes outside all pieces do not underflow until then.
RESCALE = 16
#: Bytes of a part of a very long word: its parts are gone through together, from each state that a part can begin in.
PART_BYTES = 4096
#: A byte outside all pieces.
FLOOR = 1e-7
UNKNOWN = "und"
CHUNK = 1 << 20
#: Stretches of words scored together.
BLOCK = 1 << 13
#: Numbers (words times languages) that a task keeps of scored words: 8 bytes each.
CACHE_CELLS = 1 << 20


#: The mark of a word's start: a byte that no word holds.
START = b" "


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces that are letters, with or without the word-start mark, sorted; on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {model.id_to_piece(i).replace("\u2581", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in own if p.removeprefix(START) and not NOT_LETTER[np.frombuffer(p.removeprefix(START), np.uint8)].any())


def marked(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and lengths of these distinct words, each after a word-start mark."""
    size = words.length[which] + 1
    start = np.cumsum(size) - size
    buf = np.full(int(size.sum()), START[0], np.uint8)
    buf[np.repeat(start + 1, size - 1) + tk.ramp(size - 1)] = words.buf[np.repeat(words.start[which], size - 1) + tk.ramp(size - 1)]
    return buf, start, size


class Pieces:
    """Finds pieces at all positions of a buffer: tables by hash, one for each piece length."""

    def __init__(self, own: list[bytes]):
        self.n, self.longest = len(own), max(map(len, own), default=0)
        self.tables = {}
        for size in sorted({len(p) for p in own}):
            index = np.array([i for i, p in enumerate(own) if len(p) == size], np.int32)
            buf = np.frombuffer(b"".join(own[i] for i in index), np.uint8)
            at = np.arange(len(index)) * size
            h = tk.word_hashes(buf, at, at + size, lower=False)
            order = np.argsort(h)
            # Few keys share their first 16 bits: most positions end at that look-up, the others look at a few keys.
            first = np.searchsorted(h[order], np.arange(1 << 16, dtype=np.uint64) << tk.U(48)).astype(np.int32)
            self.tables[size] = (h[order], index[order], first, np.diff(np.append(first, len(order))))

    def found(self, buf: np.ndarray) -> list[np.ndarray]:
        """For each size up to the longest, the piece of that size at each start, or n."""
        sums, scale = tk.prefix_sums(buf, lower=False)
        out = [np.full(len(buf), self.n, np.int16 if self.n < 1 << 15 else np.int32) for _ in range(self.longest + 1)]
        for size, (keys, index, first, count) in self.tables.items():
            m = len(buf) - size + 1
            if m <= 0:
                continue
            h = tk.mixed((sums[size:] - sums[:-size]) * scale[:m])
            slot = (h >> tk.U(48)).astype(np.int32)
            left = np.flatnonzero(count[slot])
            h, slot = h[left], slot[left]
            at, last = first[slot], first[slot] + count[slot]
            while len(left):
                hit = keys[at] == h
                out[size][left[hit]] = index[at[hit]]
                at += 1
                more = ~hit & (at < last)
                left, h, at, last = left[more], h[more], at[more], last[more]
        return out


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            yield int(lengths[group[0]]), group


def _forward(found: list[np.ndarray], lead: np.ndarray, size: np.ndarray, first: np.ndarray, own: Pieces, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of stretches that lie side by side, the longest first, and logs of what they were divided by.

    first: by age, the sums before a stretch's start (ring x stretches x languages). Returns the sums at the last ring's length of
    ends, the same way, and logs (stretches x languages). A stretch's look back before its own start finds pieces there.
    """
    ring, less = own.longest + 1, -size
    alpha, logs = first.copy(), np.zeros((len(lead), prob.shape[1]))
    out = np.zeros_like(alpha)
    age = np.arange(ring)
    for j in range(1, int(size[0]) + 1):
        longer, m = np.searchsorted(less, [-j, -j + 1])
        now = alpha[(j - 1) % ring, :m] * FLOOR
        for w in range(1, own.longest + 1):
            begin = lead[:m] + (j - w)
            piece = found[w][np.maximum(begin, 0)]
            hit = np.flatnonzero((piece < own.n) & (begin >= 0))
            if len(hit):
                now[hit] += alpha[(j - w) % ring, hit] * prob[piece[hit]]
        alpha[j % ring, :m] = now
        if j % RESCALE == 0:
            most = alpha[:, :m].max(axis=0)
            most[most == 0] = 1
            alpha[:, :m] /= most
            logs[:m] += np.log(most)
        out[:, longer:m] = alpha[(j - age) % ring, longer:m]
    return out, logs


def word_log_probabilities(buf: np.ndarray, start: np.ndarray, length: np.ndarray, own: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probabilities (words x languages); prob: (pieces + 1) x languages, its last row zero. Words lie side by side in buf."""
    found = own.found(buf)
    total = np.zeros((len(length), prob.shape[1]))
    order = np.argsort(-length, kind="stable")
    ring, begin = own.longest + 1, 0
    while begin < len(order) and length[order[begin]] > PART_BYTES:
        total[order[begin]] = _very_long(found, int(start[order[begin]]), int(length[order[begin]]), own, prob)
        begin += 1
    for k in range(begin, len(order), BLOCK):
        # All words of a block step through their bytes together, the shorter ones leave first.
        group = order[k : k + BLOCK]
        first = np.zeros((ring, len(group), prob.shape[1]))
        first[0] = 1
        sums, logs = _forward(found, start[group], length[group], first, own, prob)
        total[group] = np.log(sums[0]) + logs
    return total


def _very_long(found: list[np.ndarray], start: int, length: int, own: Pieces, prob: np.ndarray) -> np.ndarray:
    """As word_log_probabilities for one word of any length.

    The sums are linear in the last `longest` ones before a part. Parts are gone through together, from each of these alone, and
    their results, matrices, are multiplied one after the other.
    """
    n, langs = own.longest, prob.shape[1]
    lead = start + np.arange(0, length, PART_BYTES)
    size = np.minimum(start + length - lead, PART_BYTES)
    logs, state = np.zeros(langs), np.zeros((n, langs))
    state[0] = 1
    step = max(1, BLOCK // n)
    for k in range(0, len(lead), step):
        some = len(lead[k : k + step])
        first = np.zeros((n + 1, some * n, langs))
        first[-np.tile(np.arange(n), some) % (n + 1), np.arange(some * n)] = 1  # the sum that many bytes before the part
        sums, divided = _forward(found, np.repeat(lead[k : k + step], n), np.repeat(size[k : k + step], n), first, own, prob)
        for part in range(some):
            cols = slice(part * n, (part + 1) * n)
            if k == 0 and part == 0:
                sums[:, cols][:, 1:] = 0  # nothing lies before the word
            with np.errstate(divide="ignore"):  # a beginning that no segmentation goes on from has no weight
                weight = np.where(sums[:n, cols].max(axis=0) > 0, np.log(state) + divided[cols], -np.inf)
            most = weight.max(axis=0)
            state = np.einsum("aol,ol->al", sums[:n, cols], np.exp(weight - most))
            scale = state.max(axis=0)
            state /= scale
            logs += most + np.log(scale)
    return np.log(state[0]) + logs


def _expected(buf, start, length, weight, own: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the weighted words (forward-backward, rescaled by word)."""
    found = own.found(buf)
    out = np.zeros(own.n + 1)
    for n, group in _by_length(length):
        lead, m = start[group], len(group)
        # alpha[j] times exp(up[j]) is the sum over segmentations of the first j bytes; beta and down are those of the rest.
        alpha, beta, up, down = (np.zeros((n + 1, m)) for _ in range(4))
        alpha[0], beta[n] = 1, 1
        step = {}
        for j in range(1, n + 1):
            up[j] = up[j - 1]
            alpha[j] = alpha[j - 1] * FLOOR
            for w in range(1, min(j, own.longest) + 1):
                piece = found[w][lead + j - w]
                if (piece < own.n).any():
                    step[j, w] = piece
                    alpha[j] += alpha[j - w] * np.exp(up[j - w] - up[j]) * p[piece]
            if j % RESCALE == 0:
                up[j] += np.log(alpha[j])
                alpha[j] = 1
        for j in range(n - 1, -1, -1):
            down[j] = down[j + 1]
            beta[j] = beta[j + 1] * FLOOR
            for w in range(1, min(n - j, own.longest) + 1):
                if (j + w, w) in step:
                    beta[j] += beta[j + w] * np.exp(down[j + w] - down[j]) * p[step[j + w, w]]
            if j % RESCALE == 0:
                down[j] += np.log(beta[j])
                beta[j] = 1
        whole = up[n] + np.log(alpha[n])
        for (j, w), piece in step.items():
            out += np.bincount(piece, alpha[j - w] * p[piece] * beta[j] * np.exp(up[j - w] + down[j] - whole) * weight[group], minlength=own.n + 1)
    out[own.n] = 0
    return out


def trained(texts: list[tuple[str, str]], own: Pieces) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities ((pieces + 1) x languages), of (language, text) rows."""
    langs = sorted({x for x, _ in texts})
    prob = np.zeros((own.n + 1, len(langs)))
    counts = []
    for lang in langs:
        buf, off = tk.buffer_of(pa.array([t for x, t in texts if x == lang], pa.large_string()))
        words = Words(buf, off, lower=False)
        weight = np.bincount(words.inverse, minlength=len(words.length)).astype(float)
        own_words = marked(words, np.arange(len(words.length)))
        p = np.full(own.n + 1, 1 / max(own.n, 1))
        p[own.n] = 0
        c = np.zeros(own.n + 1)
        for _ in range(ROUNDS if len(words.length) else 0):
            c = _expected(*own_words, weight, own, p)
            p = (c + 1e-3) / (c.sum() + 1e-3 * own.n)
            p[own.n] = 0
        counts.append(c)
    pooled = sum(counts) + 0.01 if counts else None
    for k, c in enumerate(counts):
        # A piece that this language has not shown keeps a share of what all languages show.
        prob[:, k] = (c + 2.0 * own.n * 0.01 * pooled / pooled.sum()) / (c.sum() + 2.0 * own.n * 0.01)
    prob[own.n] = 0
    return langs, prob


class Scored:
    """Log probabilities of words that a task has met, by hash, so that frequent words are scored once a task.

    Bounded: a table beyond CACHE_CELLS numbers makes room by starting again with the newest chunk's words.
    """

    def __init__(self, own: Pieces, prob: np.ndarray, cells: int = CACHE_CELLS):
        self.own, self.prob, self.most = own, prob, cells // max(prob.shape[1], 1)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, prob.shape[1]))

    def of(self, words: Words) -> np.ndarray:
        """A row for each distinct word; words.hashes are sorted."""
        out = np.zeros((len(words.length), self.prob.shape[1]))
        at = np.searchsorted(self.keys, words.hashes)
        known = np.zeros(len(at), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == words.hashes
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = word_log_probabilities(*marked(words, new), self.own, self.prob)
            if len(self.keys) + len(new) <= self.most:
                self.keys, self.values = np.insert(self.keys, at[new], words.hashes[new]), np.insert(self.values, at[new], out[new], axis=0)
            elif len(out) <= self.most:
                self.keys, self.values = words.hashes, out
        return out


def _has_letter(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def _predicted(langs: list[str], prob: np.ndarray, own: list[bytes], text: int = 1, kept: tuple[int, ...] = (0,), names: tuple[str, ...] = ("doc_id",)):
    """The kept columns, with the verdict on column text beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scored(Pieces(own), prob)
        for batch in batches:
            buf, off = tk.buffer_of(batch.column(text))
            for a, b in tk.chunks(off, CHUNK):
                part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                words = Words(part, at, lower=False)
                score = words.doc_sums(scored.of(words)) if langs and len(words.length) else np.zeros((b - a, len(langs)))
                ascii_letters = np.concatenate([[0], np.cumsum(((part | 32) >= 97) & ((part | 32) <= 122))])
                some = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
                for i in np.flatnonzero(~some & (np.diff(words.at) > 0)):
                    some[i] = _has_letter(part[at[i] : at[i + 1]].tobytes())
                if langs:
                    post = np.exp(score - score.max(axis=1, keepdims=True))
                    post /= post.sum(axis=1, keepdims=True)
                    best = post.argmax(axis=1)
                    pred = [langs[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)]
                    value = np.where(some, post.max(axis=1), 0.0)
                else:
                    pred, value = [UNKNOWN] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in kept), pa.array(pred, pa.string()), pa.array(value)], [*names, "lang_pred", "score"])

    return run


def fitted(docs: DataFrame, path: str = VOCABULARY, per_lang: int = PER_LANG) -> tuple[list[bytes], list[str], np.ndarray]:
    """The pieces, languages and probabilities, of docs(doc_id, text, lang); the vocabulary is read on the driver alone."""
    own = pieces(path)
    rows = sampled_texts(docs.select("doc_id", "text", F.col("lang").alias("label")), None, per_lang, MAX_CHARS, MAX_ROWS)
    return own, *trained([(lang, text) for _, lang, text in rows if text], Pieces(own))


def identified(docs: DataFrame, path: str = VOCABULARY, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    A text that is null or has no letter is `und` with score 0, and so is every text where no row can be learned from.
    Repeated rows are judged each; other columns are not looked at. A row without doc_id is judged and never learned from. An empty table has no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    small_batches(docs.sparkSession)
    own, langs, prob = fitted(docs, path, per_lang)
    # Its many short-lived arrays would cost more to map anew than they hold.
    out = docs.select("doc_id", "text").mapInArrow(frugal(_predicted(langs, prob, own), at_once=False), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, path: str = VOCABULARY, per_lang: int = PER_LANG) -> DataFrame:
    """docs(doc_id, text, lang, ...) with lang_pred and score as in identified beside each row; all columns stay, those of these two names as given are replaced."""
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    own, langs, prob = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), path, per_lang)
    names = tuple(docs.columns)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(frugal(_predicted(langs, prob, own, names.index("text"), tuple(range(len(names))), names), at_once=False), schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """identified over the whole documents table."""
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
