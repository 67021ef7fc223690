"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams (hashed) and of itself; a text is the mean of its words; a
softmax over two labels sits on top. Vectors and softmax are trained together in numpy on a bounded sample. As the
model is linear up to the softmax, each distinct word of a batch adds one number to a text's logit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .fit import held_out, sampled_texts
from .scratch import frugal, small_batches
from .words import Words

#: At most so many labelled texts of each label, of at most so many characters, are learned from.
PER_LABEL, MAX_CHARS = 2000, 12_000
BUCKETS, DIM, STEPS, RATE, DAMP, DECAY = 1 << 17, 8, 100, 0.3, 0.1, 3e-6
#: Neutral words added to every text, so that a few words do not decide alone; scale of the mean.
PAD, GAIN = 20, 30.0
GRAMS = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
CHUNK = 4 << 20


def word_features(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each distinct word, and offsets into them: itself and n-grams of it with its ends marked."""
    n = len(words.length)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    padded = words.length + 2
    start = np.cumsum(padded) - padded
    buf = np.full(int(padded.sum()), 0x20, np.uint8)
    buf[np.repeat(start + 1, words.length) + tk.ramp(words.length)] = words.buf
    owner, bucket = [np.arange(n)], [(words.hashes >> tk.U(7)) % tk.U(buckets)]
    for g in GRAMS:
        k = np.maximum(padded - g + 1, 0)
        at = np.repeat(start, k) + tk.ramp(k)
        owner.append(np.repeat(np.arange(n), k))
        bucket.append(tk.mixed(tk.word_hashes(buf, at, at + g, lower=False) + tk.U(g)) % tk.U(buckets))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(bucket).astype(np.int64)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]; ranges may be empty."""
    out = np.zeros(len(at) - 1, values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out


def trained(texts: list[str], labels: list[int]) -> np.ndarray | None:
    """What each bucket adds to the logit of label 1 (the last entry: the bias); None where labels do not differ.

    Of two softmax outputs only the difference counts, so one vector stands for both. The gradient of every bucket's
    vector is a multiple of that vector, so sparse products are made over numbers and not over vectors.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    words = Words(*tk.buffer_of(pa.array(texts, pa.large_string())))
    n = len(words.length)
    feat, feat_at = word_features(words)
    per_word = np.maximum(np.diff(feat_at), 1)
    feat_word = np.repeat(np.arange(n), np.diff(feat_at))
    counts = np.diff(words.at)
    pair, times = np.unique(np.repeat(np.arange(len(y)), counts) * n + words.inverse, return_counts=True)
    doc, word = np.divmod(pair, max(n, 1))
    doc_at = np.searchsorted(doc, np.arange(len(y) + 1))
    share = GAIN * times / (counts + PAD)[doc]
    by_word = np.argsort(word, kind="stable")
    word_at = np.searchsorted(word[by_word], np.arange(n + 1))
    rng = np.random.default_rng(7)
    vectors, top, bias = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.5, DIM), 0.0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    m, v, m_top, v_top = np.zeros_like(vectors), np.zeros_like(vectors), np.zeros(DIM), np.zeros(DIM)
    for t in range(1, STEPS + 1):
        each = _row_sums((vectors @ top)[feat], feat_at) / per_word
        p = 1 / (1 + np.exp(-np.clip(_row_sums(each[word] * share, doc_at) + bias, -500, 500)))
        err = (p - y) * weight
        g_word = _row_sums((err[doc] * share)[by_word], word_at) / per_word
        g_feat = np.bincount(feat, g_word[feat_word], minlength=BUCKETS)
        grad, g_top = g_feat[:, None] * top + DECAY * vectors, vectors.T @ g_feat + DECAY * top
        # Damped adaptive steps: a bucket that few texts use moves less.
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        size = np.sqrt(v / (1 - 0.99**t))
        vectors -= RATE * (m / (1 - 0.9**t)) / (size + DAMP * size.max() + 1e-300)
        m_top, v_top = 0.9 * m_top + 0.1 * g_top, 0.99 * v_top + 0.01 * g_top * g_top
        top -= 0.05 * (m_top / (1 - 0.9**t)) / (np.sqrt(v_top / (1 - 0.99**t)) + 1e-12)
        bias -= 0.5 * err.sum()
    return np.append(vectors @ top, bias)


def logits(words: Words, z: np.ndarray) -> np.ndarray:
    feat, at = word_features(words)
    each = _row_sums(z[feat], at) / np.maximum(np.diff(at), 1)
    return GAIN * words.doc_sums(each) / (np.diff(words.at) + PAD) + z[-1]


def _scored(z: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffer_of(batch.column(1))
            for a, b in tk.chunks(off, CHUNK):
                if z is None:
                    score = np.zeros(b - a)
                else:
                    score = 1 / (1 + np.exp(-np.clip(logits(Words(buf[off[a] : off[b]], off[a : b + 1] - off[a]), z), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...); labels: (doc_id, toxic, ...).

    Null and empty texts, and texts without a letter, get the bias alone. Several labels of one document: the larger counts. Where
    labels are missing or all alike, every score is 0. Repeated rows and rows without doc_id are judged each; an empty table has no rows. Other
    columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession, 1024)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = sampled_texts(docs, marks, per_label, MAX_CHARS, 2 * per_label)
    z = trained([t or "" for _, _, t in rows], [x for _, x, _ in rows])
    out = docs.mapInArrow(frugal(_scored(z)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1(spark, sf_dir: str) -> DataFrame:
    """scored over the whole documents table."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
