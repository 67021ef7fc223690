"""Scores of whole documents against plain Python: every word on its own, every segmentation by dictionary."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import language, tokens, toxicity
from tallyforge.llm.words import NOT_LETTER, Words

DATA = "/root/testdata/sf0.001"


def letters(raw: bytes) -> list[bytes]:
    return bytes(b if not NOT_LETTER[b] else 0x20 for b in raw).split()


def test_language_scores(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    own, langs, prob = language.fitted(docs)
    index = {p: k for k, p in enumerate(own)}
    longest, known = max(map(len, own)), {}

    def word(w: bytes) -> np.ndarray:
        if w not in known:
            sums = np.zeros((len(w) + 1, len(langs)))
            sums[0] = 1
            for j in range(1, len(w) + 1):
                sums[j] = sums[j - 1] * language.FLOOR
                for k in range(max(0, j - longest), j):
                    if (at := index.get(w[k:j])) is not None:
                        sums[j] += sums[k] * prob[at]
            known[w] = np.log(sums[-1])
        return known[w]

    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs).collect()}
    for r in docs.filter(F.length("text") < 4000).orderBy("doc_id").limit(40).collect():
        words = letters((r.text or "").encode())
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        total = sum((word(b" " + w) for w in words), np.zeros(len(langs)))
        post = np.exp(total - total.max())
        assert got[r.doc_id][0] == langs[int(total.argmax())] and got[r.doc_id][1] == pytest.approx(post.max() / post.sum(), abs=1e-6)


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    marks = labels.select("doc_id", F.col("toxic").alias("label"))
    rows = toxicity.sampled_texts(docs.select("doc_id", "text"), marks, toxicity.PER_LABEL, toxicity.MAX_CHARS, 2 * toxicity.PER_LABEL)
    z = toxicity.trained([t for _, _, t in rows], [x for _, x, _ in rows])
    each = {}

    def hashed(raw: bytes) -> int:
        return int(tokens.word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), lower=False)[0])

    def word(w: bytes) -> float:
        """The mean weight of the word itself and its n-grams between blanks."""
        if w not in each:
            own = [(int(Words(*tokens.buffer_of(pa.array([w.decode()]))).hashes[0]) >> 7) % toxicity.BUCKETS]
            padded = b" " + w + b" "
            for n in toxicity.GRAMS:
                own += [int(tokens.mixed(np.array([hashed(padded[k : k + n]) + n], np.uint64))[0]) % toxicity.BUCKETS for k in range(len(padded) - n + 1)]
            each[w] = float(np.mean(z[own]))
        return each[w]

    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    for r in docs.filter(F.length("text") < 1500).orderBy("doc_id").limit(25).collect():
        words = [w for w in letters((r.text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]
        logit = toxicity.GAIN * sum(map(word, words)) / (len(words) + toxicity.PAD) + z[-1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
