"""Whole results where a stage or operator once gave less: brute force at the stage's own settings, limits set small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tallyforge.llm import decontamination, language, mixing, near_dedup

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_stage_links_at_80(spark):
    """Pairs of 100 words of which one or two differ: some at similarity 0.80 to 0.85, some under 0.80."""
    rng = np.random.default_rng(5)
    src = []
    for i in range(60):
        text = [f"g{i}w{k}" for k in range(100)]
        src.append((2 * i, " ".join(text)))
        for k in rng.choice(100, 2 + i % 2, replace=False):
            text[k] = f"x{i}_{k}"
        src.append((2 * i + 1, " ".join(text)))
    sets = {i: shingles(t) for i, t in src}
    same = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)]
    assert sum(0.8 <= x < 0.85 for x in same) >= 10 and sum(x < 0.8 for x in same) >= 10
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in src], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id for r in cp.keep_one_of_each_group(spark, df, DATA).select("doc_id").collect()}
    assert got == {i for i in sets if i % 2 == 0 or same[i // 2] < 0.8}


@pytest.mark.parametrize("percent", [70, 80, 85, 100])
def test_bands_for_the_threshold(percent):
    n = near_dedup.bands_for(percent)
    assert (1 - (percent / 100) ** near_dedup.ROWS) ** n <= 1e-5 and n * near_dedup.ROWS * near_dedup.BITS % 64 == 0


def test_benchmark_of_several_groups(spark, monkeypatch):
    """Items that overlap in the text, repeated ids and rows without one: as many groups as wanted change nothing."""
    long = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(long[3 * i : 3 * i + 14])) for i in range(12)] + [(20, "a0 a1 a2 a3 a4 b0 b1 b2 b3 b4"), (21, "only two"), (22, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # Where "only two" is cut, words meet that are a window of item 20 but never stood side by side.
    apart = "a0 a1 a2 a3 a4 only two b0 b1 b2 b3 b4"
    src = [(1, "x " + " ".join(long) + " y", "en"), (1, apart, "de"), (None, " ".join(long[:20]) + ", and more", "en"), (None, apart, None), (2, None, "en"), (3, "", "en"), (4, "Clean text.", "en")]
    docs = spark.createDataFrame(src, "doc_id long, text string, lang string")
    key = lambda r: str(tuple(r))
    found = lambda: sorted(decontamination.contaminated(docs, bench).collect(), key=key)
    left = lambda: sorted((tuple(r) for r in decontamination.cleaned(docs, bench).collect()), key=str)
    one, rest = found(), left()
    assert len(one) == len(rest) == len(src) and (1, "a0 a1 a2 a3 a4  b0 b1 b2 b3 b4", "de") in rest
    for size in (300, 60):
        monkeypatch.setattr(decontamination, "GROUP_BYTES", size)
        assert len(decontamination._groups(bench)) >= 2
        assert found() == one and left() == rest


def test_mixing_stage_gives_texts(spark):
    """The last stage's rows are passages of the texts it was given, as many words of each as the plan says."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).cache()
    out = cp.mix(spark, docs, DATA)
    assert out.columns == ["shard", "place", "doc_id", "text"]
    got, given = out.collect(), {r.doc_id: " " + " ".join(r.text.split()) + " " for r in docs.collect() if r.text}
    taken: dict[int, int] = {}
    for r in got:
        assert f" {r.text} " in given[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split(" "))
    assert taken == {r.doc_id: r.taken for r in mixing.mixed(docs).collect() if r.taken}


def test_language_stage_judges_rows(spark):
    """A row without doc_id stays if its language is known; a row of a repeated doc_id is judged by its own text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").limit(150)
    more = [(None, "A plain English sentence without an id.", "en", "s"), (-1, "Another plain sentence.", "en", "s"), (-1, "12 34 ...", "en", "s"), (None, "!!", None, None), (-2, None, "en", "s")]
    out = cp.keep_identified(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), DATA)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert sorted((r for r in got if r[0] is None or r[0] < 0), key=str) == sorted(more[:2], key=str)
    assert sorted(r for r in got if r[0] is not None and r[0] >= 0) == sorted(tuple(r) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))


def test_whole_vocabulary():
    """Pieces of letters of all lengths and cases are kept, with and without the mark of a word's start."""
    own = language.pieces()
    assert max(map(len, own)) >= 24 and sum(p.startswith(b" ") for p in own) > 5000 and sum(p != p.lower() for p in own) > 2000
    assert b" the" in own and b"the" in own and b"The" in own
