"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels blank-separated words. It is trained in numpy from the small labelled table EXAMPLES and decoded by
Viterbi over batches of equal-length chains. A word without a digit, `@` or spelled-out `at`/`dot` can carry no label
but O, so chains are the runs of the other words, and O-words only give context to their neighbours: cutting the chain
there changes no best path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .scratch import frugal, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the base rules.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The base patterns for ip and card, in forms that read each digit once: a match always starts where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGITS = re.compile(r"[0-9]+")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPELLED = re.compile(r"(?i)[\[({<]?(at|dot)[\])}>]?")
LABELS = ("O", *KINDS)
FEATURES = 1 << 12
#: The labelled table: words with a label mark `word/KIND`; unmarked words are O.
EXAMPLES = (
    "write to jane.doe@mail.example.org/email today",
    "mail: john.smith/email (at)/email example/email (dot)/email com/email please",
    "contact anna_k/email [at]/email uni-town/email [dot]/email edu/email or not",
    "email bob77/email at/email host/email dot/email net/email now",
    "we asked mark99/email (at)/email home/email dot/email org/email about the plan",
    "answers went to lee/email [at]/email works/email dot/email de/email again",
    "it was sue.k/email {at}/email big-site/email [dot]/email com/email that wrote back",
    "send it to p_q/email at/email corner/email dot/email it/email before noon",
    "reach amy5/email {at}/email club/email (dot)/email net/email while we wait",
    "from tom/email [at]/email lab/email (dot)/email edu/email came no word",
    "they met at noon and put a dot on the map",
    "look at the dot on page 12 again",
    "call +1/phone (017)/phone 555-7713/phone before noon",
    "tel: (030)/phone 555-0199/phone or later",
    "phone 555-010-4477/phone ask for her",
    "fax 030/phone 555/phone 0177/phone thanks",
    "mobile: 0176-5550-1234/phone evenings",
    "tel 001-212-555-0123/phone extension 12",
    "call (212)/phone 555-0188/phone now",
    "server 10.0.0.17/ip answers on port 8080",
    "host 192.168.2.1/ip is down since 2019",
    "ip: 172.16.254.1/ip and gateway",
    "card 4012-8888-8888-1881/card expires 12/27",
    "visa 4111/card 1111/card 1111/card 1111/card was charged",
    "card: 378282246310005/card is valid",
    "in 2019 there were 1500 people",
    "version 1.2.3 of 2020-01-15 fixed 27 bugs",
    "chapter 12 page 345 line 6",
    "costs 19.99 or 1,299.00 at most",
    "on 12/05/2018 at 10:30 we met",
    "order 9807915762804490 shipped",
    "id 4736962573099581 of 20 items",
    "numbers 1 2 3 4 5 6 7 8 9 10 11 12",
    "the 3rd of 14 parts 555 7209 and 12 34",
    "flight LH4711 gate B22 seat 14C",
    "see section 3.4.1.2 of the report",
    "isbn 978-3-16-148410-0 in print",
    "room 101 at 5 dot 3 of them",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" ok",
    "a 100-200 range and 50-60 more",
    "build 20240115-1200 passed in 12.5 s",
    "looked at example 7 times",
    "score 21-15 21-18 in two sets",
    "years 1998-2003 and 2004-2010",
)
CUES = {
    "mail": "mail", "email": "mail", "e-mail": "mail", "contact": "mail", "write": "mail", "tel": "tel", "phone": "tel", "call": "tel", "mobile": "tel", "fax": "tel", "telephone": "tel",
    "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "version": "num", "section": "num", "chapter": "num", "page": "num",
    "isbn": "num", "order": "num", "id": "num", "token": "num", "on": "num", "in": "num", "costs": "num", "room": "num",
}


def shape(word: str) -> str:
    """Letters to a or A, digits to 9, runs of letters as one and of digits with their number up to 20."""
    out = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[^\x00-\x7F]+", "a", word)))
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", out)


def candidate(word: str) -> bool:
    return any("0" <= c <= "9" or c == "@" for c in word)


def _cue(word: str | None) -> str:
    return "none" if word is None else CUES.get(word.strip(".,;:!?\"'()[]").lower(), "other")


def features(before: list[str], word: str, after: str | None) -> list[str]:
    """Names of a word's features; before: the three words ahead of it, nearest last."""
    core = word.strip(".,;:!?\"'")
    s, digits = shape(core), sum(c.isdigit() for c in word)
    last = before[-1] if before else None
    out = ["b", "s=" + s, f"d={min(digits, 20)}", "first=" + s[:2], "p=" + (shape(last) if last and (candidate(last) or SPELLED.fullmatch(last)) else _cue(last))]
    out += ["c=" + c for c in {_cue(w) for w in before[-3:]} - {"other", "none"}]
    out.append("n=" + (shape(after) if after and (candidate(after) or SPELLED.fullmatch(after)) else "end" if after is None else "word"))
    if "@" in word:
        out.append("at")
    if SPELLED.fullmatch(core) or SPELLED.fullmatch(word):
        out.append("spelled" + ("-bare" if word.isalpha() else ""))
    if before and SPELLED.fullmatch(before[-1]) or after and SPELLED.fullmatch(after):
        out.append("by-spelled")
    dots, dashes = core.count("."), core.count("-")
    out.append(f"punct={dots},{dashes},{'(' in word},{'+' in word}")
    return out


def _bucket(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) % FEATURES


def _chain(words: list[str], i: int, j: int) -> list[list[int]]:
    return [[_bucket(f) for f in features(words[max(0, k - 3) : k], words[k], words[k + 1] if k + 1 < len(words) else None)] for k in range(i, j)]


def trained(examples=EXAMPLES, steps: int = 120, rate: float = 0.3, decay: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x labels) and transitions (labels x labels) by gradient ascent on the likelihood."""
    data = []
    for line in examples:
        words, labels = [], []
        for part in line.split(" "):
            w, _, lab = part.rpartition("/")
            words.append(w if lab in KINDS else part)
            labels.append(LABELS.index(lab) if lab in KINDS else 0)
        data.append((_chain(words, 0, len(words)), np.array(labels)))
    n = len(LABELS)
    emit, trans = np.zeros((FEATURES, n)), np.zeros((n, n))
    se, st = np.full_like(emit, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(steps):
        ge, gt = -decay * emit, -decay * trans
        for chain, gold in data:
            x = np.array([emit[f].sum(axis=0) for f in chain])
            t = len(chain)
            a, b = np.zeros((t, n)), np.zeros((t, n))
            a[0] = x[0]
            for k in range(1, t):
                a[k] = x[k] + np.logaddexp.reduce(a[k - 1][:, None] + trans, axis=0)
            for k in range(t - 2, -1, -1):
                b[k] = np.logaddexp.reduce(trans + (x[k + 1] + b[k + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(a[-1])
            p = np.exp(a + b - z)
            for k in range(t):
                ge[chain[k]] -= p[k]
                ge[chain[k], gold[k]] += 1
                if k:
                    gt -= np.exp(a[k - 1][:, None] + trans + (x[k] + b[k])[None, :] - z)
                    gt[gold[k - 1], gold[k]] += 1
        se += ge * ge
        st += gt * gt
        emit += rate * ge / np.sqrt(se)
        trans += rate * gt / np.sqrt(st)
    return emit, trans


def viterbi(emissions: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Best labels of each chain; chains of one length are decoded together. Both ends of a chain border on O."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
    lengths = np.array([len(e) for e in emissions])
    for t in np.unique(lengths):
        at = np.flatnonzero(lengths == t)
        x = np.stack([emissions[i] for i in at])
        score, back = x[:, 0] + trans[0], []
        for k in range(1, t):
            step = score[:, :, None] + trans[None]
            back.append(step.argmax(axis=1))
            score = step.max(axis=1) + x[:, k]
        lab = (score + trans[:, 0]).argmax(axis=1)
        path = [lab]
        for bp in reversed(back):
            lab = bp[np.arange(len(at)), lab]
            path.append(lab)
        for i, row in zip(at, np.stack(path[::-1], axis=1), strict=True):
            out[i] = row
    return out


def in_byte(part: str) -> bool:
    """Whether these ASCII digits, of any number, are at most 255."""
    tail = part.lstrip("0")
    return len(tail) < 3 or (len(tail) == 3 and tail <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if m and start < at:
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(map(in_byte, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def chains(text: str) -> tuple[list[list[list[int]]], list[list[tuple[int, int]]]]:
    """Feature rows and word spans of the chains of a text: runs of words that can carry a label."""
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    can = [candidate(w) for w in words]
    # Spelled-out signs and their neighbours can be part of an address.
    for k, w in enumerate(words):
        if w[-2:].lower() in ("at", "t]", "t)", "t}", "t>") and SPELLED.fullmatch(w) and 0 < k < len(words) - 1 and any(SPELLED.fullmatch(x) for x in words[k + 2 : k + 4]):
            for i in range(k - 1, min(k + 5, len(words))):
                can[i] = True
    rows, places, k = [], [], 0
    while k < len(words):
        if not can[k]:
            k += 1
            continue
        j = k
        while j < len(words) and can[j]:
            j += 1
        rows.append(_chain(words, k, j))
        places.append(spans[k:j])
        k = j
    return rows, places


def _added(text: str, places: list[tuple[int, int]], labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Labelled runs as spans, trimmed of punctuation, that touch no base span and hold what their kind needs."""
    out, k = [], 0
    while k < len(labels):
        j = k + 1
        while j < len(labels) and labels[j] == labels[k]:
            j += 1
        if labels[k]:
            a, b = places[k][0], places[j - 1][1]
            while a < b and text[a] in ".,;:!?\"'|":
                a += 1
            while a < b and text[b - 1] in ".,;:!?\"'|#$%&*":
                b -= 1
            kind, digits = int(labels[k]) - 1, len(NOT_DIGIT.sub("", text[a:b]))
            fits = (
                ("@" in text[a:b] or re.search(r"(?i)\bat\b.*\bdot\b", text[a:b], re.S) is not None,)
                if kind == 0
                else (digits >= 4 and text[a:b].count(".") == 3 and all(DIGITS.fullmatch(p) and in_byte(p) for p in text[a:b].split(".")),)
                if kind == 1
                else (13 <= digits <= 19 and luhn(NOT_DIGIT.sub("", text[a:b])),)
                if kind == 2
                else (7 <= digits <= 15,)
            )[0]
            if fits and not any(s < b and a < e for s, _, e in base):
                out.append((a, kind, b))
        k = j
    return out


_INTEREST = np.zeros(256, bool)
_INTEREST[48:58] = True
_INTEREST[64] = True
_SPELL = re.compile(r"(?i)[\s\[({<]dot[\s\])}>]")


def found_in(texts: list[str], emit: np.ndarray, trans: np.ndarray) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, in order."""
    out, emissions, owner = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, list(base)))
        for rows, places in zip(*chains(text), strict=True):
            emissions.append(np.array([emit[f].sum(axis=0) for f in rows]))
            owner.append((i, places))
    for (i, places), labels in zip(owner, viterbi(emissions, trans), strict=True):
        if labels.any():
            out[i][1].extend(_added(texts[i], places, labels, out[i][0]))
    return [(b, sorted(e)) for b, e in out]


def _found(emit: np.ndarray, trans: np.ndarray):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("no", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffer_of(batch.column(1))
            hits = np.concatenate([[0], np.cumsum(_INTEREST[buf])])
            some = hits[off[1:]] > hits[off[:-1]]
            for i in np.flatnonzero(~some):
                some[i] = b"dot" in (raw := buf[off[i] : off[i + 1]].tobytes().lower()) and _SPELL.search(raw.decode("utf-8", "replace")) is not None
            which = np.flatnonzero(some)
            got = dict(zip(which.tolist(), found_in([buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in which], emit, trans), strict=True))
            row = lambda spans: [{"start": s, "no": k, "end": e, "kind": KINDS[k]} for s, k, e in spans]
            cols = [pa.array([row(got[i][c]) if i in got else [] for i in range(batch.num_rows)], kind) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    return run


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of docs(doc_id, text, ...): arrays of (start, no, end, kind), end exclusive.

    Positions are code points. Null and empty texts have no span. Repeated rows are judged each; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    emit, trans = trained()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = "array<struct<start:int,no:int,end:int,kind:string>>"
    return docs.mapInArrow(frugal(_found(emit, trans)), f"doc_id long, base {span}, spans {span}")


def digest(rows: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op5(spark, sf_dir: str) -> DataFrame:
    """found over the whole documents table."""
    return digest(found(spark.read.parquet(f"{sf_dir}/documents.parquet")))
