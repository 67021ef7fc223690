"""Secret scans: known forms by pattern, and random-looking tokens by a battery of randomness tests.

Only DataFrame and SQL functions run here. A token gets the encoding of the smallest alphabet that holds it. Under the
hypothesis that its characters are drawn evenly and independently from that alphabet, three tests give a p-value each:
the chi-squared statistic of the alphabet's uniformity (as the number of coinciding pairs, by a gamma law of its exact
first three moments), runs about the alphabet's middle (binomial), and the serial correlation at lag one (normal with the
exact fourth moment). They depend on each other, so they are joined by Cauchy's combination, which holds then too.

Within a class of one encoding and one octave of lengths, a step-up procedure rejects randomness: tokens rejected (words,
names, counters, paths) are no secrets, the others are reported. What is controlled, at ALPHA, is the share of random tokens among
those that a class rejects, that is of secrets among what is passed over. It steps over a grid of p-values of 100 to a power of ten, by
counts of fixed number, so a threshold is at most 2.4 % below that of Benjamini and Hochberg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Fixed values of the base rules: kind, pattern, the group whose length counts, and its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Candidates: runs of at least 20 characters, of base64's alphabet, or of its URL-safe one where they hold one of its own signs.
TOKENS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}")
OWN_SIGN = "[_-]"
RANDOM = "random"
#: Share of random tokens among those rejected as not random; steps of the grid to a power of ten, and its last power.
ALPHA, STEPS, LAST = 0.05, 100, 30
MARK = "[SECRET]"
#: Name, pattern, alphabet, and whether case is folded to it. A token of one case of letters alone, or of digits alone, is a word or a number.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", "lower"),
    ("base32", "^([A-Z2-7]+|[a-z2-7]+)$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "upper"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", "lower"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ""),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ""),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", ""),
)
#: Matches whose positions are summed in one fold; folds of a text are joined by a fold over their sums.
FOLD = 128


def _sql(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _spans(pattern: str, group: int, kind: str, no: int, gate: str) -> Column:
    """Matches of the pattern in text: structs (start, no, end, kind, size of group, value), by code points.

    split() gives what lies between matches and regexp_extract_all() the matches; running sums of lengths are positions. A
    fold copies what it holds at each step, so it runs over FOLD matches, from where a fold over all such parts says.
    """
    p = _sql(pattern)
    row = "struct<start:int,no:int,end:int,kind:string,size:int,value:string>"
    whole = "x['1']" if group == 0 else f"regexp_extract(x['1'], {p}, {group})"
    matches = f"""transform(filter(arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0)), x -> x['1'] is not null),
        x -> named_struct('gap', char_length(x['0']), 'len', char_length(x['1']), 'size', char_length({whole}), 'value', x['1']))"""
    steps = [
        ("l", matches),
        ("parts", f"transform(sequence(0, (size(l) - 1) div {FOLD}), k -> slice(l, cast(k * {FOLD} + 1 as int), {FOLD}))"),
        ("sums", "transform(parts, part -> aggregate(part, 0, (s, x) -> s + x.gap + x.len))"),
        ("begins", "aggregate(sums, cast(array(0) as array<int>), (acc, s) -> concat(acc, array(element_at(acc, -1) + s)))"),
    ]
    out = f"""flatten(zip_with(parts, slice(begins, 1, size(parts)), (part, begin) -> aggregate(part,
            named_struct('at', begin, 'out', cast(array() as array<{row}>)),
            (acc, x) -> named_struct('at', acc.at + x.gap + x.len,
              'out', concat(acc.out, array(named_struct('start', acc.at + x.gap, 'no', {no}, 'end', acc.at + x.gap + x.len, 'kind', '{kind}', 'size', x.size, 'value', x.value)))),
            acc -> acc.out)))"""
    return F.expr(f"if({gate} and text rlike {p}, {_named(steps, out)}, cast(array() as array<{row}>))")


def _named(steps: list[tuple[str, str]], out: str) -> str:
    """SQL of out, in which each step's value has a name: a lambda over a one-element array names a value once."""
    for name, value in reversed(steps):
        out = f"element_at(transform(array({value}), {name} -> {out}), 1)"
    return out


def _battery() -> str:
    """SQL of the joined p-value of token t over alphabet a (of even size)."""

    def tail(z: str) -> str:
        """The normal upper tail, to a relative 1.2e-7 everywhere (the Chebyshev fit of erfc in Numerical Recipes)."""
        x = f"(abs({z}) / sqrt(2D))"
        u = f"(1 / (1 + {x} / 2))"
        # Fixed values of that fit.
        fit = "-1.26551223D", "1.00002368D", "0.37409196D", "0.09678418D", "-0.18628806D", "0.27886807D", "-1.13520398D", "1.48851587D", "-0.82215223D", "0.17087277D"
        poly = fit[-1]
        for c in reversed(fit[:-1]):
            poly = f"({c} + {u} * {poly})"
        return f"if({z} >= 0, 0.5D * {u} * exp(-{x} * {x} + {poly}), 1 - 0.5D * {u} * exp(-{x} * {x} + {poly}))"

    steps = [
        ("v", "transform(filter(split(t, ''), c -> c <> ''), c -> locate(c, a) - 1)"),
        ("n", "cast(size(v) as double)"),
        ("m", "cast(char_length(a) as double)"),
        # Chi-squared is m / n * (n + 2 * pairs) - n. Pairs that coincide: exact mean, variance and third moment of an even draw.
        ("pairs", "aggregate(array_distinct(v), 0D, (s, k) -> s + element_at(transform(array(cast(size(filter(v, i -> i = k)) as double)), c -> c * (c - 1) / 2), 1))"),
        ("k2", "n * (n - 1) / 2 / m * (1 - 1 / m)"),
        ("k3", "k2 * (1 - 2 / m) + n * (n - 1) * (n - 2) / m / m * (1 - 1 / m)"),
        ("shape", "4 * k2 * k2 * k2 / k3 / k3"),
        ("scale", "k3 / k2 / 2"),
        # A shifted gamma law by Wilson and Hilferty, with half a step for the whole numbers.
        ("g", "greatest((pairs - 0.5D - n * (n - 1) / 2 / m) / scale + shape, 1e-9D)"),
        ("z1", "(pow(g / shape, 1 / 3D) - 1 + 1 / (9 * shape)) * 3 * sqrt(shape)"),
        ("p1", tail("z1")),
        # Changes of side of the alphabet's middle: each of n - 1 places with probability one half.
        ("next", "zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> named_struct('x', cast(x as double), 'y', cast(y as double)))"),
        ("changes", "cast(size(filter(next, d -> (d.x * 2 >= m) <> (d.y * 2 >= m))) as double)"),
        ("z2", "greatest(abs(changes - (n - 1) / 2) - 0.5D, 0D) / sqrt((n - 1) / 4)"),
        ("p2", f"2 * {tail('z2')}"),
        # Serial correlation: terms are uncorrelated, of variance 1; the fourth moment corrects the normal tail.
        ("z3", "abs(aggregate(next, 0D, (s, d) -> s + (d.x - (m - 1) / 2) * (d.y - (m - 1) / 2))) / ((m * m - 1) / 12) / sqrt(n - 1)"),
        ("m4", "3 * (3 * m * m - 7) / 5 / (m * m - 1)"),
        ("k4", "((n - 1) * m4 * m4 + 3 * (2 * (n - 2) * m4 + (n - 2) * (n - 3))) / (n - 1) / (n - 1) - 3"),
        ("p3", f"2 * ({tail('z3')} + exp(-z3 * z3 / 2) / sqrt(2 * pi()) * k4 / 24 * greatest(z3 * z3 * z3 - 3 * z3, 0D))"),
        # Cauchy's combination; a p-value of nearly one must not outweigh the others.
        ("sum", "aggregate(array(p1, p2, p3), 0D, (s, p) -> s + if(p < 1e-9D, 1 / (pi() * greatest(p, 1e-290D)), tan(pi() * (0.5D - least(p, 0.95D)))) / 3)"),
    ]
    return _named(steps, "if(sum > 1e9D, 1 / (pi() * sum), 0.5D - atan(sum) / pi())")


def _tested(found: str) -> str:
    """SQL: of these candidates those of an encoding, as structs (start, no, end, kind, cls, p, step). cls: encoding and octave of the length."""
    case = lambda what: "case " + " ".join(f"when x.value rlike '{e[1]}' then {what(e)}" for e in ENCODINGS) + " end"
    mixed = "(x.value rlike '[0-9]' and x.value rlike '[A-Za-z]') or (x.value rlike '[a-z]' and x.value rlike '[A-Z]')"
    fold = case(lambda e: f"{e[3]}(x.value)" if e[3] else "x.value")
    p = _named([("t", fold), ("a", case(lambda e: f"'{e[2]}'"))], _battery())
    return f"""transform(transform(filter({found}, x -> {mixed}),
        x -> named_struct('x', x, 'cls', concat({case(lambda e: f"'{e[0]}'")}, ':', cast(floor(log2(x.size)) as string)), 'p', {p})),
        y -> named_struct('start', y.x.start, 'no', y.x.no, 'end', y.x.end, 'kind', y.x.kind, 'cls', y.cls, 'p', y.p,
            'step', cast(least(floor(-log10(greatest(y.p, 1e-290D)) * {STEPS}), {LAST * STEPS}) as int)))"""


def _at_least(size: int):
    return lambda x: x["size"] >= size


def examined(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with columns base (spans of the known forms in order) and tokens (candidates that touch none, with p-values).

    Rows come with a text that is never null and without columns of these names.
    """
    gates = {"assign": "(contains(text, ':') or contains(text, '='))", "access": "contains(text, 'AKIA')", "hex": "text rlike '[0-9a-f]{24}'"}
    parts = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        parts.append(F.filter(_spans(pattern, group, kind, no, gates[kind]), _at_least(least)))
    base = F.array_sort(F.transform(F.concat(*parts), lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"])))
    plain, safe = (_spans(t, 0, RANDOM, len(BASE), "true") for t in TOKENS)
    out = rows.withColumn("base", base).withColumn("tokens", F.concat(plain, F.filter(safe, lambda x: x["value"].rlike(OWN_SIGN))))
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return out.withColumn("tokens", F.filter("tokens", clear)).withColumn("tokens", F.expr(_tested("tokens")))


def thresholds(seen: DataFrame, alpha: float = ALPHA) -> dict[str, int]:
    """By length class, the step (a power of 10 to -step / STEPS) from which on randomness is rejected. Classes and steps are of fixed number.

    What lies on the last step is at most 10 to -LAST: the procedure rejects it in a class of any size.
    """
    each = seen.select(F.explode("tokens").alias("t")).select("t.cls", "t.step")
    rows = each.groupBy("cls", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, int] = {}
    for cls in {r.cls for r in rows}:
        steps = sorted(((r.step, r.n) for r in rows if r.cls == cls), reverse=True)
        total, below = sum(n for _, n in steps), 0
        for k, n in steps:
            below += n
            if 10 ** (-k / STEPS) <= alpha * below / total:
                out[cls] = k
    return out


def flagged(seen: DataFrame, limits: dict[str, int]) -> DataFrame:
    """With column spans: base spans and the tokens whose randomness is not rejected, by start, then kind."""
    if limits:
        table = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
        kept = F.filter("tokens", lambda t: t["step"] < F.coalesce(F.element_at(table, t["cls"]), F.lit(LAST * STEPS + 1)))
    else:
        kept = F.col("tokens")
    return seen.withColumn("spans", F.array_sort(F.concat("base", F.transform(kept, lambda t: F.struct(t["start"], t["no"], t["end"], t["kind"])))))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of docs(doc_id, text, ...): arrays of (start, no, end, kind), end exclusive.

    A null text is empty and has no span. Repeated rows are judged each; rows without doc_id too. Positions are code
    points. Other columns are not looked at. Tokens of under 20 characters, of digits only and of letters of one case only are not tested.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = written(examined(docs).drop("text"), "secrets")
    return flagged(seen, thresholds(seen)).select("doc_id", "base", "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with every span of a secret (overlapping ones as one) replaced by MARK.

    Rows, their number and all other columns stay, whatever their names; a null or empty text stays too. Each text is examined once, in a
    written table, which the thresholds are counted over and the texts are cut from.
    """
    given = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]
    rows = docs.select(F.struct(F.lit(0).alias("c"), *given).alias("given"), F.col("text").isNull().alias("null_text"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = written(examined(rows), "secrets")
    own = flagged(seen, thresholds(seen))
    # Pieces between spans: overlapping spans are joined first, so that each piece is taken once.
    merged = """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end > s.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(named_struct('start', s.start, 'end', s.end)))))"""
    pieces = f"""concat(array_join(transform(m, (s, i) -> substring(text, if(i = 0, 1, m[i - 1].end + 1), s.start - if(i = 0, 0, m[i - 1].end))), '{MARK}'),
        '{MARK}', substring(text, element_at(m, -1).end + 1, char_length(text)))"""
    cut = F.expr(_named([("m", merged)], pieces))
    text = F.when(F.col("null_text"), F.lit(None).cast("string")).when(F.size("spans") > 0, cut).otherwise(F.col("text"))
    return own.select(*[text.alias("text") if c == "text" else F.col("given")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])


def digest(rows: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op8(spark, sf_dir: str) -> DataFrame:
    """found over the whole documents table."""
    return digest(found(spark.read.parquet(f"{sf_dir}/documents.parquet")))
