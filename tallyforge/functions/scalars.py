"""Column functions of the record model: built-in expressions, but for the decomposition of characters in slugs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Foul symbols with their kind and free throws; symbols of cancelled penalties; accepted labels.
FOUL_SYMBOLS = (
    ("P", "personal", None), ("P1", "personal", 1), ("P2", "personal", 2), ("P3", "personal", 3),
    ("T", "technical", None), ("T1", "technical", 1),
    ("U", "unsportsmanlike", None), ("U1", "unsportsmanlike", 1), ("U2", "unsportsmanlike", 2), ("U3", "unsportsmanlike", 3),
    ("D", "disqualifying", None), ("D2", "disqualifying", 2), ("GD", "disqualifying", None),
    ("PC", "personal", None), ("TC", "technical", None), ("UC", "unsportsmanlike", None), ("DC", "disqualifying", None),
)
CANCELLED = ("PC", "TC", "UC", "DC")
SEVERITY = ("accepted", "review", "unresolved")


def severity(status: Column) -> Column:
    """accepted 0, review 1, unresolved 2."""
    return F.when(status == "unresolved", 2).when(status == "review", 1).otherwise(0)


def status_of(rank: Column) -> Column:
    """The status of a severity; a missing one is accepted."""
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce(rank, F.lit(0)) + 1)


def foul_symbol(symbol: Column) -> Column:
    """struct(kind, free_throws, cancelled, fighting, counts) of a written symbol; unknown ones have kind unknown."""
    s = F.replace(F.upper(F.trim(symbol)), F.lit(" "), F.lit(""))
    kinds = F.create_map(*[F.lit(x) for k, v, _ in FOUL_SYMBOLS for x in (k, v)])
    throws = F.create_map(*[F.lit(x) for k, _, n in FOUL_SYMBOLS if n for x in (k, n)])
    kind = F.coalesce(F.element_at(kinds, s), F.lit("unknown"))
    cancelled, fighting = F.coalesce(s.isin(*CANCELLED), F.lit(False)), F.coalesce(s == "GD", F.lit(False))
    return F.struct(kind.alias("kind"), F.element_at(throws, s).alias("free_throws"), cancelled.alias("cancelled"), fighting.alias("fighting"), ((kind != "unknown") & ~cancelled & ~fighting).alias("counts"))


def period_of_foul(slot: Column, first_half_slots: Column, ink: Column) -> Column:
    """Red and blue mean the first and second period before the half separator, the third and fourth after it."""
    early = slot <= first_half_slots
    return F.when(ink == "red", F.when(early, 1).otherwise(3)).when(ink == "blue", F.when(early, 2).otherwise(4)).cast("long") * F.when(first_half_slots.isNotNull(), 1)


def shot(mark: Column, circled: Column) -> Column:
    """struct(shot_type, points): a free-throw mark 1, a circled field goal 3, a field goal 2, else ambiguous 0."""
    field = mark == "field_goal"
    kind = F.when(mark == "free_throw", "free_throw").when(field & circled, "three_point").when(field, "two_point").otherwise("ambiguous")
    return F.struct(kind.alias("shot_type"), F.when(kind == "free_throw", 1).when(kind == "three_point", 3).when(kind == "two_point", 2).otherwise(0).alias("points"))


def split_bucket(key: Column, seed: str) -> Column:
    """The first eight bytes of sha256(seed:key) as a share of 2 ** 64."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def split_name(bucket: Column, train: float = 0.70, validation: float = 0.15) -> Column:
    if not (0 < train < 1 and 0 <= validation < 1 and train + validation < 1):
        raise ValueError("ratios must leave a share for each split")
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def anonymous_writer(name: Column) -> Column:
    """Null if blank, else writer_ and twelve hex digits."""
    n = F.lower(F.trim(name))
    return F.when(F.length(n) > 0, F.concat(F.lit("writer_"), F.substring(F.sha2(F.concat(F.lit("writer:"), n), 256), 1, 12)))


def crop_id(document: Column, kind: Column, *position: Column) -> Column:
    """Twenty hex digits of sha256 over document|kind|position; a missing part is written None."""
    parts = [F.coalesce(p.cast("string"), F.lit("None")) for p in (document, kind, *position)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def number_in(text: Column, low: int = 0, high: int = 99) -> Column:
    """The integer of a text if it is one within the range, else null; signs and leading zeros are read, blanks around it are not."""
    n = F.when(F.trim(text).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(text).cast("long"))
    return F.when(n.between(low, high), n)


def capture_condition(extension: Column) -> Column:
    e = F.lower(extension)
    return F.when(e.isin("jpg", "jpeg", "png"), "camera_image").when(e == "pdf", "pdf_scan").otherwise("other")


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """array(left, top, right, bottom) in pixels, halves to even."""
    return F.array(*[F.bround(v, 0).cast("int") for v in (x * width, y * height, (x + w) * width, (y + h) * height)])


def trainable(model_trainable: Column, state: Column, label: Column) -> Column:
    return F.coalesce(model_trainable, F.lit(True)) & state.isin("accepted", "adjusted") & label.isNotNull()


def checked(value: Column, bad: Column, message: Column | str) -> Column:
    """value; a row for which bad holds fails the query with the message."""
    stop = F.raise_error(message if isinstance(message, Column) else F.lit(message))
    return F.when(F.coalesce(bad, F.lit(False)), stop).otherwise(value)


@F.pandas_udf(StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slug(text: Column, empty: str = "documento") -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash, none at the ends; `empty` where nothing is left.

    Only texts with characters beyond ASCII go through Python.
    """
    plain = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_ascii(text))
    words = F.lower(F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(text.isNotNull(), F.when(words == "", empty).otherwise(words))


def path_parts(name: Column) -> Column:
    """The non-empty parts of an archive's entry name, both slashes apart."""
    return F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))


def safe_path(name: Column) -> Column:
    """Whether an entry lies in a folder below the archive's root: no slash ahead, no step up, two parts or more."""
    p = path_parts(name)
    return ~F.translate(name, "\\", "/").startswith("/") & ~F.array_contains(p, "..") & (F.size(p) >= 2)


def category_of(name: Column) -> Column:
    """The folder that holds the entry; an unsafe name fails."""
    return checked(F.element_at(path_parts(name), -2), ~safe_path(name), F.concat(F.lit("Unsafe or uncategorized path in ZIP: "), name))


def document_id(category: Column, stem: Column, sha256: Column) -> Column:
    """slug of the category, slug of the file's stem, first eight digits of its hash."""
    return F.concat_ws("-", slug(category), slug(stem), F.substring(sha256, 1, 8))


def position_of(field_type: Column, team: Column, running_score: Column, row: Column, slot: Column, crop_path: Column) -> Column:
    """What tells crops of one document and type apart; a missing part is written None."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    score, foul = F.concat_ws(":", part(team), part(running_score)), F.concat_ws(":", part(team), part(row), part(slot))
    return F.when(field_type.isin("jersey", "scoring_event"), score).when(field_type.isin("foul_symbol", "foul_event", "foul_terminal"), foul).otherwise(F.coalesce(crop_path, F.lit("")))


def result_id(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-1 of parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def three_point_confidence(mark: Column, circle: Column) -> Column:
    """The lesser of both, to four digits."""
    return F.bround(F.least(mark, circle), 4)


def team_foul_indicator(x_count: Column, minimum: Column | None = None) -> Column:
    """struct(x_count, count_is_capped, minimum_team_fouls): four boxes mean four or more; a count beyond 0 to 4 fails."""
    x = checked(x_count, ~x_count.between(0, 4), "x_count must be between 0 and 4")
    least = x if minimum is None else F.coalesce(minimum, x)
    return F.struct(x.alias("x_count"), (x_count == 4).alias("count_is_capped"), F.when(x_count == 4, F.greatest(least, F.lit(4))).otherwise(least).alias("minimum_team_fouls"))


def _integers(items: Column, message: str) -> Column:
    """Texts as integers; one that is none fails."""
    return F.transform(items, lambda x: checked(F.when(x.rlike(r"^[+-]?[0-9]{1,9}$"), x.cast("int")), ~x.rlike(r"^[+-]?[0-9]{1,9}$"), F.concat(F.lit(message), x)))


def parsed_roster(text: Column, most: int = 12) -> Column:
    """array<int> of a comma-separated roster, blanks passed over; no number, one beyond 0 to 99, a repeated one, none or more than `most` fail."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    n = _integers(items, "Invalid jersey number: ")
    bad = [
        (F.exists(n, lambda x: ~x.between(0, 99)), "Jersey number outside the 0..99 range"), (F.size(F.array_distinct(n)) < F.size(n), "Duplicate jersey number"),
        (F.size(n) == 0, "The roster cannot be empty"), (F.size(n) > most, f"The template supports at most {most} players"),
    ]
    for wrong, message in reversed(bad):
        n = checked(n, wrong, message)
    return n


def parsed_period_scores(text: Column) -> Column:
    """array<int> of exactly four comma-separated scores, none below 0."""
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    n = checked(items, F.size(items) != 4, "Period scores must contain exactly four comma-separated values")
    whole = _integers(n, "Period scores must be non-negative integers: ")
    return checked(whole, F.exists(whole, lambda x: x < 0), "Period scores must be non-negative integers")


def checked_rectangle(x: Column, y: Column, w: Column, h: Column, slack: float = 0.0) -> Column:
    """struct(x, y, width, height) of shares of a page; one beyond it by more than slack fails."""
    inside = F.lit(True)
    for v in (x, y, w, h):
        inside = inside & v.between(0, 1 + slack)
    rect = F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    return checked(rect, ~(inside & (x + w <= 1 + slack) & (y + h <= 1 + slack)), "The region exceeds normalized bounds")


def box_from_percent(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y, width, height) in shares of an image, of percents; what is out by 1e-9 at most is put on the edge, more fails, and so does an empty box."""
    eps = 1e-9
    left, top = (F.when(v.between(-eps, 0), F.lit(0.0)).otherwise(v) for v in (x / 100, y / 100))
    width, height = (F.when((a + b > 1) & (a + b <= 1 + eps), 1 - a).otherwise(b) for a, b in ((left, w / 100), (top, h / 100)))
    box = F.struct(left.alias("x"), top.alias("y"), width.alias("width"), height.alias("height"))
    out = (left < 0) | (top < 0) | (left + width > 1.000001) | (top + height > 1.000001)
    box = checked(box, out, "Bounding box exceeds the image")
    box = checked(box, (width <= 0) | (height <= 0), "Bounding box width and height must be positive")
    return checked(box, (left + top + width + height).isNull(), "Incomplete bounding box")


def checked_pixel_box(box: Column, width: Column, height: Column) -> Column:
    """array(left, top, right, bottom) within an image and not empty; another one fails."""
    l, t, r, b = (F.get(box, k) for k in range(4))  # noqa: E741
    ok = (F.size(box) == 4) & (l >= 0) & (t >= 0) & (r <= width) & (b <= height) & (r > l) & (b > t)
    return checked(box, ~F.coalesce(ok, F.lit(False)), "Invalid bounding box")


def box_to_pixels(box: Column, width: Column, height: Column) -> Column:
    """array(left, top, right, bottom) of a struct of shares, halves to even."""
    return checked_pixel_box(pixel_box(box["x"], box["y"], box["width"], box["height"], width, height), width, height)


def box_to_percent(box: Column, width: Column, height: Column) -> Column:
    """struct(x, y, width, height) in percent of array(left, top, right, bottom) in pixels."""
    b = checked_pixel_box(box, width, height)
    l, t, r, m = (F.get(b, k) for k in range(4))  # noqa: E741
    return F.struct((l / width * 100).alias("x"), (t / height * 100).alias("y"), ((r - l) / width * 100).alias("width"), ((m - t) / height * 100).alias("height"))


# The labels that a foul may be given, as they are written.
FOUL_LABELS = ("P", "P1", "P2", "P3", "T", "T1", "U", "U1", "U2", "U3", "D", "D2", "GD", "Pc", "Tc", "Uc", "Dc")


def final_label(field_type: Column, label: Column) -> Column:
    """The label as it is kept: a jersey's digits of 0 to 99, a foul symbol in its written form; others, and none, fail."""
    jersey = field_type.isin("jersey", "scoring_event")
    digits = F.trim(label)
    forms = F.create_map(*[F.lit(x) for v in FOUL_LABELS for x in (v.upper(), v)])
    foul = F.element_at(forms, F.replace(F.upper(label), F.lit(" "), F.lit("")))
    out = F.when(jersey, F.when(digits.rlike("^[0-9]+$") & (F.length(F.ltrim(digits, F.lit("0"))) <= 2), digits)).otherwise(foul)
    out = checked(out, label.isNotNull() & out.isNull(), F.concat(F.lit("Invalid label: "), label))
    return checked(out, label.isNull(), "An accepted or adjusted crop requires a label")


def review_status(status: Column, warnings: Column) -> Column:
    """The written status in lower case; without one pending if a warning says so, else unverified."""
    said = F.lower(F.trim(status))
    # Fixed value: the word for pending in warnings.
    pending = F.exists(warnings, lambda w: F.lower(w).contains("pendente"))
    return F.when(F.length(said) > 0, said).when(F.coalesce(pending, F.lit(False)), "pending").otherwise("unverified")


def prediction_row(expected: Column, predicted: Column, confidence: Column) -> list[Column]:
    """expected and predicted as texts, and the confidence, 0 where there is none, within 0 and 1."""
    return [expected.cast("string").alias("expected"), predicted.cast("string").alias("predicted"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.cast("double"), F.lit(0.0)))).alias("confidence")]


def in_training(field_type: Column, split: Column, label: Column, state: Column, status: Column, wanted_type: str, wanted_split: str) -> Column:
    """Whether a manifest row trains a model of that type: a usable review, or labelled where none was made."""
    usable = F.when(state.isNotNull(), state.isin("accepted", "adjusted")).otherwise(status == "labeled")
    return F.coalesce((field_type == wanted_type) & (split == wanted_split) & label.isNotNull() & usable, F.lit(False))


def media_url(path: Column) -> Column:
    """Where a review tool finds a file: its path in a query, slashes kept."""
    quoted = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    # Fixed value: the tool's address of local files. A tilde needs no quoting, an asterisk does.
    return F.concat(F.lit("/data/local-files/?d="), F.replace(F.replace(quoted, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


def position_text(field_type: Column, team: Column, running_score: Column, row: Column, slot: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    score = F.concat(F.lit("score:"), part(team), F.lit(":"), part(running_score))
    return F.when(field_type.isin("jersey", "scoring_event"), score).otherwise(F.concat(F.lit("foul:"), part(team), F.lit(":row"), part(row), F.lit(":slot"), part(slot)))


#: The digit class that stands for no digit.
BLANK = 10


def jersey_slots(label: Column) -> Column:
    """array(first, second) digit classes of a jersey of one or two digits; another text fails."""
    t = F.trim(label)
    slots = F.array(F.substring(t, 1, 1).cast("int"), F.when(F.length(t) == 2, F.substring(t, 2, 1).cast("int")).otherwise(BLANK))
    return checked(slots, ~t.rlike("^[0-9]{1,2}$"), F.concat(F.lit("A jersey number must contain one or two digits: "), label))


def jersey_probability(first: Column, second: Column, label: Column) -> Column:
    """The product of a label's two digit probabilities; first and second are arrays over the digits and blank."""
    slots = jersey_slots(label)
    return F.get(first, F.get(slots, 0)) * F.get(second, F.get(slots, 1))


def catalogue_status(warped: Column, error: Column) -> Column:
    """unreadable with an error, ready where the page's border was found, else to be reviewed."""
    return F.when(error.isNotNull(), "unreadable").when(warped, "ready").otherwise("alignment_review")


def dominant_colour(red: Column, blue: Column, least: float = 0.62) -> Column:
    """red or blue with at least that share of ink pixels, else unknown."""
    total = red + blue
    return F.when(total == 0, "unknown").when(red / total >= least, "red").when(blue / total >= least, "blue").otherwise("unknown")


def _ink(r: Column, g: Column, b: Column, rules: tuple[int, ...]) -> tuple[Column, Column]:
    colour, red_g, red_b, red_least, blue_r, blue_g, blue_least = rules
    coloured = F.greatest(r, g, b) - F.least(r, g, b) >= colour
    return coloured & (r - g >= red_g) & (r - b >= red_b) & (r >= red_least), coloured & (b - r >= blue_r) & (b - g >= blue_g) & (b >= blue_least)


# Least spread of a coloured pixel; of a red one its lead over green and blue and its least value; of a blue one over red and green.
INK = (28, 18, 15, 70, 15, 5, 65)
PARTICIPATION_INK = (35, 25, 20, 80, 20, 10, 70)


def red_blue_ink(r: Column, g: Column, b: Column, rules: tuple[int, ...] = INK) -> Column:
    """red, blue or null of a pixel."""
    red, blue = _ink(r, g, b, rules)
    return F.when(red, "red").when(blue, "blue")


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114
