"""Cell images to observations.

One Arrow batch function measures every image: ink by colour, moments, extents, coverage of rows and columns, a ring's angles. What
a cell holds is then decided by column expressions over these measures, so a rule can be changed, tested and pushed without Python.
Images are columns width, height and rgb, the pixels row by row as red, green and blue bytes; a batch holds as many as its bytes allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import INK, PARTICIPATION_INK, dominant_colour

IMAGE = "struct<width:int,height:int,rgb:binary>"
SLOTS = 5
_MEASURES = {
    "width": "int", "height": "int", "red": "long", "blue": "long", "n": "long", "sx": "double", "sy": "double", "sxx": "double", "syy": "double", "sxy": "double", "x0": "int", "x1": "int", "y0": "int", "y1": "int",
    "row_max": "double", "column_max": "double", "rows_65": "int", "top_max": "double", "top_52": "int", "top_run": "double", "middle_max": "double", "middle_42": "int", "middle_run": "double", "right_quarter": "double", "right_eighth": "double",
    "ring_points": "long", "ring_bins": "int", "changes": "double", "strict_red": "long", "strict_blue": "long", "strict_ring": "double", "coloured": "double", "boundaries": "array<double>",
}
MEASURES = ",".join(f"{k} {v}" for k, v in _MEASURES.items())


def pixels(width: int, height: int, rgb: bytes) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def ink(image: np.ndarray, rules: tuple[int, ...] = INK) -> tuple[np.ndarray, np.ndarray]:
    """Masks of red and of blue ink."""
    spread, over_g, over_b, red_least, over_r, over_g2, blue_least = rules
    r, g, b = np.moveaxis(image.astype(np.int16), -1, 0)
    some = image.max(axis=-1).astype(np.int16) - image.min(axis=-1) >= spread
    return some & (r - g >= over_g) & (r - b >= over_b) & (r >= red_least), some & (b - r >= over_r) & (b - g >= over_g2) & (b >= blue_least)


def _radius(height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance from the center in half widths and heights, and its two parts."""
    x = (np.arange(width) - (width - 1) / 2) / max(width / 2, 1)
    y = (np.arange(height) - (height - 1) / 2) / max(height / 2, 1)
    return np.hypot(x[None, :], y[:, None]), x, y


def _longest(mask: np.ndarray) -> float:
    """The longest run of marked pixels in a row, as a share of the width."""
    run, best = np.zeros(mask.shape[0], np.int64), 0
    for column in mask.T:
        run = (run + 1) * column
        best = max(best, int(run.max(initial=0)))
    return best / max(mask.shape[1], 1)


def measured(image: np.ndarray) -> dict:
    """The measures of one image; of one without pixels all are zero."""
    out = {k: [] if v.startswith("array") else 0 for k, v in _MEASURES.items()}
    height, width = image.shape[:2]
    out |= {"width": width, "height": height}
    if not height or not width:
        return out
    red, blue = ink(image)
    mask = red | blue
    rows, columns = mask.mean(axis=1), mask.mean(axis=0)
    y, x = np.nonzero(mask)
    third, two = max(1, height // 3), max(height // 3 + 1, 2 * height // 3)
    top, middle = slice(0, third), slice(height // 3, two)
    out |= {"red": int(red.sum()), "blue": int(blue.sum()), "n": len(x), "row_max": rows.max(), "column_max": columns.max(), "rows_65": int((rows >= 0.65).sum())}
    out |= {"top_max": rows[top].max(), "top_52": int((rows[top] >= 0.52).sum()), "top_run": _longest(mask[top]), "middle_max": rows[middle].max(), "middle_42": int((rows[middle] >= 0.42).sum()), "middle_run": _longest(mask[middle])}
    radius, nx, ny = _radius(height, width)
    if len(x):
        out |= {"sx": float(x.sum()), "sy": float(y.sum()), "sxx": float((x * x).sum()), "syy": float((y * y).sum()), "sxy": float((x * y).sum()), "x0": int(x.min()), "x1": int(x.max()), "y0": int(y.min()), "y1": int(y.max())}
        box = mask[y.min() : y.max() + 1, x.min() : x.max() + 1]
        for name, share in (("right_quarter", 4), ("right_eighth", 8)):
            out[name] = float(box[:, (share - 1) * box.shape[1] // share :].any(axis=1).mean())
        at = radius[y, x]
        ring = (at >= 0.48) & (at <= 1.05)
        angle = np.arctan2(ny[y[ring]], nx[x[ring]])
        out |= {"ring_points": int(ring.sum()), "ring_bins": len(np.unique(np.clip(np.floor((angle + np.pi) / (2 * np.pi) * 24), 0, 23)))}
    if height > 1 and width > 1:
        out["changes"] = float(((mask[:, 1:] != mask[:, :-1]).mean() + (mask[1:] != mask[:-1]).mean()) / 2)
    strict_red, strict_blue = ink(image, PARTICIPATION_INK)
    inside = (radius >= 0.42) & (radius <= 0.92)
    out |= {"strict_red": int(strict_red.sum()), "strict_blue": int(strict_blue.sum()), "strict_ring": float((strict_red & inside).sum() / max(int(inside.sum()), 1))}
    out["coloured"] = float((image.max(axis=-1).astype(np.int16) - image.min(axis=-1) >= 28).mean())
    half = max(1, round(width * 0.055 / 2))
    for k in range(SLOTS + 1):
        at = round(k / SLOTS * width)
        band = blue[:, max(0, at - half) : min(width, at + half + 1)]
        out["boundaries"].append(float(band.any(axis=1).mean() * 0.75 + band.mean() * 0.25) if band.size else 0.0)
    return out


def measure(rows: DataFrame, image: str = "image", name: str = "m") -> DataFrame:
    """rows with a struct of the measures of their image; a null image has null measures."""

    @F.pandas_udf(MEASURES)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([measured(pixels(int(w), int(h), raw)) for w, h, raw in zip(images["width"], images["height"], images["rgb"], strict=True)], columns=list(_MEASURES))

    some = F.col(image).isNotNull() & F.col(f"{image}.rgb").isNotNull()
    whole = F.struct(F.coalesce(F.col(f"{image}.width"), F.lit(0)).alias("width"), F.coalesce(F.col(f"{image}.height"), F.lit(0)).alias("height"), F.coalesce(F.col(f"{image}.rgb"), F.lit(b"")).alias("rgb"))
    blank = F.struct(F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(b"").alias("rgb"))
    return rows.withColumn(name, run(F.when(some, whole).otherwise(blank))).withColumn(name, F.when(some, F.col(name)))


def _transformed(f: Callable[..., np.ndarray], rows: DataFrame, name: str, *inputs: Column) -> DataFrame:
    """rows with an image made of other columns; the first inputs are an image's."""

    @F.pandas_udf(IMAGE)
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for w, h, raw, *rest in zip(*columns, strict=True):
            x = f(pixels(int(w), int(h), raw), *rest)
            out.append((x.shape[1], x.shape[0], np.ascontiguousarray(x).tobytes()))
        return pd.DataFrame(out, columns=["width", "height", "rgb"])

    return rows.withColumn(name, run(*inputs))


def _image(name: str) -> list[Column]:
    return [F.col(f"{name}.{c}") for c in ("width", "height", "rgb")]


def cropped(images: DataFrame, rects: DataFrame, image: str = "image") -> DataFrame:
    """Each image with each of the rectangles (x, y, width, height in shares of it, and what names them): image becomes the part. rects is a form's few cells."""
    j = images.withColumn("_one", F.lit(1)).join(F.broadcast(rects.withColumnsRenamed({"width": "_w", "height": "_h", "x": "_x", "y": "_y"}).withColumn("_one", F.lit(1))), "_one")

    def cut(p: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
        high, wide = p.shape[:2]
        return p[round(y * high) : round((y + h) * high), round(x * wide) : round((x + w) * wide)]

    return _transformed(cut, j, image, *_image(image), *[F.col(c) for c in ("_x", "_y", "_w", "_h")]).drop("_one", "_x", "_y", "_w", "_h")


def cut_boxes(rows: DataFrame, box: str, image: str = "image") -> DataFrame:
    """image becomes its part in a box of pixels (left, top, right, bottom)."""
    return _transformed(lambda p, b: p[int(b[1]) : int(b[3]), int(b[0]) : int(b[2])], rows, image, *_image(image), F.col(box))


def cleaned_cells(rows: DataFrame, image: str = "image", edge: float = 0.10, line: float = 0.60, around: int = 1) -> DataFrame:
    """Foul cells without printed lines: both edges, and rows of which most is coloured, with their neighbours, turn white."""

    def clean(p: np.ndarray) -> np.ndarray:
        p = p.copy()
        if p.size:
            side = max(1, round(p.shape[1] * edge))
            p[:, :side] = p[:, p.shape[1] - side :] = 255
            red, blue = ink(p)
            lines = (red | blue).mean(axis=1) >= line
            wide = np.convolve(lines, np.ones(2 * around + 1), "same") > 0
            p[wide[: len(lines)]] = 255
        return p

    return _transformed(clean, rows, image, *_image(image))


def joined_candidates(rows: DataFrame, jersey: str = "jersey_image", score: str = "score_image", name: str = "image") -> DataFrame:
    """The jersey's image, a gap, and the score's, centered on white; and jersey_box, where the jersey lies in it."""

    def put(a: np.ndarray, w: int, h: int, raw: bytes) -> np.ndarray:
        b = pixels(int(w), int(h), raw)
        high = max(a.shape[0], b.shape[0])
        left = a.shape[1] + max(3, round(high * 0.08))
        out = np.full((high, left + b.shape[1], 3), 255, np.uint8)
        for part, at in ((a, 0), (b, left)):
            top = (high - part.shape[0]) // 2
            out[top : top + part.shape[0], at : at + part.shape[1]] = part
        return out

    top = F.floor((F.greatest(F.col(f"{jersey}.height"), F.col(f"{score}.height")) - F.col(f"{jersey}.height")) / 2).cast("int")
    box = F.array(F.lit(0), top, F.col(f"{jersey}.width"), top + F.col(f"{jersey}.height"))
    return _transformed(put, rows, name, *_image(jersey), *_image(score)).withColumn("jersey_box", box)


def debug_parts(pages: DataFrame, regions: DataFrame, image: str = "image") -> DataFrame:
    """(…, name, image): of every page itself, the page with the regions' outlines, and each region's part."""
    boxes = [tuple(r) for r in regions.select("x", "y", "width", "height").collect()]  # a form's few regions

    def outlined(p: np.ndarray) -> np.ndarray:
        p = p.copy()
        for x, y, w, h in boxes:
            l, r = (min(max(round(v * p.shape[1]), 0), max(p.shape[1] - 1, 0)) for v in (x, x + w))  # noqa: E741
            t, b = (min(max(round(v * p.shape[0]), 0), max(p.shape[0] - 1, 0)) for v in (y, y + h))
            for edge in (np.s_[t : t + 4, l : r + 1], np.s_[max(b - 3, 0) : b + 1, l : r + 1], np.s_[t : b + 1, l : l + 4], np.s_[t : b + 1, max(r - 3, 0) : r + 1]):
                p[edge] = (255, 0, 0)
        return p

    whole = pages.withColumn("name", F.lit("normalized"))
    lines = _transformed(outlined, pages, image, *_image(image)).withColumn("name", F.lit("regions-overlay"))
    parts = cropped(pages, regions, image).withColumnRenamed("region", "name").select(*pages.columns, "name")
    return whole.unionByName(lines.select(*pages.columns, "name")).unionByName(parts)


#: The canvas that recognisers read: its height and width, and the room for the writing.
CANVAS, ROOM = (32, 64), (26, 54)


def _resized(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A triangle filter as wide as the reduction, along rows, then columns."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(old / new, 1.0)
        at = (np.arange(new) + 0.5) * old / new
        w = np.maximum(0, 1 - np.abs((np.arange(old)[None, :] + 0.5 - at[:, None]) / scale))
        return w / w.sum(axis=1, keepdims=True)

    return weights(mask.shape[0], height) @ mask @ weights(mask.shape[1], width).T


def prepared(image: np.ndarray) -> np.ndarray:
    """The ink (dark pixels where no ink is coloured), cut out, fitted into the canvas's room and centered; -1 is blank, 1 is ink."""
    red, blue = ink(image)
    mask = red | blue
    if not mask.any():
        mask = image.mean(axis=2) < 180
    out = np.zeros(CANVAS)
    y, x = np.nonzero(mask)
    if len(x):
        part = mask[y.min() : y.max() + 1, x.min() : x.max() + 1].astype(float)
        scale = min(ROOM[1] / part.shape[1], ROOM[0] / part.shape[0])
        high, wide = (max(1, round(s * scale)) for s in part.shape)
        top, left = (CANVAS[0] - high) // 2, (CANVAS[1] - wide) // 2
        out[top : top + high, left : left + wide] = _resized(part, high, wide)
    return out * 2 - 1


#: A recogniser: prepared canvases (n, 32, 64) and the field type to arrays of (label, probability), one list a canvas.
Recogniser = Callable[[np.ndarray, str], list[list[tuple[str, float]]]]


def recognised(rows: DataFrame, recogniser: Recogniser, field_type: str, image: str = "image", name: str = "candidates") -> DataFrame:
    """rows with candidates (label, probability) of a recogniser, which a worker loads with its function; batches go in as one array."""

    @F.pandas_udf("array<struct<label:string,probability:double>>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for images in batches:
            x = np.array([prepared(pixels(int(w), int(h), raw)) for w, h, raw in zip(images["width"], images["height"], images["rgb"], strict=True)])
            yield pd.Series([[{"label": a, "probability": float(p)} for a, p in c] for c in (recogniser(x, field_type) if len(x) else [])])

    return rows.withColumn(name, run(F.struct(*_image(image))))


def ordered_corners(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left of four struct(x, y): by the sum of both, and by their difference; the first on ties."""
    at = lambda key: F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p")))
    plus, minus = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    low = lambda key: F.array_min(at(key))["p"]
    return F.array(low(plus), low(minus), low(lambda p: -plus(p)), low(lambda p: -minus(p)))


def _m(name: str, m: str) -> Column:
    return F.col(f"{m}.{name}")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def area(m: str = "m") -> Column:
    return _m("width", m) * _m("height", m)


def ink_ratio(m: str = "m") -> Column:
    return _ratio(_m("n", m), area(m))


def elongation(m: str = "m") -> Column:
    """The root of the ratio of the ink's main to its lesser spread, each at least a millionth, from its moments."""
    n = F.greatest(_m("n", m), F.lit(1)).cast("double")
    a, b, c = ((_m(p, m) - _m(q, m) * _m(r, m) / n) / F.greatest(n - 1, F.lit(1.0)) for p, q, r in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    root = F.sqrt((a - b) * (a - b) + 4 * c * c)
    small, large = F.greatest((a + b - root) / 2, F.lit(1e-6)), (a + b + root) / 2
    return F.sqrt(F.greatest(large, small) / small)


def spans(m: str = "m") -> tuple[Column, Column]:
    """Width and height of the ink, in pixels."""
    return _m("x1", m) - _m("x0", m) + 1, _m("y1", m) - _m("y0", m) + 1


def colour(m: str = "m") -> Column:
    return dominant_colour(_m("red", m), _m("blue", m))


def _told(*cases: tuple[Column, tuple[Column | str, Column | float]], other: tuple[Column | str, Column | float]) -> tuple[Column, Column]:
    """kind and confidence of the first case that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    kind, sure = lit(other[0]), lit(other[1]).cast("double")
    for cond, (k, c) in reversed(cases):
        kind, sure = F.when(cond, lit(k)).otherwise(kind), F.when(cond, lit(c).cast("double")).otherwise(sure)
    return kind, sure


def _rounded(sure: Column) -> Column:
    return F.bround(F.least(sure, F.lit(1.0)), 4)


def score_mark(m: str = "m", least: float = 0.004) -> Column:
    """struct(kind, ink_color, confidence, ink_ratio, elongation): a compact dot is a free throw, a long stroke a field goal, neither ambiguous."""
    ratio, long = ink_ratio(m), elongation(m)
    w, h = spans(m)
    fill, span = _m("n", m) / F.greatest(w * h, F.lit(1)), F.greatest(_ratio(w, _m("width", m)), _ratio(h, _m("height", m)))
    # Weights and full marks of compactness, fill and extent; of stretch and extent; the least score, and the dot's lead.
    dot = 0.45 / F.greatest(long, F.lit(1.0)) + 0.35 * F.least(fill / 0.55, F.lit(1.0)) + 0.20 * F.greatest(F.lit(0.0), 1 - span / 0.62)
    slash = 0.60 * F.least(long / 4.0, F.lit(1.0)) + 0.40 * F.least(span / 0.70, F.lit(1.0))
    none, few = ratio < least, _m("n", m) < 4
    kind, sure = _told(
        (none, ("empty", F.least(F.lit(1.0), 1 - ratio / least))), (few, ("ambiguous", 0.0)), ((dot >= 0.58) & (dot > slash + 0.05), ("free_throw", _rounded(dot))), ((slash >= 0.58) & (slash > dot), ("field_goal", _rounded(slash))),
        other=("ambiguous", _rounded(F.greatest(dot, slash) * 0.75)))
    return F.struct(
        kind.alias("kind"), F.when(none, "unknown").otherwise(colour(m)).alias("ink_color"), sure.alias("confidence"), F.when(none | few, ratio).otherwise(F.bround(ratio, 6)).alias("ink_ratio"),
        F.when(none | few, 1.0).otherwise(F.bround(long, 4)).alias("elongation"))


def jersey_circle(m: str = "m", least: float = 0.006) -> Column:
    """struct(detected, confidence, angular_coverage): ink on most of 24 angles of a ring."""
    seen = (ink_ratio(m) >= least) & (_m("n", m) >= 8) & (_m("ring_points", m) >= 6)
    share = F.when(seen, _m("ring_bins", m) / 24.0).otherwise(0.0)
    # The share that makes a circle; where confidence begins, and over what it grows.
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - 0.28) / 0.50))
    return F.struct((share >= 0.54).alias("detected"), F.bround(sure, 4).alias("confidence"), F.bround(share, 4).alias("angular_coverage"))


def closure_stroke(m: str = "m") -> Column:
    """Whether the ink is a stroke that closes a column and no number."""
    w, h = spans(m)
    long = elongation(m)
    light = (long > 2.0) & (_ratio(w, _m("width", m)) > 0.84) & (_ratio(h, _m("height", m)) < 0.86) & (ink_ratio(m) < 0.16)
    return F.coalesce((_m("n", m) >= 4) & ((long > 3.0) | light), F.lit(False))


def team_foul_mark(m: str = "m", least: float = 0.01) -> Column:
    """struct(kind, ink_color, confidence, ink_ratio, elongation): two long horizontal strokes close a box, a cross counts."""
    ratio, long = ink_ratio(m), elongation(m)
    w, h = spans(m)
    wide, high = _ratio(w, _m("width", m)), _ratio(h, _m("height", m))
    # Weights and full marks of roundness and extents for a cross, of stretch and flatness for a closed box; the least score, and the cross's lead.
    cross = 0.55 * F.greatest(F.lit(0.0), 1 - F.abs(long - 1) / 1.8) + 0.20 * F.least(wide / 0.65, F.lit(1.0)) + 0.25 * F.least(high / 0.65, F.lit(1.0))
    closed = 0.55 * F.least(long / 4.0, F.lit(1.0)) + 0.30 * F.least(wide / 0.70, F.lit(1.0)) + 0.15 * F.greatest(F.lit(0.0), 1 - high / 0.65)
    none, few = ratio < least, _m("n", m) < 5
    lines = (_m("row_max", m) >= 0.75) & (_m("rows_65", m) >= 2)
    kind, sure = _told(
        (none, ("empty", 1.0)), (few, ("ambiguous", 0.0)), (lines, ("unused", _rounded(0.55 + 0.45 * _m("row_max", m)))), ((cross >= 0.57) & (cross > closed + 0.04), ("x", _rounded(cross))), ((closed >= 0.57) & (closed > cross), ("unused", _rounded(closed))),
        other=("ambiguous", _rounded(F.greatest(cross, closed) * 0.75)))
    return F.struct(
        kind.alias("kind"), F.when(none, "unknown").otherwise(colour(m)).alias("ink_color"), sure.alias("confidence"), F.when(none | few, ratio).otherwise(F.bround(ratio, 6)).alias("ink_ratio"),
        F.when(none | few, 1.0).otherwise(F.bround(long, 4)).alias("elongation"))


def foul_terminal(m: str = "m", least: float = 0.012) -> Column:
    """struct(kind, ink_color, confidence), null where the cell ends nothing: a stroke across is a closure, a clear F a disqualification."""
    top, middle, stem = _m("top_max", m), _m("middle_max", m), _m("column_max", m)
    # Full marks and weights of stem and both bars, and the least of each feature that an F must show, or the most.
    f = 0.45 * F.least(stem / 0.60, F.lit(1.0)) + 0.30 * F.least(top / 0.50, F.lit(1.0)) + 0.25 * F.least(middle / 0.38, F.lit(1.0))
    clear = (f >= 0.92) & (stem >= 0.72) & (top >= 0.52) & (middle >= 0.42) & (_m("top_52", m) >= 3) & (_m("middle_42", m) >= 3) & (_m("top_run", m) >= 0.48) & (_m("middle_run", m) >= 0.34)
    clear = clear & (ink_ratio(m) <= 0.38) & (_m("right_quarter", m) <= 0.48) & (_m("right_eighth", m) <= 0.30)
    told = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), colour(m).alias("ink_color"), _rounded(sure).alias("confidence"))
    some = (area(m) > 0) & (ink_ratio(m) >= least)
    return F.when(some & (_m("row_max", m) >= 0.72), told("closure_stroke", 0.55 + 0.45 * _m("row_max", m))).when(some & clear, told("disqualification", f))


def half_separator(m: str = "m", least: float = 0.15) -> Column:
    """struct(first_half_slots, confidence, boundary_scores): the boundary of slots with most blue ink, null where none has enough."""
    scores = _m("boundaries", m)
    best = F.array_max(scores)
    second = F.get(F.sort_array(scores, asc=False), 1)
    at = (F.array_position(scores, best) - 1).cast("int")
    sure = F.least(F.lit(1.0), best * 1.2 + F.greatest(F.lit(0.0), best - second))
    return F.struct(F.when(best >= least, at).alias("first_half_slots"), F.bround(sure, 4).alias("confidence"), F.transform(scores, lambda s: F.bround(s, 4)).alias("boundary_scores"))


def participation(m: str = "m", least: float = 0.008, ring: float = 0.015) -> Column:
    """struct(mark, participated, starter, participation_confidence, starter_confidence, status): blue within a red ring started, either colour alone played."""
    blue, red, round_ = _ratio(_m("strict_blue", m), area(m)), _ratio(_m("strict_red", m), area(m)), _m("strict_ring", m)
    has_blue, has_red = blue >= least, red >= least
    played, started = has_blue | has_red, has_blue & has_red & (round_ >= ring)
    mark = F.when(started, "blue_x_red_circle").when(has_blue & ~has_red, "blue_x").when(has_red & ~has_blue, "red_x").when(played, "ambiguous").otherwise("none")
    most = F.greatest(blue, red)
    sure = F.when(played, F.least(F.lit(1.0), most / (4 * least))).otherwise(1 - most / least)
    first = F.when(has_blue, F.least(F.lit(1.0), round_ / (2 * ring))).otherwise(0.0)
    return F.struct(mark.alias("mark"), played.alias("participated"), started.alias("starter"), F.bround(sure, 4).alias("participation_confidence"), F.bround(first, 4).alias("starter_confidence"), F.when(mark == "ambiguous", "review").otherwise("accepted").alias("status"))


def alteration(m: str = "m", dense: float = 0.22, mixed: float = 0.018, busy: float = 0.34) -> Column:
    """struct(suspected, confidence, reasons): cells with much ink, both colours, or many changes between ink and paper."""
    red, blue, ratio, changes = _ratio(_m("red", m), area(m)), _ratio(_m("blue", m), area(m)), ink_ratio(m), _m("changes", m)
    both = F.least(red, blue)
    rules = ((ratio >= dense, "dense_ink", ratio / dense - 0.25), (both >= mixed, "mixed_red_blue", both / mixed * 0.7), (changes >= busy, "high_stroke_complexity", changes / busy * 0.7))
    sure = F.greatest(F.lit(0.0), *[F.when(c, F.least(F.lit(1.0), s)).otherwise(0.0) for c, _, s in rules])
    return F.struct((sure >= 0.65).alias("suspected"), F.bround(sure, 4).alias("confidence"), F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r, _ in rules])).alias("reasons"))


def measures_schema() -> StructType:
    return StructType.fromDDL(MEASURES)
