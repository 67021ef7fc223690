"""Pages to straight pages, and printed grids to lines: found in one Arrow pass an image, taken further as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import IMAGE, pixels

# How dark a printed line's pixels are, on pages and points, and on team fouls.
DARK, FOUL_DARK = 145, 125
GRID = "struct<x_lines:array<int>,y_lines:array<int>,confidence:double>"


def dark(image: np.ndarray, below: float = DARK) -> np.ndarray:
    return image[..., :3] @ np.array([0.299, 0.587, 0.114]) < below


def _run_centers(profile: np.ndarray, least: float) -> list[int]:
    """Centers of the runs of a profile that reach `least`."""
    on = np.concatenate([[0], (profile >= least).astype(np.int8), [0]])
    step = np.diff(on)
    return [round((int(a) + int(b) - 1) / 2) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def _groups(values: list[int], gap: float) -> list[np.ndarray]:
    v = np.asarray(values)
    return np.split(v, np.flatnonzero(np.diff(v) > gap) + 1) if len(v) else []


def _nearest(values: list[int], at: float) -> int:
    return min(values, key=lambda v: (abs(v - at), values.index(v)))


# --- the page's border


def _border(ink: np.ndarray, share: tuple[float, float], last: bool) -> tuple[float, float] | None:
    """(slope, offset) of the outermost dark pixel of every third row, within a share of the width; rows far from the median are left out."""
    height, width = ink.shape
    a, b = round(width * share[0]), round(width * share[1])
    rows = np.arange(round(height * 0.06), round(height * 0.94), 3)
    band = ink[rows, a:b]
    some = band.any(axis=1)
    at = (band.shape[1] - 1 - band[:, ::-1].argmax(axis=1) if last else band.argmax(axis=1)) + a
    rows, at = rows[some], at[some].astype(float)
    if len(at) < 20:
        return None
    off = np.abs(at - np.median(at))
    near = off <= max(6.0, 3.5 * np.median(off))
    if near.sum() < 20:
        return None
    slope, offset = np.polyfit(rows[near], at[near], 1)
    return float(slope), float(offset)


def border(page: np.ndarray) -> np.ndarray | None:
    """Corners (top left, top right, bottom right, bottom left) of the form's dark frame; None where it is not found or too small."""
    ink = dark(page)
    sides = {"left": _border(ink, (0.01, 0.18), False), "right": _border(ink, (0.80, 0.99), True), "top": _border(ink.T, (0.01, 0.18), False), "bottom": _border(ink.T, (0.80, 0.99), True)}
    if None in sides.values():
        return None

    def meet(side: str, end: str) -> tuple[float, float]:
        # x = p * y + q and y = r * x + s.
        (p, q), (r, s) = sides[side], sides[end]
        x = (p * s + q) / (1 - p * r)
        return x, r * x + s

    corners = np.array([meet("left", "top"), meet("right", "top"), meet("right", "bottom"), meet("left", "bottom")])
    a, b, c, d = corners
    wide, high = (max(np.hypot(*(x - y)), np.hypot(*(z - w))) for x, y, z, w in ((a, b, c, d), (a, d, b, c)))
    height, width = ink.shape
    return corners if np.isfinite(corners).all() and wide >= 0.6 * width and high >= 0.6 * height else None


def _sampled(page: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Colours between pixels, by the four around; white outside."""
    height, width = page.shape[:2]
    inside = (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)
    x, y = np.clip(x, 0, width - 1), np.clip(y, 0, height - 1)
    l, t = np.minimum(x.astype(int), max(width - 2, 0)), np.minimum(y.astype(int), max(height - 2, 0))  # noqa: E741
    fx, fy = (x - l)[..., None], (y - t)[..., None]
    r, b = np.minimum(l + 1, width - 1), np.minimum(t + 1, height - 1)
    out = (page[t, l] * (1 - fx) + page[t, r] * fx) * (1 - fy) + (page[b, l] * (1 - fx) + page[b, r] * fx) * fy
    return np.where(inside[..., None], np.rint(out), 255).astype(np.uint8)


def straightened(page: np.ndarray, width: int, height: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray | None, str]:
    """The page at that size, the corners it was cut at, and how: quad between the frame's corners, or resize where none is found; strict raises then."""
    corners = border(page)
    if corners is None and strict:
        raise ValueError("Could not locate the form's border")
    found = corners is not None
    a, b, c, d = corners if found else np.array([(0, 0), (page.shape[1] - 1, 0), (page.shape[1] - 1, page.shape[0] - 1), (0, page.shape[0] - 1)], float)
    out = np.empty((height, width, 3), np.uint8)
    u = (np.arange(width) / max(width - 1, 1))[None, :]
    for top in range(0, height, 256):  # a strip at a time
        v = (np.arange(top, min(top + 256, height)) / max(height - 1, 1))[:, None]
        x, y = ((1 - v) * ((1 - u) * a[k] + u * b[k]) + v * ((1 - u) * d[k] + u * c[k]) for k in (0, 1))
        out[top : top + 256] = _sampled(page, x, y)
    return out, corners, "quad" if found else "resize"


def normalized(pages: DataFrame, width: int, height: int, image: str = "image") -> DataFrame:
    """Pages with their image at the form's size, alignment_method, used_perspective_warp, and corners (null where none were found)."""

    @F.pandas_udf(f"image {IMAGE}, method string, corners array<double>")
    def run(images: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for w, h, raw in zip(images["width"], images["height"], images["rgb"], strict=True):
            p, corners, method = straightened(pixels(int(w), int(h), raw), width, height)
            rows.append(({"width": width, "height": height, "rgb": p.tobytes()}, method, None if corners is None else corners.ravel().tolist()))
        return pd.DataFrame(rows, columns=["image", "method", "corners"])

    n = pages.withColumn("_n", run(F.struct(*[F.col(f"{image}.{c}") for c in ("width", "height", "rgb")])))
    return n.withColumn(image, F.col("_n.image")).withColumn("alignment_method", F.col("_n.method")).withColumn("used_perspective_warp", F.col("_n.method") == "quad").withColumn("corners", F.col("_n.corners")).drop("_n")


# --- grids of lines


def _between(left: int, right: int, parts: int) -> list[int]:
    """The lines after left up to right, in so many even parts."""
    return [*(round(left + (right - left) * k / parts) for k in range(1, parts)), right]


def _completed(centers: list[int], width: int, expected: int) -> tuple[list[int], int] | None:
    """The lines with those between them that wide gaps miss, and at the edges, at most two in all; and how many were added."""
    if not max(expected - 2, 2) <= len(centers) <= expected:
        return None
    lines = [centers[0]]
    for seen, right in enumerate(centers[1:], 2):
        lines += _between(lines[-1], right, max(1, int(np.ceil((right - lines[-1]) / (width * 0.09)))))
        if len(lines) - seen > 2:
            return None
    added, short = len(lines) - len(centers), expected - len(lines)
    if short < 0:
        return None
    if short:
        usual = max(float(np.median(np.diff(lines))), 1.0)
        room = (float(lines[0]), float(width - 1 - lines[-1]))
        cost = lambda space, n: abs(space / n - usual) / usual if n else max(0.0, space / usual - 0.45)
        left = min(range(short + 1), key=lambda k: (cost(room[0], k) + cost(room[1], short - k), k))
        lines = [round(lines[0] * k / left) for k in range(left)] + lines + [round(lines[-1] + room[1] * k / (short - left)) for k in range(1, short - left + 1)]
    return (lines, added + short) if all(np.diff(lines) > 0) else None


def upright_lines(ink: np.ndarray, expected: int) -> list[int]:
    """So many vertical lines: of falling thresholds the one that needs fewest added lines, then has the darkest ones, then is the highest."""
    profile = ink.mean(axis=0)
    width, best = len(profile), None
    for least in (0.65, 0.60, 0.55, 0.50, 0.45, 0.40, 0.35, 0.30):
        weighed = lambda g: round(float(np.average(g, weights=np.maximum(profile[g], 1e-6))))
        centers = [weighed(g) for g in _groups(_run_centers(profile, least), max(4, round(width * 0.015)))]
        whole = _completed(centers, width, expected) if width >= expected else None
        if whole is not None and whole[1] <= 2:
            rank = (whole[1], -float(profile[np.clip(centers, 0, width - 1)].mean()), -least)
            best = min(best, (rank, whole[0])) if best else (rank, whole[0])
    return best[1] if best else []


def level_lines(ink: np.ndarray, x_lines: list[int], rows: int, top: float, bottom: float) -> list[int]:
    """rows + 1 horizontal lines from near the share `top` of the height to near `bottom`: peaks of any column at the steps between, or the steps themselves."""
    peaks: list[int] = []
    for left, right in zip(x_lines, x_lines[1:], strict=False):
        side = max(2, round((right - left) * 0.07))
        if right - left > 2 * side:
            profile = ink[:, left + side : right - side].mean(axis=1)
            around = np.max([profile[k : len(profile) - 4 + k] for k in range(5)], axis=0) if len(profile) > 4 else np.zeros(0)
            peaks += (np.flatnonzero((profile[2:-2] >= 0.50) & (profile[2:-2] >= around)) + 2).tolist()
    lines = [round(float(np.median(g))) for g in _groups(sorted(peaks), 4)]
    height = ink.shape[0]
    ends = [[y for y in lines if abs(y - height * at) <= height * 0.035] for at in (top, bottom)]
    if len(lines) < rows + 1 or not all(ends):
        return []
    first, last = (_nearest(e, height * at) for e, at in zip(ends, (top, bottom), strict=True))
    steps = [first + k * (last - first) / rows for k in range(rows + 1)]
    out = [n if abs((n := _nearest(lines, at)) - at) <= 5.5 else round(at) for at in steps]
    return out if last > first and all(np.diff(out) > 0) else []


def points_grid(table: np.ndarray, panels: int = 4, rows: int = 40, header: float = 0.047, bottom: float = 0.946) -> tuple[list[int], list[int], float]:
    """Lines of the table of points: four columns a panel, and a row a point; no lines and 0 where they are not found."""
    ink = dark(table)
    x = upright_lines(ink, 4 * panels + 1)
    y = level_lines(ink, x, rows, header, bottom) if x else []
    if not y:
        return x, [], 0.0
    return x, y, round(min(1.0, ((x[-1] - x[0]) / ink.shape[1] + (y[-1] - y[0]) / ink.shape[0]) / 1.85), 4)


def boxes_grid(block: np.ndarray) -> tuple[list[int], list[int], float]:
    """Lines of the team-foul boxes: five to the left and five to the right, and top and bottom of two rows; no lines and 0 where they are not found."""
    ink = dark(block, FOUL_DARK)
    height, width = ink.shape
    level, upright = _run_centers(ink.mean(axis=1), 0.55), _run_centers(ink.mean(axis=0), 0.55)
    y: list[int] = []
    for k in range(len(level) - 2):
        one, gap, top = level[k + 1] - level[k], level[k + 2] - level[k + 1], level[k + 2]
        if 0.24 * height <= one <= 0.40 * height and 0.04 * height <= gap <= 0.18 * height:
            seen = level[k + 3] if k + 3 < len(level) and abs(level[k + 3] - top - one) <= 0.10 * height else min(height - 1, top + one)
            if seen - top >= 0.20 * height:
                y = [level[k], level[k + 1], top, seen]
                break
    gaps = np.diff(upright)
    if not y or len(upright) < 8 or gaps.max() < 0.14 * width:
        return [], [], 0.0
    cut = int(gaps.argmax()) + 1
    sides = [s + [min(width, s[-1] + round(float(np.median(np.diff(s)))))] if len(s) == 4 else s for s in (upright[:cut], upright[cut:])]
    if any(len(s) != 5 for s in sides):
        return [], [], 0.0
    x = sides[0] + sides[1]
    return x, y, round(min(1.0, 0.5 * (x[-1] - x[0]) / width + 0.5 * (y[3] - y[0]) / height), 4)


def _five_columns(lines: list[int], width: int) -> list[int]:
    """Six lines at even steps between two of those seen, edges counted where four or five are; the least error and distance from the edges."""
    c = sorted(set(lines))
    if len(c) == 4 or (len(c) == 5 and c[0] > width * 0.10):
        c = [0, *c] + ([width - 1] if len(c) == 4 else [])
    elif len(c) == 5 and c[-1] < width * 0.90:
        c = [*c, width - 1]
    best = None
    for i in range(len(c)):
        for j in range(i + 5, len(c)):
            steps = [c[i] + k * (c[j] - c[i]) / 5 for k in range(6)]
            near = [_nearest(c, at) for at in steps]
            off = [abs(n - at) for n, at in zip(near, steps, strict=True)]
            if max(off) <= max(3.0, width * 0.035) and len(set(near)) == 6:
                score = sum(off) + 0.15 * (near[0] + abs(width - 1 - near[-1]))
                best = (score, near) if best is None or score < best[0] else best
    return best[1] if best else []


def player_grid(block: np.ndarray, side: str, rows: int = 12, headers: tuple[float, float] = (0.26, 0.085), footer: float = 0.08) -> tuple[list[int], list[int], float]:
    """Lines of a side's player fouls: five slots, and a row a player below the side's header; no lines and 0 where they are not found."""
    if side not in ("A", "B"):
        raise ValueError("side must be A or B")
    ink = dark(block)
    height, width = ink.shape
    top, bottom = (round(height * headers[0]), height) if side == "A" else (round(height * headers[1]), round(height * (1 - footer)))
    first = lambda tries: next((x for x in tries if x), [])
    x = first(_five_columns(_run_centers(ink[top:bottom].mean(axis=0), least), width) for least in (0.72, 0.62, 0.52, 0.42, 0.32)) if bottom > top else []
    if not x or x[-1] <= x[0] + 1:
        return x, [], 0.0
    step = (bottom - top) / rows
    slack = max(5.0, step * 0.45)

    def levels(least: float) -> list[int]:
        c = _run_centers(ink[:, x[0] + 1 : x[-1]].mean(axis=1), least)
        if len(c) < rows - 1:
            return []
        c = sorted(set(c) | {at for at in (top, bottom) if not any(abs(v - at) <= slack for v in c)})
        steps = [top + k * step for k in range(rows + 1)]
        near = [_nearest(c, at) for at in steps]
        return near if all(abs(n - at) <= slack for n, at in zip(near, steps, strict=True)) and len(set(near)) == rows + 1 else []

    y = first(levels(least) for least in (0.58, 0.50, 0.42, 0.34))
    return x, y, round(min(1.0, 0.5 * (x[-1] - x[0]) / width + 0.5 * (y[-1] - y[0]) / (bottom - top)), 4) if y else 0.0


def with_grid(rows: DataFrame, find: Callable[..., tuple[list[int], list[int], float]], *more: str, image: str = "image") -> DataFrame:
    """rows with `grid` of one of the functions above over their image; more: columns that the function also takes, as a side."""

    @F.pandas_udf(GRID[7:-1].replace(":array", " array").replace(":double", " double"))
    def run(images: pd.DataFrame, *columns: pd.Series) -> pd.DataFrame:
        out = [find(pixels(int(w), int(h), raw), *rest) for w, h, raw, *rest in zip(images["width"], images["height"], images["rgb"], *columns, strict=True)]
        return pd.DataFrame(out, columns=["x_lines", "y_lines", "confidence"])

    return rows.withColumn("grid", run(F.struct(*[F.col(f"{image}.{c}") for c in ("width", "height", "rgb")]), *[F.col(c) for c in more]))


def _inner(low: Column, high: Column, share: float) -> tuple[Column, Column]:
    """Both ends of a cell moved in by a share of it, a pixel at least."""
    m = F.greatest(F.lit(1), F.bround((high - low) * share, 0).cast("int"))
    return low + m, high - m


def point_boxes(grids: DataFrame, panels: int = 4, rows: int = 40) -> DataFrame:
    """(…, side, running_score, part, box) of each found grid: the inner boxes of every score's and jersey's cell."""
    g = grids.filter(F.size("grid.y_lines") == rows + 1)
    # Of a panel's four columns, which a side's score and jersey are in; margins across and along.
    parts = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("part"), F.lit(k).alias("k"), F.lit(m).alias("m")) for s, p, k, m in (("A", "jersey", 0, 0.05), ("A", "score", 1, 0.08), ("B", "score", 2, 0.08), ("B", "jersey", 3, 0.05))])
    e = g.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(panels * rows - 1)))).withColumn("_p", F.explode(parts))
    x, y = F.floor(F.col("_n") / rows).cast("int") * 4 + F.col("_p.k"), F.col("_n") % rows
    l, r = F.get("grid.x_lines", x), F.get("grid.x_lines", x + 1)  # noqa: E741
    t, b = _inner(F.get("grid.y_lines", y), F.get("grid.y_lines", y + 1), 0.10)
    m = F.greatest(F.lit(1), F.bround((r - l) * F.col("_p.m"), 0).cast("int"))
    return e.select(*grids.columns, F.col("_p.side").alias("side"), (F.col("_n") + 1).alias("running_score"), F.col("_p.part").alias("part"), F.array(l + m, t, r - m, b).alias("box")).drop("grid")


def team_foul_boxes(grids: DataFrame) -> DataFrame:
    """(…, period, slot, box) of each found grid of team fouls."""
    e = grids.filter(F.size("grid.x_lines") == 10).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(15))))
    row, group, slot = F.floor(F.col("_n") / 8).cast("int"), F.floor(F.col("_n") / 4).cast("int") % 2, F.col("_n") % 4
    l, r = _inner(F.get("grid.x_lines", group * 5 + slot), F.get("grid.x_lines", group * 5 + slot + 1), 0.08)  # noqa: E741
    t, b = _inner(F.get("grid.y_lines", row * 2), F.get("grid.y_lines", row * 2 + 1), 0.08)
    return e.select(*grids.columns, (row * 2 + group + 1).alias("period"), (slot + 1).alias("slot"), F.array(l, t, F.greatest(r, l + 1), F.greatest(b, t + 1)).alias("box")).drop("grid")


def player_rows(grids: DataFrame, rows: int = 12) -> DataFrame:
    """(…, row_no, top, bottom, x_lines, grid_aligned): a row a player, by the grid's lines, or of equal heights where it was not found; grids also has top and bottom of the data."""
    found = F.size("grid.y_lines") == rows + 1
    e = grids.withColumn("grid_aligned", found).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    even = lambda k: F.bround(F.col("top") + (F.col("bottom") - F.col("top")) * k / rows, 0).cast("int")
    top, bottom = (F.when(F.col("grid_aligned"), F.get("grid.y_lines", F.col("_n") + k)).otherwise(even(F.col("_n") + k)) for k in (0, 1))
    rest = [c for c in grids.columns if c not in ("grid", "top", "bottom")]
    return e.select(*rest, (F.col("_n") + 1).alias("row_no"), top.alias("top"), bottom.alias("bottom"), F.when(F.size("grid.x_lines") == 6, F.col("grid.x_lines")).alias("x_lines"), "grid_aligned")
