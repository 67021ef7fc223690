"""Whole pages to records: straighten, cut regions, find grids, cut cells, measure them, and apply the rules.

Every step is a DataFrame; a page's pixels are cut into cells within one Arrow call, so that no page is copied for each of its cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pixel_box
from ..plans import template as tp
from . import extraction as ex
from . import images as im
from . import pages as pg
from .reconcile import team_foul_boxes

# Headers of the roster columns and of both sides' fouls, the foot of the second; players, slots, and a slot's margin.
HEADER, FOUL_HEADERS, FOUL_FOOT, PLAYERS, SLOTS, MARGIN = 0.085, {"A": 0.26, "B": 0.085}, 0.08, 12, 5, 0.12


def cut_cells(images: DataFrame, boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each image (keys, image) cut into its boxes (keys, names..., box in pixels): one row a box, with its image."""
    names = [c for c in boxes.columns if c not in keys]

    @F.pandas_udf(f"array<{im.IMAGE}>")
    def cut(image: pd.DataFrame, at: pd.Series) -> pd.Series:
        out = []
        for w, h, raw, cells in zip(image["width"], image["height"], image["rgb"], at, strict=True):
            p, parts = im.pixels(int(w), int(h), raw), []
            for left, top, right, bottom in cells:
                c = p[max(0, int(top)) : max(0, int(bottom)), max(0, int(left)) : max(0, int(right))]
                parts.append({"width": c.shape[1], "height": c.shape[0], "rgb": np.ascontiguousarray(c).tobytes()})
            out.append(parts)
        return pd.Series(out)

    b = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("cells"))
    j = images.select(*keys, F.struct(*[F.col(f"image.{c}") for c in ("width", "height", "rgb")]).alias("image")).join(b, list(keys))
    j = j.withColumn("images", cut("image", F.transform("cells", lambda c: c["box"]))).drop("image")
    e = j.select(*keys, F.explode(F.arrays_zip("cells", "images")).alias("x"))
    return e.select(*keys, *[F.col(f"x.cells.{c}").alias(c) for c in names if c != "box"], F.col("x.images").alias("image"))


def _size(table: DataFrame) -> DataFrame:
    return table.withColumn("w", F.col("image.width")).withColumn("h", F.col("image.height"))


def _by_share(tables: DataFrame, cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Boxes of a form's cells, in shares, on images of sizes w and h."""
    c = cells.withColumnsRenamed({"width": "_w", "height": "_h"}).withColumn("_one", F.lit(1))
    j = tables.select(*keys, "w", "h", F.lit(1).alias("_one")).join(F.broadcast(c), "_one")
    names = [n for n in cells.columns if n not in ("x", "y", "width", "height")]
    return j.select(*keys, *names, pixel_box(F.col("x"), F.col("y"), F.col("_w"), F.col("_h"), F.col("w"), F.col("h")).alias("box"))


def _regions(pages: DataFrame) -> DataFrame:
    """(document_id, side, what, image) of straight pages; side is null for regions of both."""
    r = im.cropped(pages.select("document_id", "image"), tp.template(pages.sparkSession))
    side = F.upper(F.regexp_extract("region", "^team_([ab])_", 1))
    return r.select("document_id", F.nullif(side, F.lit("")).alias("side"), F.regexp_replace("region", "^team_[ab]_", "").alias("what"), "image")


def scoring_cells(regions: DataFrame, recogniser: im.Recogniser | None, rosters: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Cells of the table of points as extraction.scoring_events takes them."""
    t = _size(regions.filter("what = 'scoring_table'")).drop("side", "what")
    g = pg.with_grid(t, pg.points_grid)
    found = F.size("grid.y_lines") > 0
    slim = g.select("document_id", "grid", "w", "h", found.alias("grid_aligned"))
    by_lines = pg.point_boxes(slim).select("document_id", "grid_aligned", "side", "running_score", "part", "box")
    by_share = _by_share(slim.filter("not grid_aligned"), tp.scoring_cells(regions.sparkSession), ("document_id", "grid_aligned"))
    cells = cut_cells(t, by_lines.unionByName(by_share), ("document_id",))
    m = im.measure(cells)
    score = m.filter("part = 'score'").select("document_id", "side", "running_score", "grid_aligned", im.score_mark().alias("mark"))
    j = m.filter("part = 'jersey'").select("document_id", "side", "running_score", "image", im.jersey_circle().alias("circle"), im.ink_ratio().alias("jersey_ink"), im.colour().alias("jersey_color"), im.closure_stroke().alias("closure"))
    if recogniser is None:
        j = j.withColumn("jersey", F.lit(None).cast("long")).withColumn("jersey_confidence", F.lit(None).cast("double"))
    else:
        # Only cells with ink are read.
        inked = F.col("jersey_ink") >= 0.025
        read = ex.jerseys(im.recognised(j.filter(inked), recogniser, "jersey"), rosters, priors).drop("candidates")
        j = read.unionByName(j.filter(~inked).withColumn("jersey", F.lit(None).cast("long")).withColumn("jersey_confidence", F.lit(None).cast("double")))
    return score.join(j.drop("image"), ["document_id", "side", "running_score"])


def team_foul_cells(regions: DataFrame) -> DataFrame:
    """Boxes (document_id, side, period, slot, mark) of team fouls."""
    keys = ("document_id", "side")
    t = _size(regions.filter("what = 'team_fouls'")).drop("what")
    slim = pg.with_grid(t, pg.boxes_grid).select(*keys, "grid", "w", "h")
    by_lines = pg.team_foul_boxes(slim).select(*keys, "period", "slot", "box")
    by_share = _by_share(slim.filter(F.size("grid.x_lines") == 0), tp.team_foul_cells(regions.sparkSession), keys)
    return im.measure(cut_cells(t, by_lines.unionByName(by_share), keys)).select(*keys, "period", "slot", im.team_foul_mark().alias("mark"))


def _rows(t: DataFrame, keys: tuple[str, ...], header: float) -> DataFrame:
    """Boxes (keys, row_no, box) of a roster column's rows."""
    top = F.bround(F.col("h") * header, 0).cast("int")
    e = t.select(*keys, "w", "h", F.explode(F.sequence(F.lit(1), F.lit(PLAYERS))).alias("row_no"))
    at = lambda k: (top + F.bround((F.col("h") - top) * k / PLAYERS, 0)).cast("int")
    return e.select(*keys, "row_no", F.array(F.lit(0), at(F.col("row_no") - 1), F.col("w"), at(F.col("row_no"))).alias("box"))


def participation_marks(regions: DataFrame) -> DataFrame:
    """(document_id, side, row_no, mark)"""
    keys = ("document_id", "side")
    t = _size(regions.filter("what = 'participation'")).drop("what")
    return im.measure(cut_cells(t, _rows(t, keys, HEADER), keys)).select(*keys, "row_no", im.participation().alias("mark"))


def foul_cells(regions: DataFrame, rosters: DataFrame, recogniser: im.Recogniser | None, priors: DataFrame | None = None) -> DataFrame:
    """Cells of listed players' fouls as extraction.player_fouls takes them."""
    keys = ("document_id", "side")
    t = _size(regions.filter("what = 'player_fouls'")).drop("what")
    share = lambda of: F.when(F.col("side") == "A", of["A"]).otherwise(of["B"])
    g = pg.with_grid(t, pg.player_grid, "side").select(*keys, "grid", "w", F.bround(F.col("h") * share(FOUL_HEADERS), 0).cast("int").alias("top"), F.when(F.col("side") == "A", F.col("h")).otherwise(F.bround(F.col("h") * (1 - FOUL_FOOT), 0)).cast("int").alias("bottom"))
    rows = pg.player_rows(g).join(rosters.select(*keys, "row_no", "jersey"), [*keys, "row_no"])
    row_images = cut_cells(t, rows.select(*keys, "row_no", "jersey", "grid_aligned", "x_lines", F.array(F.lit(0), "top", F.col("w"), "bottom").alias("box")), keys)
    m = _size(im.measure(row_images)).withColumn("separator", im.half_separator()).drop("m")
    slots = m.select(*keys, "row_no", "jersey", "grid_aligned", "separator", "x_lines", "w", "h", F.explode(F.sequence(F.lit(1), F.lit(SLOTS))).alias("slot"))
    even = lambda k: F.bround(F.col("w") * k / SLOTS, 0).cast("int")
    left, right = (F.when(F.col("x_lines").isNull(), even(F.col("slot") + k)).otherwise(F.get("x_lines", F.col("slot") + k)) for k in (-1, 0))
    left, right = F.greatest(F.lit(0), left), F.least(F.col("w"), right)
    mx, my = F.bround((right - left) * MARGIN, 0).cast("int"), F.bround(F.col("h") * MARGIN, 0).cast("int")
    box = F.array(left + mx, my, F.greatest(left + mx + 1, right - mx), F.greatest(my + 1, F.col("h") - my))
    row = (*keys, "row_no")
    cells = cut_cells(m, slots.select(*row, "jersey", "grid_aligned", "separator", "slot", box.alias("box")), row)
    cells = im.measure(cells).withColumn("terminal", im.foul_terminal()).drop("m")
    cells = im.measure(im.cleaned_cells(cells)).withColumn("ink_ratio", im.ink_ratio()).withColumn("ink_color", im.colour()).drop("m")
    if recogniser is None:
        return cells.drop("image").withColumn("symbol", F.lit(None).cast("string")).withColumn("symbol_confidence", F.lit(None).cast("double")).withColumn("symbol_status", F.lit("review"))
    return ex.foul_symbols(im.recognised(cells, recogniser, "foul_event"), priors).drop("image", "candidates")


def analyzed(pages: DataFrame, rosters: DataFrame, recogniser: im.Recogniser | None = None, engine: ex.Engine | None = None, priors: DataFrame | None = None, size: tuple[int, int] = tp.PAGE) -> dict[str, DataFrame]:
    """Tables scoring_events, team_fouls, fouls, terminals and players of pages(document_id, image), with the rosters (document_id, side, row_no, jersey).

    Without a recogniser jerseys and foul symbols stay open and their rows are for review. The tables go on to the operators that reconcile them.
    """
    regions = _regions(pg.normalized(pages, *size))
    fouls, terminals = ex.player_fouls(foul_cells(regions, rosters, recogniser, priors))
    return {
        "scoring_events": ex.scoring_events(scoring_cells(regions, recogniser, rosters, priors), engine), "team_fouls": team_foul_boxes(ex.settled_boxes(team_foul_cells(regions), engine)),
        "fouls": fouls, "terminals": terminals, "players": ex.players(rosters, participation_marks(regions)),
    }


def review_crops(cells: DataFrame, field_type: str, position: Column) -> DataFrame:
    """(document_id, field_type, position, sha256, image) of cells with their images, for review: the hash names the crop's version."""
    return cells.select("document_id", F.lit(field_type).alias("field_type"), position.alias("position"), F.sha2("image.rgb", 256).alias("crop_image_hash"), "image")
