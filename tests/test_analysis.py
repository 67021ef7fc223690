"""A drawn page from its pixels to records."""

import numpy as np
from pyspark.sql import functions as F
from test_images import BLUE, RED, ellipse, line

from tallyforge.operators import analysis as an
from tallyforge.operators import images as im
from tallyforge.plans import template as tp

WIDTH, HEIGHT = 1240, 1754


def cell(region, x, y, w, h):
    """Pixels of a part of a region, in shares of it."""
    a, b, c, d = tp.REGIONS[region]
    return round((a + x * c) * WIDTH), round((b + y * d) * HEIGHT), round((a + (x + w) * c) * WIDTH), round((b + (y + h) * d) * HEIGHT)


def stroke(p, box, color, shape):
    x0, y0, x1, y1 = box
    part = p[y0:y1, x0:x1]
    w, h = x1 - x0, y1 - y0
    if shape == "dot":
        ellipse(part, w * 0.4, h * 0.35, w * 0.4 + h * 0.3, h * 0.65, color)
    elif shape == "slash":
        line(part, w * 0.1, h * 0.85, w * 0.9, h * 0.15, color, 3)
    elif shape == "cross":
        line(part, w * 0.2, h * 0.2, w * 0.8, h * 0.8, color, 3)
        line(part, w * 0.8, h * 0.2, w * 0.2, h * 0.8, color, 3)
    else:
        line(part, 0, h * 0.5, w, h * 0.5, color, 5)


def test_page(spark):
    p = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    points = {(r.side, r.running_score, r.part): (r.x, r.y, r.width, r.height) for r in tp.scoring_cells(spark).collect()}
    stroke(p, cell("scoring_table", *points["A", 1, "score"]), RED, "dot")
    stroke(p, cell("scoring_table", *points["A", 3, "score"]), RED, "slash")
    stroke(p, cell("scoring_table", *points["B", 2, "score"]), BLUE, "slash")
    boxes = {(r.period, r.slot): (r.x, r.y, r.width, r.height) for r in tp.team_foul_cells(spark).collect()}
    for slot in (1, 2):
        stroke(p, cell("team_a_team_fouls", *boxes[1, slot]), RED, "cross")
    header = an.HEADER
    stroke(p, cell("team_a_participation", 0, header, 1, (1 - header) / 12), BLUE, "cross")
    top, step = an.FOUL_HEADERS["A"], (1 - an.FOUL_HEADERS["A"]) / 12
    stroke(p, cell("team_a_player_fouls", 0, top, 0.2, step), RED, "cross")
    stroke(p, cell("team_a_player_fouls", 0.2, top, 0.2, step), BLUE, "closed")
    rosters = spark.createDataFrame([("d", s, k, 3 + k) for s in "AB" for k in (1, 2)], "document_id string, side string, row_no int, jersey long")
    pages = spark.createDataFrame([("d", (WIDTH, HEIGHT, p.tobytes()))], f"document_id string, image {im.IMAGE}")
    got = an.analyzed(pages, rosters, size=(WIDTH, HEIGHT))
    events = {(r.side, r.running_score): (r.shot_type, r.points, r.ink_color, r.period, r.status) for r in got["scoring_events"].collect()}
    assert events == {("A", 1): ("free_throw", 1, "red", 1, "accepted"), ("A", 3): ("two_point", 2, "red", 1, "accepted"), ("B", 2): ("two_point", 2, "blue", 2, "accepted")}
    fouls = {(r.side, r.period): (r.x_count, r.review) for r in got["team_fouls"].collect()}
    assert len(fouls) == 8 and fouls["A", 1] == (2, False) and fouls["B", 4] == (0, False)
    assert [(r.side, r.jersey, r.slot, r.kind, r.status) for r in got["fouls"].collect()] == [("A", 4, 1, "unknown", "review")]
    assert [(r.side, r.jersey, r.slot, r.kind) for r in got["terminals"].collect()] == [("A", 4, 2, "closure_stroke")]
    players = {(r.side, r.row_no): (r.mark, r.participated) for r in got["players"].collect()}
    assert players["A", 1] == ("blue_x", True) and players["B", 2] == ("none", False) and len(players) == 4
    crops = an.review_crops(an.cut_cells(pages, pages.select("document_id", F.array(*map(F.lit, (1, 2, 5, 9))).alias("box"), F.lit("k").alias("name")), ("document_id",)), "jersey", F.col("name"))
    assert crops.first().image.width == 4 and len(crops.first().crop_image_hash) == 64
