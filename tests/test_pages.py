"""Drawn pages and grids: borders, straightening, lines, boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import images as im
from tallyforge.operators import pages as pg


def white(width, height):
    return np.full((height, width, 3), 255, np.uint8)


def test_border_and_straight_page(spark):
    """A slanted frame is found to a pixel; its inside fills the straight page, its corners in the corners."""
    p = white(500, 700)
    corners = np.array([(30, 40), (470, 50), (460, 660), (25, 650)], float)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        for t in np.linspace(0, 1, 3000):
            x, y = np.rint(a + t * (b - a)).astype(int)
            p[y - 2 : y + 3, x - 2 : x + 3] = 0
    p[48:70, 35:60] = (255, 0, 0)
    got = pg.border(p)
    assert np.abs(got - corners).max() < 5
    assert pg.border(white(500, 700)) is None
    with pytest.raises(ValueError, match="border"):
        pg.straightened(white(50, 70), 20, 20, strict=True)
    rows = spark.createDataFrame([(0, (500, 700, p.tobytes())), (1, (100, 80, white(100, 80).tobytes()))], f"k int, image {im.IMAGE}")
    a, b = pg.normalized(rows, 200, 300).orderBy("k").collect()
    assert (a.alignment_method, a.used_perspective_warp, b.alignment_method, b.corners) == ("quad", True, "resize", None) and len(a.corners) == 8
    x = im.pixels(200, 300, bytes(a.image.rgb))
    red = (x[..., 0] > 200) & (x[..., 1] < 80)
    assert red[:20, :25].any() and not red[40:].any()


def grid(width, height, xs, ys, thick=3, color=0):
    p = white(width, height)
    for x in xs:
        p[ys[0] : ys[-1] + 1, max(0, x - thick // 2) : x + thick // 2 + 1] = color
    for y in ys:
        p[max(0, y - thick // 2) : y + thick // 2 + 1, xs[0] : xs[-1] + 1] = color
    return p


def test_points_grid(spark):
    xs, ys = [10 + 60 * k for k in range(17)], [50 + 22 * k for k in range(41)]
    height = round(ys[-1] / 0.946)
    whole, weak = grid(980, height, xs, ys), grid(980, height, xs[:5] + xs[6:], ys)
    for p in (whole, weak):
        x, y, sure = pg.points_grid(p)
        assert np.abs(np.array(x) - xs).max() <= 1 and np.abs(np.array(y) - ys).max() <= 1 and sure > 0.9
    assert pg.points_grid(white(980, height)) == ([], [], 0.0) and pg.points_grid(grid(980, height, xs[:5], ys))[2] == 0.0
    rows = spark.createDataFrame([(0, (980, height, whole.tobytes())), (1, (980, height, white(980, height).tobytes()))], f"k int, image {im.IMAGE}")
    boxes = pg.point_boxes(pg.with_grid(rows, pg.points_grid).drop("image")).collect()
    at = {(r.side, r.running_score, r.part): r.box for r in boxes}
    assert len(at) == 640 and {r.k for r in boxes} == {0}
    l, t, r, b = at["B", 41, "score"]
    assert abs(l - (xs[6] + 5)) <= 2 and abs(r - (xs[7] - 5)) <= 2 and abs(t - (ys[0] + 2)) <= 2 and abs(b - (ys[1] - 2)) <= 2


def test_boxes_grid(spark):
    """Two groups of four boxes, two rows; the last line of a group may be missing, and another page has none."""
    p = white(600, 200)
    left, right = [30 + 55 * k for k in range(5)], [370 + 55 * k for k in range(5)]
    for top, bottom in ((30, 95), (115, 180)):
        for group in (left, right):
            for x in group:
                p[top:bottom, x - 1 : x + 2] = 0
        p[top : top + 3, 10:590] = p[bottom - 1 : bottom + 2, 10:590] = 0
    x, y, sure = pg.boxes_grid(p)
    assert np.abs(np.array(x) - (left + right)).max() <= 1 and np.abs(np.array(y) - (31, 95, 116, 180)).max() <= 2 and sure > 0.7
    q = p.copy()
    q[98:112] = 255
    q[:, right[-1] - 1 : right[-1] + 2] = np.where(np.isin(np.arange(200), [30, 31, 32, 94, 95, 96, 115, 116, 117, 179, 180, 181])[:, None, None], q[:, right[-1] - 1 : right[-1] + 2], 255)
    assert np.abs(np.array(pg.boxes_grid(q)[0]) - (left + right)).max() <= 1
    assert pg.boxes_grid(white(600, 200)) == ([], [], 0.0)
    rows = spark.createDataFrame([(0, (600, 200, p.tobytes()))], f"k int, image {im.IMAGE}")
    got = {(r.period, r.slot): r.box for r in pg.team_foul_boxes(pg.with_grid(rows, pg.boxes_grid).drop("image")).collect()}
    assert len(got) == 16 and abs(got[2, 1][0] - 374) <= 2 and abs(got[3, 4][2] - 246) <= 2 and got[3, 1][1] > got[1, 1][3]


@pytest.mark.parametrize("side", ["A", "B"])
def test_player_grid(spark, side):
    height = 520
    top, bottom = (round(height * 0.26), height) if side == "A" else (round(height * 0.085), round(height * 0.92))
    xs, ys = [2 + 39 * k for k in range(6)], [round(top + k * (bottom - 1 - top) / 12) for k in range(13)]
    p = grid(200, height, xs, ys)
    x, y, sure = pg.player_grid(p, side)
    assert np.abs(np.array(x) - xs).max() <= 1 and np.abs(np.array(y) - ys).max() <= 2 and sure > 0.9
    assert pg.player_grid(white(200, height), side) == ([], [], 0.0)
    with pytest.raises(ValueError, match="side"):
        pg.player_grid(p, "C")
    rows = spark.createDataFrame([(0, side, top, bottom, (200, height, p.tobytes())), (1, side, top, bottom, (200, height, white(200, height).tobytes()))], f"k int, side string, top int, bottom int, image {im.IMAGE}")
    got = pg.player_rows(pg.with_grid(rows, pg.player_grid, "side").drop("image")).orderBy("k", "row_no").collect()
    assert [r.grid_aligned for r in got] == [True] * 12 + [False] * 12 and got[0].x_lines == x and got[12].x_lines is None
    assert abs(got[5].top - ys[5]) <= 2 and got[12].top == top and got[23].bottom == bottom
    assert not pg.with_grid(rows, pg.player_grid, "side").filter(F.col("grid").isNull()).count()
