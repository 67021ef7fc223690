"""Cells drawn in numpy, their measures and what the rules make of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import extraction as ex
from tallyforge.operators import images as im
from tallyforge.plans import template as tp

RED, BLUE = (200, 35, 35), (20, 60, 190)


def blank(width=80, height=80):
    return np.full((height, width, 3), 255, np.uint8)


def line(p, x0, y0, x1, y1, color, width=4):
    """A stroke: pixels within half a width of the segment."""
    y, x = np.mgrid[: p.shape[0], : p.shape[1]]
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1), 0, 1)
    p[np.hypot(x - x0 - t * dx, y - y0 - t * dy) <= width / 2] = color
    return p


def ellipse(p, x0, y0, x1, y1, color, width=None):
    y, x = np.mgrid[: p.shape[0], : p.shape[1]]
    a, b, cx, cy = (x1 - x0) / 2, (y1 - y0) / 2, (x0 + x1) / 2, (y0 + y1) / 2
    r = np.hypot((x - cx) / a, (y - cy) / b)
    inner = 0 if width is None else 1 - width / min(a, b)
    p[(r <= 1) & (r >= inner)] = color
    return p


def told(spark, rule, *cells):
    rows = [(k, (c.shape[1], c.shape[0], c.tobytes())) for k, c in enumerate(cells)]
    m = im.measure(spark.createDataFrame(rows, f"k int, image {im.IMAGE}"))
    return [r.t for r in m.select("k", rule().alias("t")).orderBy("k").collect()]


def test_score_marks(spark):
    dot, slash, speck = ellipse(blank(), 31, 31, 48, 48, RED), line(blank(), 18, 62, 62, 18, BLUE, 6), blank(10, 10)
    speck[4, 4:7] = RED
    got = told(spark, im.score_mark, blank(), dot, slash, speck, blank(0, 0))
    assert [(r.kind, r.ink_color) for r in got] == [("empty", "unknown"), ("free_throw", "red"), ("field_goal", "blue"), ("ambiguous", "red"), ("empty", "unknown")]
    # By the definition: the covariance's eigenvalues.
    y, x = np.nonzero(im.ink(slash)[1])
    values = np.linalg.eigvalsh(np.cov(np.stack([x, y])))
    assert got[2].elongation == pytest.approx(np.sqrt(values[1] / values[0]), abs=1e-3) and got[4].confidence == 1.0 and got[3].confidence == 0.0


def test_circles_and_closures(spark):
    ring = ellipse(blank(100, 70), 12, 5, 88, 65, BLUE, 4)
    digit = line(line(blank(100, 70), 45, 18, 45, 55, BLUE, 5), 45, 18, 58, 25, BLUE, 5)
    a, b = told(spark, im.jersey_circle, ring, digit)
    assert a.detected and a.angular_coverage > 0.9 and not b.detected
    assert told(spark, im.closure_stroke, line(blank(90, 50), 4, 44, 84, 5, BLUE), line(line(blank(90, 50), 30, 12, 30, 34, BLUE, 3), 40, 12, 44, 30, BLUE, 3), blank()) == [True, False, False]


def test_team_fouls(spark):
    x = line(line(blank(100, 70), 20, 12, 80, 58, RED, 5), 80, 12, 20, 58, RED, 5)
    closed = line(line(blank(100, 70), 12, 27, 88, 27, BLUE), 12, 42, 88, 42, BLUE)
    over = line(line(x.copy(), 6, 27, 94, 27, RED, 5), 6, 42, 94, 42, RED, 5)
    assert [r.kind for r in told(spark, im.team_foul_mark, x, closed, over, blank(100, 70))] == ["x", "unused", "unused", "empty"]


def test_terminals(spark):
    f = blank(60, 60)
    f[5:55, 8:16] = f[5:12, 8:50] = f[27:34, 8:40] = RED
    p = blank(60, 60)
    p[5:55, 8:16] = p[5:12, 8:50] = p[27:34, 8:50] = p[5:34, 43:50] = RED
    got = told(spark, im.foul_terminal, f, line(blank(60, 60), 2, 30, 58, 30, BLUE), p, blank(60, 60))
    assert [r and r.kind for r in got] == ["disqualification", "closure_stroke", None, None]


def test_cleaned_cells(spark):
    c = line(line(blank(100, 70), 2, 0, 2, 69, BLUE), 0, 35, 99, 35, BLUE, 3)
    rows = spark.createDataFrame([(0, (100, 70, c.tobytes()))], f"k int, image {im.IMAGE}")
    r = im.cleaned_cells(rows).first().image
    assert (im.pixels(r.width, r.height, bytes(r.rgb)) == 255).all()


def test_half_separator(spark):
    r = line(blank(250, 50), 100, 0, 100, 49, BLUE, 5)
    a, b = told(spark, im.half_separator, r, blank(250, 50))
    assert a.first_half_slots == 2 and a.confidence > 0.6 and len(a.boundary_scores) == 6 and b.first_half_slots is None


def test_participation(spark):
    cross = lambda color: line(line(blank(60, 60), 20, 20, 40, 40, color), 40, 20, 20, 40, color)
    starter = ellipse(cross(BLUE), 8, 8, 52, 52, RED, 4)
    both = cross(BLUE)
    both[28:32, 26:34] = RED
    got = told(spark, im.participation, blank(60, 60), cross(BLUE), cross(RED), starter, both)
    assert [(r.mark, r.participated, r.starter, r.status) for r in got] == [("none", False, False, "accepted"), ("blue_x", True, False, "accepted"), ("red_x", True, False, "accepted"), ("blue_x_red_circle", True, True, "accepted"), ("ambiguous", True, False, "review")]


def test_alterations(spark):
    dense = blank(20, 20)
    dense[:, :10] = BLUE
    mixed = blank(40, 40)
    mixed[:4], mixed[10:14] = RED, BLUE
    got = told(spark, im.alteration, blank(), dense, mixed)
    assert [(r.suspected, r.reasons) for r in got] == [(False, []), (True, ["dense_ink"]), (True, ["mixed_red_blue"])]


def test_parts_of_pages(spark):
    page = np.random.default_rng(0).integers(0, 256, (200, 100, 3), dtype=np.uint8)
    rows = spark.createDataFrame([("d", (100, 200, page.tobytes()))], f"document_id string, image {im.IMAGE}")
    t = tp.template(spark)
    got = {r.region: im.pixels(r.image.width, r.image.height, bytes(r.image.rgb)) for r in im.cropped(rows, t).collect()}
    assert len(got) == 14 and all((got[k] == page[round(y * 200) : round((y + h) * 200), round(x * 100) : round((x + w) * 100)]).all() for k, (x, y, w, h) in tp.REGIONS.items())
    assert im.cut_boxes(rows.withColumn("b", F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(6))), "b").first().image.rgb == page[2:6, 1:4].tobytes()
    a, b = page[:10, :8], page[:5, :6]
    pair = spark.createDataFrame([((8, 10, a.tobytes()), (6, 5, b.tobytes()))], f"jersey_image {im.IMAGE}, score_image {im.IMAGE}")
    r = im.joined_candidates(pair).first()
    x = im.pixels(r.image.width, r.image.height, bytes(r.image.rgb))
    assert x.shape == (10, 17, 3) and (x[:, :8] == a).all() and (x[2:7, 11:] == b).all() and r.jersey_box == [0, 0, 8, 10]
    points = spark.createDataFrame([([(9.0, 9.0), (0.0, 8.0), (1.0, 0.0), (8.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    assert [tuple(c) for c in points.select(im.ordered_corners(F.col("p")).alias("c")).first().c] == [(1, 0), (8, 1), (9, 9), (0, 8)]


def test_template(spark):
    s = tp.scoring_cells(spark)
    assert s.count() == 640 and s.select("side", "running_score", "part").distinct().count() == 640 and s.agg(F.max(F.col("x") + F.col("width"))).first()[0] == pytest.approx(1) and s.agg(F.max(F.col("y") + F.col("height"))).first()[0] == pytest.approx(1)
    assert tp.team_foul_cells(spark).count() == 16 and tp.period_score_cells(spark).count() == 8 and tp.final_score_cells(spark).count() == 2


def test_recogniser_input(spark):
    page = line(blank(200, 100), 60, 20, 60, 80, BLUE, 6)
    x = im.prepared(page)
    assert x.shape == (32, 64) and x.max() == pytest.approx(1) and x.min() == -1 and np.flatnonzero((x > 0).any(axis=1)).tolist() == list(range(3, 29))
    gray = np.full((50, 50, 3), 255, np.uint8)
    gray[10:40, 20:30] = 90
    assert (im.prepared(gray) > 0).any() and (im.prepared(blank()) == -1).all()
    rows = spark.createDataFrame([(k, (200, 100, p.tobytes())) for k, p in enumerate((page, blank(200, 100)))], f"k int, image {im.IMAGE}")
    model = lambda x, kind: [[("7", float((c > 0).mean())), (kind, 0.5)] for c in x]
    got = im.recognised(rows, model, "jersey").orderBy("k").collect()
    assert got[0].candidates[0].probability > 0 and got[1].candidates[0].probability == 0 and got[0].candidates[1].label == "jersey"


MARK = "struct<kind:string,ink_color:string,confidence:double,ink_ratio:double,elongation:double>"


def test_scoring_events(spark):
    rows = [
        ("A", 1, ("free_throw", "red", 0.9, 0.1, 1.0), (False, 0.0), 0.1, "red", False, True, 4, 0.8), ("A", 3, ("field_goal", "unknown", 0.9, 0.1, 1.0), (False, 0.2), 0.1, "red", False, True, 5, 0.8),
        ("A", 6, ("field_goal", "blue", 0.9, 0.1, 1.0), (True, 0.7), 0.1, "blue", False, True, 5, 0.8), ("A", 7, ("ambiguous", "blue", 0.4, 0.1, 1.0), (False, 0.0), 0.1, "blue", False, True, None, None),
        ("A", 8, ("free_throw", "blue", 0.9, 0.1, 1.0), (False, 0.0), 0.1, "blue", True, True, None, None), ("A", 9, ("free_throw", "blue", 0.9, 0.1, 1.0), (False, 0.0), 0.01, "blue", False, True, None, None),
        ("B", 2, ("empty", "unknown", 1.0, 0.0, 1.0), (False, 0.0), 0.5, "red", False, False, None, None), ("B", 3, ("ambiguous", "red", 0.2, 0.1, 1.0), (False, 0.0), 0.0, "red", False, False, None, None),
    ]
    cells = spark.createDataFrame([("d", *r) for r in rows], f"document_id string, side string, running_score long, mark {MARK}, circle struct<detected:boolean,confidence:double>, jersey_ink double, jersey_color string, closure boolean, grid_aligned boolean, jersey long, jersey_confidence double")
    got = {(r.side, r.running_score): (r.shot_type, r.points, r.ink_color, r.confidence, r.status, r.period) for r in ex.scoring_events(cells).collect()}
    assert got == {
        ("A", 1): ("free_throw", 1, "red", 0.9, "accepted", 1), ("A", 3): ("two_point", 2, "red", 0.9, "accepted", 1), ("A", 6): ("three_point", 3, "blue", 0.7, "accepted", 2), ("A", 7): ("ambiguous", 0, "blue", 0.4, "review", 2),
        ("B", 3): ("ambiguous", 0, "red", 0.2, "review", 1),
    }
    asked = []

    def engine(open_):
        asked.append(open_)
        return open_.withColumn("choice", F.when(F.col("side") == "A", "free_throw").otherwise("closure_stroke")).withColumn("answer_confidence", F.lit(0.95))

    got = {(r.side, r.running_score): (r.shot_type, r.confidence, r.status) for r in ex.scoring_events(cells, engine).collect()}
    assert got[("A", 7)] == ("free_throw", 0.95, "accepted") and ("B", 3) not in got and asked[0].count() == 2
    boxes = spark.createDataFrame([("d", "A", 1, k + 1, (kind, "red", 0.5, 0.1, 1.0)) for k, kind in enumerate(("x", "ambiguous"))], f"document_id string, side string, period int, slot int, mark {MARK}")
    sure = lambda b: b.withColumn("choice", F.lit("unused")).withColumn("answer_confidence", F.lit(0.9))
    unsure = lambda b: b.withColumn("choice", F.lit("x")).withColumn("answer_confidence", F.lit(0.8))
    assert [sorted((r.slot, r.kind, r.confidence) for r in ex.settled_boxes(boxes, e).collect())[1] for e in (None, sure, unsure)] == [(2, "ambiguous", 0.5), (2, "unused", 0.9), (2, "ambiguous", 0.5)]


def test_player_fouls(spark):
    sep = (2, 0.9)
    rows = [(1, None, 0.1, "red", "P2", 0.9, "accepted"), (2, None, 0.1, "blue", "?", 0.9, "accepted"), (3, None, 0.001, "red", None, None, None), (4, ("closure_stroke", "blue", 0.9), 0.2, "blue", None, None, None), (5, None, 0.2, "red", "P", 0.9, "accepted")]
    cells = spark.createDataFrame([("d", "A", 4, *r, sep, True) for r in rows] + [("d", "A", 5, 1, None, 0.1, "red", " f ", 0.8, "review", (None, 0.1), True), ("d", "A", 6, 1, None, 0.1, "red", "T", 0.7, "accepted", (0, 0.65), True)],
        "document_id string, side string, jersey int, slot int, terminal struct<kind:string,ink_color:string,confidence:double>, ink_ratio double, ink_color string, symbol string, symbol_confidence double, symbol_status string, separator struct<first_half_slots:int,confidence:double>, grid_aligned boolean")
    fouls, terminals = ex.player_fouls(cells)
    assert sorted((r.jersey, r.slot, r.period, r.kind, r.confidence, r.status) for r in fouls.collect()) == [(4, 1, 1, "personal", 0.9, "accepted"), (4, 2, 2, "unknown", 0.9, "review"), (6, 1, 3, "technical", 0.65, "accepted")]
    assert sorted((r.jersey, r.slot, r.kind, r.raw_symbol, r.status) for r in terminals.collect()) == [(4, 4, "closure_stroke", "-", "accepted"), (5, 1, "disqualification", "F", "review")]


def test_read_numbers(spark):
    cols = "document_id string, side string, period int, ink double, value string, confidence double, recognised string"
    rows = spark.createDataFrame([("d", "A", 1, 0.1, "16", 0.95, "accepted"), ("d", "A", 2, 0.001, "9", 0.9, "accepted"), ("d", "A", 3, 0.1, "x", 0.9, "accepted"), ("d", "A", 4, 0.1, "7", 0.5, "accepted")], cols)
    with_threshold = {r.period: (r.candidate, r.written, r.status) for r in ex.written_scores(rows, 0.8).collect()}
    assert with_threshold == {1: (16, 16, "accepted"), 2: (None, None, "unresolved"), 3: (None, None, "unresolved"), 4: (7, None, "review")}
    assert {r.status for r in ex.written_scores(rows.filter("period in (1, 4)"), None).collect()} == {"review"}
    c = spark.createDataFrame([("d", "A", [("19", 0.55), ("14", 0.40), ("11", 0.05)]), ("d", "B", [("19", 0.55), ("14", 0.45)]), ("e", "A", [("19", 0.51), ("14", 0.49)])], "document_id string, side string, candidates array<struct<label:string,probability:double>>")
    rosters = spark.createDataFrame([("d", "A", 14), ("d", "A", 11)], "document_id string, side string, jersey int")
    assert {(r.document_id, r.side): (r.jersey, r.jersey_confidence) for r in ex.jerseys(c, rosters).collect()} == {("d", "A"): (14, 0.8889), ("d", "B"): (19, 0.55), ("e", "A"): (19, 0.51)}
    priors = spark.createDataFrame([("e", {"19": 0.05, "14": 0.95}, 100)], "document_id string, label_priors map<string,double>, sample_count int")
    assert {r.jersey for r in ex.jerseys(c, rosters, priors).filter("document_id = 'e'").collect()} == {14}
    s = spark.createDataFrame([("d", [("F", 0.9), ("Pc", 0.08), ("T", 0.02)])], "document_id string, candidates array<struct<label:string,probability:double>>")
    r = ex.foul_symbols(s).first()
    assert (r.symbol, r.symbol_status, r.symbol_confidence) == ("Pc", "accepted", 0.8)
    from tallyforge.operators import recognition as rc

    slots = spark.createDataFrame([([0.1] * 10 + [0.0], [0.05] * 10 + [0.5], ["7", "12", "x"])], "a array<double>, b array<double>, allowed array<string>")
    assert [(x.label, round(x.probability, 4)) for x in slots.select(rc.top_of_slots(F.col("a"), F.col("b"), F.col("allowed")).alias("t")).first().t] == [("7", 0.9091), ("12", 0.0909)]


def test_players(spark):
    roster = spark.createDataFrame([("d", "A", 1, 4), ("d", "A", 2, 5)], "document_id string, side string, row_no int, jersey int")
    marks = spark.createDataFrame([("d", "A", 1, ("blue_x", True, False, 1.0, 0.0, "accepted"))], "document_id string, side string, row_no int, mark struct<mark:string,participated:boolean,starter:boolean,participation_confidence:double,starter_confidence:double,status:string>")
    assert sorted((r.jersey, r.mark, r.participation_status) for r in ex.players(roster, marks).collect()) == [(4, "blue_x", "accepted"), (5, None, None)]
    rows = spark.createDataFrame([("d", "A", 1, 0.1, "4", 0.9, "accepted"), ("d", "A", 2, 0.1, "4", 0.9, "accepted"), ("d", "A", 3, 0.0, "9", 0.9, "accepted")], "document_id string, side string, row_no int, ink double, value string, confidence double, recognised string")
    assert sorted((r.row_no, r.jersey, r.row_status) for r in ex.read_roster(rows, 0.8).collect()) == [(1, 4, "accepted"), (2, 4, "unresolved")]
