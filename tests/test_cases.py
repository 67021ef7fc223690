"""Literal cases of the record operators."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as sc
from tallyforge.operators import annotations as an
from tallyforge.operators import evaluation as ev
from tallyforge.operators import governance as gv
from tallyforge.operators import groundtruth as gt
from tallyforge.operators import ordered as od
from tallyforge.operators import recognition as rc
from tallyforge.operators import reconcile as rec

EVENT = "document_id long, side string, event_id long, points long, shot_type string, jersey long, ink_color string, running_score long, confidence double, status string, seq long, period long"


def events(spark, rows):
    """rows: (running_score, points, shot_type, jersey, ink, period)."""
    return spark.createDataFrame([(1, "A", i, p, t, j, ink, s, 0.95, "accepted", i, per) for i, (s, p, t, j, ink, per) in enumerate(rows)], EVENT)


def roster(spark, jerseys):
    return spark.createDataFrame([(1, "A", j) for j in jerseys], "document_id long, side string, jersey long")


def test_totals(spark):
    e = events(spark, [(2, 2, "two_point", 4, "red", 1), (3, 1, "free_throw", 4, "red", 1), (6, 3, "three_point", 5, "blue", 2)])
    p = roster(spark, [4, 5, 6, 7, 8])
    assert rec.calculated_scores(e).first().calculated == 6
    assert {r.period: r.score for r in rec.period_scores(e).collect()} == {1: 3, 2: 3}
    box = {r.jersey: (r.points, r.three_points) for r in rec.box_score(e, p).collect()}
    assert box == {4: (3, 0), 5: (3, 1), 6: (0, 0), 7: (0, 0), 8: (0, 0)}
    assert {r.final_status for r in rec.event_status(e, p).collect()} == {"accepted"}


def test_gap_and_unknowns(spark):
    e = events(spark, [(2, 2, "two_point", 4, "red", 1), (5, 2, "two_point", None, "red", 1), (7, 2, "two_point", 9, "red", None), (9, 2, "two_point", 4, "red", None), (14, 2, "two_point", 4, "red", 1)])
    got = [r.final_status for r in rec.event_status(e, roster(spark, [4])).orderBy("event_id").collect()]
    assert got == ["accepted", "unresolved", "review", "unresolved", "review"]
    assert od.reconcile_delta(e).filter("jump").count() == 2


@pytest.mark.parametrize("inks, want", [(["red", "red", "blue", "red", "blue"], [1, 1, 2, 3, 4]), (["blue"], [2]), (["red", "blue", "red", "blue", "red", "blue"], [1, 2, 3, 4, None, 4]), (["unknown", "red"], [None, 1])])
def test_color_runs(spark, inks, want):
    e = events(spark, [(i + 1, 1, "free_throw", 4, ink, None) for i, ink in enumerate(inks)]).drop("period")
    assert [r.period for r in od.color_run_periods(e).orderBy("seq").collect()] == want


def test_plausible(spark):
    r = od.plausible_sequence(events(spark, [(3, 2, "two_point", 4, "red", None)])).first()
    assert (r.status, r.shot_type, r.points, r.confidence) == ("review", "two_point", 2, 0.69)


@pytest.mark.parametrize("kinds, want", [("x x ambiguous x", (4, True)), ("x x unused unused", (2, False)), ("unused ambiguous unused unused", (0, True)), ("empty empty empty empty", (0, False))])
def test_boxes(spark, kinds, want):
    rows = [(1, "A", 1, i + 1, k, 0.9) for i, k in enumerate(kinds.split())]
    r = rec.team_foul_boxes(spark.createDataFrame(rows, "document_id long, side string, period long, slot long, kind string, confidence double")).first()
    assert (r.x_count, r.review) == want and r.capped == (r.x_count == 4)


def test_symbols(spark):
    rows = spark.createDataFrame([("P2",), (" u1 ",), ("Pc",), ("GD",), ("?",), (None,)], "s string").select(sc.foul_symbol(F.col("s")).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in rows] == [("personal", 2, False, False, True), ("unsportsmanlike", 1, False, False, True), ("personal", None, True, False, False), ("disqualifying", None, False, True, False), ("unknown", None, False, False, False), ("unknown", None, False, False, False)]


def test_thresholds(spark):
    p = spark.createDataFrame([("14", "14", 0.99, True), ("7", "7", 0.95, True), ("11", "17", 0.60, False), ("5", "5", 0.80, False)], "expected string, predicted string, confidence double, writer_known boolean")
    r = ev.metrics(p, 0.80).first()
    assert (r.accepted, r.reviewed, r.errors) == (3, 1, 0)
    assert ev.chosen_threshold(ev.sweep(p), 0.0, 0.5).first().threshold == 0.80
    assert {r.writer_known: r.accuracy for r in ev.metrics(p, 0.8, "writer_known").collect()} == {True: 1.0, False: 0.5}


def test_no_safe_threshold(spark):
    p = spark.createDataFrame([("10", "9", 1.0), ("8", None, 0.0)], "expected string, predicted string, confidence double")
    c = ev.chosen_threshold(ev.sweep(p), 0.01, 0.1).first()
    assert not c.found and c.threshold > 1
    assert tuple(ev.decision_states(p, c.threshold).first())[:3] == (0, 1, 1)


def test_leakage(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), (None, "test")], "writer string, split string")
    with pytest.raises(ValueError, match="a"):
        gv.assert_no_leakage(rows, "writer")


def test_candidates(spark):
    rows = spark.createDataFrame([([("19", 0.55), ("14", 0.40), ("11", 0.05)], ["14", "11"]), ([("19", 0.5)], ["1"])], "candidates array<struct<label:string,probability:double>>, allowed array<string>")
    a, b = rc.constrained(rows).select("value", "value_confidence", "value_status").collect()
    assert a.value == "14" and a.value_confidence > 0.8 and a.value_status == "accepted"
    assert (b.value, b.value_confidence, b.value_status) == (None, 0.0, "review")


def test_prior_flip(spark):
    rows = spark.createDataFrame([([("19", 0.51), ("14", 0.49)], {"19": 0.05, "14": 0.95}, 100)], "c array<struct<label:string,probability:double>>, p map<string,double>, n int")
    best = rows.select(rc.top_ten(rc.reweighted(F.col("c"), F.col("p"), F.col("n"))).alias("t")).first().t[0]
    assert best.label == "14"


def test_first_label_slots(spark):
    f = spark.createDataFrame([(1, "A", 4, 1, "P"), (1, "A", 4, 2, "T")], "document_id long, side string, jersey long, ord int, symbol string")
    o = spark.createDataFrame([(1, "A", 4, 2, "P2"), (1, "A", 4, 3, "U")], "document_id long, side string, jersey long, slot long, symbol string")
    assert {r.slot: r.symbol for r in od.first_label_slots(f, o).collect()} == {1: "P", 2: "P2", 3: "U"}


def test_scalars(spark):
    r = spark.range(1).select(
        sc.pixel_box(F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(0.25), F.lit(10), F.lit(5)).alias("box"), sc.anonymous_writer(F.lit("  ")).alias("none"), sc.crop_id(F.lit("d"), F.lit("t"), F.lit(None)).alias("crop"),
        sc.number_in(F.lit(" 12 ")).alias("n"), sc.number_in(F.lit("120")).alias("big"), sc.shot(F.lit("field_goal"), F.lit(True)).alias("shot"), sc.capture_condition(F.lit("PDF")).alias("c")).first()
    assert (r.box, r.none, len(r.crop), r.n, r.big, tuple(r.shot), r.c) == ([2, 2, 8, 4], None, 20, 12, None, ("three_point", 3), "pdf_scan")


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_names_and_paths(spark):
    lit = F.lit
    assert one(spark, *[sc.slug(lit(x)) for x in ("Sub-17 Ca\u00e7a & \u00c1gua!", "  ", "--A__b--", "\u4e2d")]) == ("sub-17-caca-agua", "documento", "a-b", "documento")
    assert one(spark, *[sc.safe_path(lit(x)) for x in ("a/b.pdf", "a\\b.pdf", "../a/b.pdf", "/a/b.pdf", "b.pdf", "a/../b.pdf", "./a/b.pdf")]) == (True, True, False, False, False, False, True)
    assert one(spark, sc.category_of(lit("x/u15/1.pdf")), sc.document_id(lit("U 15"), lit("Jogo 1"), lit("abcdef0123456789"))) == ("u15", "u-15-jogo-1-abcdef01")
    with pytest.raises(Exception, match="Unsafe"):
        one(spark, sc.category_of(lit("../1.pdf")))
    # Known hashes: sha256("doc|jersey|A:2")[:20], sha256("writer:ana")[:12], sha1("doc|region")[:12].
    import hashlib

    sha = lambda x, n: hashlib.sha256(x.encode()).hexdigest()[:n]
    pos = sc.position_of(lit("jersey"), lit("A"), lit(2), lit(None), lit(None), lit(None))
    assert one(spark, sc.crop_id(lit("doc"), lit("jersey"), pos), sc.anonymous_writer(lit(" Ana ")), sc.result_id(lit("doc"), lit("region"))) == (sha("doc|jersey|A:2", 20), "writer_" + sha("writer:ana", 12), hashlib.sha1(b"doc|region").hexdigest()[:12])
    assert one(spark, sc.position_of(lit("foul_event"), lit("B"), lit(None), lit(3), lit(None), lit(None)), sc.position_of(lit("other"), lit("B"), lit(None), lit(3), lit(None), lit("p/x"))) == ("B:3:None", "p/x")
    assert one(spark, sc.media_url(lit("a b/\u00e9~*.png")), sc.position_text(lit("jersey"), lit("A"), lit(7), lit(None), lit(None)), sc.position_text(lit("foul_event"), lit("A"), lit(None), lit(2), lit(5))) == ("/data/local-files/?d=a%20b/%C3%A9~%2A.png", "score:A:7", "foul:A:row2:slot5")


def test_parsing(spark):
    lit = F.lit
    assert one(spark, sc.parsed_roster(lit(" 4, 10,,99 ")), sc.parsed_period_scores(lit("1, 2,3 ,0"))) == ([4, 10, 99], [1, 2, 3, 0])
    for text, message in (("x", "Invalid"), ("100", "0..99"), ("4,4", "Duplicate"), (" ,", "empty"), (",".join(map(str, range(13))), "at most 12")):
        with pytest.raises(Exception, match=message):
            one(spark, sc.parsed_roster(lit(text)))
    for text, message in (("1,2,3", "exactly four"), ("1,2,3,x", "non-negative"), ("1,2,3,-4", "non-negative")):
        with pytest.raises(Exception, match=message):
            one(spark, sc.parsed_period_scores(lit(text)))
    assert one(spark, *[sc.number_in(lit(x)) for x in ("+7", "-0", "007", "1e1", "", "99", "100", "-1", "1 2")]) == (7, 0, 7, None, None, 99, None, None, None)
    assert [tuple(x) for x in one(spark, sc.team_foul_indicator(lit(4)), sc.team_foul_indicator(lit(2)), sc.team_foul_indicator(lit(1), lit(3)))] == [(4, True, 4), (2, False, 2), (1, False, 3)]
    with pytest.raises(Exception, match="between 0 and 4"):
        one(spark, sc.team_foul_indicator(lit(5))["x_count"])
    assert one(spark, sc.three_point_confidence(lit(0.91), lit(0.87654))) == (0.8765,)


def test_boxes_of_crops(spark):
    lit = F.lit
    assert tuple(one(spark, sc.box_from_percent(lit(-1e-8), lit(50.0), lit(50.0), lit(50.0 + 1e-8)))[0]) == (0.0, 0.5, 0.5, 0.5)
    for box in ((-1.0, 0.0, 5.0, 5.0), (0.0, 0.0, 0.0, 5.0), (90.0, 0.0, 20.0, 5.0), (None, 0.0, 1.0, 1.0)):
        with pytest.raises(Exception, match="ounding box"):
            one(spark, sc.box_from_percent(*[lit(v).cast("double") for v in box]))
    share = F.struct(lit(0.25).alias("x"), lit(0.5).alias("y"), lit(0.5).alias("width"), lit(0.25).alias("height"))
    assert one(spark, sc.box_to_pixels(share, lit(10), lit(8))) == ([2, 4, 8, 6],)
    assert tuple(one(spark, sc.box_to_percent(F.array(lit(2), lit(4), lit(8), lit(6)), lit(10), lit(8)))[0]) == (20.0, 50.0, 60.0, 25.0)
    with pytest.raises(Exception, match="bounding box"):
        one(spark, sc.checked_pixel_box(F.array(lit(0), lit(0), lit(11), lit(5)), lit(10), lit(8)))
    with pytest.raises(Exception, match="normalized bounds"):
        one(spark, sc.checked_rectangle(lit(0.6), lit(0.0), lit(0.5), lit(0.1)))


def test_labels_and_states(spark):
    lit = F.lit
    assert one(spark, sc.final_label(lit("jersey"), lit(" 07 ")), sc.final_label(lit("foul_event"), lit("p c")), sc.final_label(lit("foul_symbol"), lit("u2"))) == ("07", "Pc", "U2")
    for kind, label in (("jersey", "100"), ("jersey", "x"), ("foul_event", "F"), ("jersey", None)):
        with pytest.raises(Exception, match="label"):
            one(spark, sc.final_label(lit(kind), lit(label).cast("string")))
    text = lambda x: lit(x).cast("string")
    warn = lambda *x: F.array(*map(lit, x)).cast("array<string>")
    assert one(spark, sc.review_status(text(" Reviewed "), warn()), sc.review_status(text(" "), warn("Gabarito PENDENTE.")), sc.review_status(text(None), warn("x"))) == ("reviewed", "pending", "unverified")
    keep = lambda state, status, label="7": sc.in_training(lit("jersey"), lit("train"), text(label), text(state), text(status), "jersey", "train")
    assert one(spark, keep("adjusted", None), keep("pending", "labeled"), keep(None, "labeled"), keep(None, "unlabeled"), keep("accepted", None, None)) == (True, False, True, False, False)
    assert one(spark, sc.jersey_slots(lit("7")), sc.jersey_slots(lit("12"))) == ([7, 10], [1, 2])
    p = F.array(*[lit(k / 55) for k in range(11)])
    assert abs(one(spark, sc.jersey_probability(p, p, lit("12")))[0] - 2 / 55**2) < 1e-12
    assert one(spark, sc.catalogue_status(lit(True), text(None)), sc.catalogue_status(lit(False), text(None)), sc.catalogue_status(lit(None).cast("boolean"), lit("E: x"))) == ("ready", "alignment_review", "unreadable")
    assert one(spark, *[sc.dominant_colour(lit(a), lit(b)) for a, b in ((0, 0), (62, 38), (38, 62), (50, 50))]) == ("unknown", "red", "blue", "unknown")
    assert one(spark, *[sc.red_blue_ink(*map(lit, c)) for c in ((200, 35, 35), (20, 60, 190), (255, 255, 255), (90, 80, 70))], sc.red_blue_ink(lit(80), lit(62), lit(52)), sc.red_blue_ink(lit(80), lit(62), lit(52), sc.PARTICIPATION_INK)) == ("red", "blue", None, None, "red", None)


def test_warnings_of_a_side(spark):
    e = events(spark, [(2, 2, "two_point", 4, "red", 1), (5, 2, "two_point", None, "red", None), (6, 0, "ambiguous", 4, "red", 1), (8, 3, "three_point", 9, "red", 1)])
    got = [r.warnings for r in rec.event_status(e, roster(spark, [4])).orderBy("seq").collect()]
    assert got == [[], ["Score 5: jump of 3 is incompatible with a 2-point event", "Score 5: period is unresolved", "Score 5: jersey is unresolved"], ["Score 6: ambiguous shot type"], ["Score 8: jersey 9 is not in the supplied roster"]]
    side = "document_id long, side string, "
    teams = spark.createDataFrame([(1, "A", 9)], side + "written_final long")
    players = spark.createDataFrame([(1, "A", 1, 4, False, True, 2), (1, "A", 2, 5, False, False, 0), (1, "A", 3, 6, True, True, 0)], side + "row_no long, jersey long, participated boolean, starter boolean, points long")
    fouls = spark.createDataFrame([(1, "A", 5)], side + "jersey long")
    spine = spark.createDataFrame([(1, "A", 1, 7, 7), (1, "A", 2, 0, 3), (1, "A", 3, 0, None)], side + "period long, score long, written long")
    v = rec.validation_warnings(teams, players, fouls, e, spine)
    w = rec.side_warnings(rec.event_status(e, roster(spark, [4])), spark.createDataFrame([], side + "period long, x_count long, fouls long"), v).first().warnings
    assert w[5:] == ["Detected 2 starters; expected 5", "Jersey 4: starter without participation", "Jersey 4: has a game event without a participation mark", "Jersey 5: has a game event without a participation mark", "Calculated score (7) differs from written score (9)", "Q2: calculated period score (0) differs from written score (3)"]
    both = rec.document_warnings(spark.createDataFrame([(1, "B", ["x"]), (1, "A", ["y", "z"])], side + "warnings array<string>"))
    assert both.first().warnings == ["Team A: y", "Team A: z", "Team B: x"]


def test_recognised_roster(spark):
    rows = spark.createDataFrame([(1, "A", 1, 4, 0.9, "accepted"), (1, "A", 2, 4, 0.95, "accepted"), (1, "B", 1, 7, 0.5, "accepted"), (1, "B", 2, 8, 0.9, "accepted")], "document_id long, side string, row_no long, jersey long, confidence double, recognised string")
    sides = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "document_id long, side string")
    got = {(r.document_id, r.side): (r.roster_status, r.jerseys) for r in od.roster_status(sides, od.recognised_rows(rows, 0.8)).collect()}
    assert got == {(1, "A"): ("unresolved", [4]), (1, "B"): ("review", [8]), (2, "A"): ("unresolved", [])}
    assert {r.row_status for r in od.recognised_rows(rows, None).collect()} == {"review"}


def test_profiles_and_lines(spark):
    p = spark.createDataFrame([(1, x, v) for x, v in ((1, 5), (10, 4), (20, 3), (21, 2), (23, 1))], "cell long, pos long, value long")
    assert sorted(r.pos for r in od.local_maxima(p, 1, ("cell",)).collect()) == [1, 10, 20]
    assert sorted((r.first_value, r.last_value, r.center) for r in od.runs(p, "pos", ("cell",)).collect()) == [(1, 1, 1), (10, 10, 10), (20, 21, 20), (23, 23, 23)] and od.longest_run(p, "pos", ("cell",)).first().longest == 2
    assert [r.center for r in od.gap_clusters(p, "pos", 4, ("cell",), "value").orderBy("cluster").collect()] == [1, 10, 21]
    want = spark.createDataFrame([(1, 15.0), (1, 22.0), (2, 1.0)], "cell long, at double")
    assert sorted((r["at"], r.nearest) for r in od.nearest(p, want, "pos", "at", ("cell",)).collect()) == [(1.0, None), (15.0, 10), (22.0, 21)]


def test_slices_take_their_own_thresholds(spark):
    rows = [("a", "x", "x", 0.4), ("a", "x", "y", 0.3), ("b", "x", "x", 0.9), ("b", "x", None, 1.0)]
    p = spark.createDataFrame([(*r, "pdf_scan", True, False) for r in rows], "field_type string, expected string, predicted string, confidence double, capture string, writer_known boolean, writer_seen boolean")
    own = ev.chosen_threshold(ev.sweep(p, "field_type"), 0.0, 0.1, "field_type")
    got = {(r.slice, r.value): (r.total, r.accepted) for r in ev.sliced(p, 0.8, own).collect()}
    assert got[("field_type", "a")] == (2, 1) and got[("field_type", "b")] == (2, 1) and got[("all", "*")] == (4, 1)
    assert got[("writer_seen", "yes")] == (0, 0) and got[("writer_known", "no")] == (0, 0)
    assert {r.writer: r.total for r in ev.by_writer(p, 0.8).collect()} == {"known_writer": 4, "unknown_writer": 0}


def crop_task(crop="c1", decision="accepted", label="12", box=(0, 0, 50, 50), **data):
    value = dict(zip(("x", "y", "width", "height"), box, strict=True))
    results = [{"id": "r", "type": "rectanglelabels", "from_name": "bbox", "value": {**value, "rectanglelabels": ["candidate"]}}]
    results += [{"id": "r", "type": "choices", "from_name": "decision", "value": {"choices": [decision]}}] if decision else []
    results += [{"id": "r", "type": "textarea", "from_name": "final_label", "value": {"text": [label]}}] if label else []
    return {"data": {"crop_id": crop, "source_image_hash": "s", "crop_image_hash": "h", "image_width": 80, "image_height": 40, **data}, "annotations": [{"result": results}]}


def export(spark, tmp_path, tasks):
    import json
    import uuid

    path = tmp_path / f"{uuid.uuid4().hex}.json"
    path.write_text(json.dumps(tasks, indent=1))
    return an.read_export(spark, str(path))


MANIFEST = "crop_id string, document_id string, field_type string, label string, predicted_label string, model_trainable boolean, source_image_hash string, crop_image_hash string, bbox_original array<int>, status string"


def test_review_round_trip(spark, tmp_path):
    """An unlabelled crop that is accepted with a label is adjusted, is the audit sample, and passes or is corrected."""
    m = spark.createDataFrame([("c1", "d", "scoring_event", None, None, None, "s", "h", [0, 0, 40, 20], "unlabeled"), ("c2", "d", "jersey", "7", None, None, "s", "h", None, "unlabeled")], MANIFEST)
    c = spark.createDataFrame([("d", "s", True)], "document_id string, sha256 string, selected_pilot boolean")
    decided = an.imported_crops(export(spark, tmp_path, [crop_task()]), m, c, "scoring")
    r = decided.first()
    assert (r.review_state, r.label_final, r.bbox_revised, r.status) == ("adjusted", "12", [0, 0, 40, 20], "labeled")
    all_ = an.reviewed_manifest(m, decided, None, "scoring")
    got = {x.crop_id: (x.review_state, x.label, x.audit_required, x.audit_state) for x in all_.collect()}
    assert got == {"c1": ("adjusted", "12", True, "pending"), "c2": ("pending", "7", False, None)}
    again = lambda **k: an.audited_crops(export(spark, tmp_path, [crop_task(**k)]), all_, c, "scoring").filter("crop_id = 'c1'").first()
    assert (again().audit_state, again().review_state) == ("passed", "accepted")
    x = again(label="13")
    assert (x.audit_state, x.review_state, x.label) == ("corrected", "adjusted", "13")
    x = again(decision="illegible", label=None)
    assert (x.audit_state, x.review_state, x.label, x.status) == ("corrected", "illegible", None, "excluded")
    with pytest.raises(Exception, match="audit sample"):
        an.audited_crops(export(spark, tmp_path, [crop_task("c2")]), all_, c, "scoring").collect()
    kept = an.reviewed_manifest(m, decided.limit(0), all_, "scoring").filter("crop_id = 'c1'").first()
    assert (kept.review_state, kept.label) == ("adjusted", "12")


@pytest.mark.parametrize("tasks, message", [
    ([crop_task("c9")], "Unknown crop_id"), ([crop_task(), crop_task()], "Duplicate crop_id"), ([crop_task(source_image_hash="old")], "version mismatch"), ([crop_task(crop_image_hash="old")], "different crop version"),
    ([crop_task(decision="maybe")], "Invalid decision"), ([crop_task(label=None)], "requires a label"), ([crop_task(label="100")], "Invalid label"), ([crop_task(box=(60, 0, 50, 50))], "Bounding box"), ([crop_task(image_width=0)], "Invalid dimensions"),
    ({"data": {}}, "task list"), ([{"annotations": []}], "data object"), ([crop_task("f")], "Not of stage"),
])
def test_refused_reviews(spark, tmp_path, tasks, message):
    m = spark.createDataFrame([("c1", "d", "jersey", None, None, None, "s", "h", None, "unlabeled"), ("f", "d", "foul_event", None, None, None, "s", "h", None, "unlabeled")], MANIFEST)
    c = spark.createDataFrame([("d", "s")], "document_id string, sha256 string")
    with pytest.raises(Exception, match=message):
        an.imported_crops(export(spark, tmp_path, tasks), m, c, "jerseys").collect()


def region_task(document="d", region="final_score", state="usable", **more):
    box = {"id": "g", "type": "rectanglelabels", "from_name": "region", "value": {"x": 10, "y": 10, "width": 20, "height": 20, "rectanglelabels": [region]}}
    choice = {"id": "g", "type": "choices", "from_name": "geometry_state", "value": {"choices": [state]}}
    return {"data": {"document_id": document, "source_image_hash": "s"}, "annotations": [{"was_cancelled": True, "result": []}, {"result": [box, choice]}], **more}


def test_geometry_import(spark, tmp_path):
    from tallyforge.plans.template import template

    c = spark.createDataFrame([("d", "s", True), ("x-d2", "s", True), ("d3", "s", False)], "document_id string, sha256 string, selected_pilot boolean")
    t = template(spark)
    uploaded = region_task(None, state="unusable", file_upload="up/1234-x-d2.png")
    got = {r.document_id: (r.region, r.state, r.box) for r in an.imported_regions(export(spark, tmp_path, [region_task(), uploaded, {**region_task("d3"), "annotations": []}]), c, t).collect()}
    assert got == {"d": ("final_score", "usable", [0.1, 0.1, 0.2, 0.2]), "x-d2": ("final_score", "unusable", [0.1, 0.1, 0.2, 0.2])}
    for tasks, message in (([region_task(), region_task()], "Duplicate document"), ([region_task("q")], "Unknown document"), ([region_task(region="q")], "Unknown region"), ([region_task(state="q")], "geometry state"), ([region_task(None, file_upload="z.png")], "No unique document")):
        with pytest.raises(Exception, match=message):
            an.imported_regions(export(spark, tmp_path, tasks), c, t).collect()
    stale = region_task()
    stale["data"]["source_image_hash"] = "0"
    with pytest.raises(Exception, match="version mismatch"):
        an.imported_regions(export(spark, tmp_path, [stale]), c, t).collect()


def test_tasks_given_out(spark):
    import json

    row = ("c", "d", "scoring_event", "A", 2, None, None, "Q1", "two_point", None, None, "crops/a b.png", 80, 30, [0, 0, 40, 30], "s", "h", "pending")
    cols = "crop_id string, document_id string, field_type string, side string, running_score long, row long, slot long, period string, predicted_type string, predicted_label string, label string, media string, image_width int, image_height int, bbox_original array<int>, source_image_hash string, crop_image_hash string, review_state string"
    done = (*row[:-1], "accepted")
    t = [json.loads(r.task) for r in an.crop_tasks(spark.createDataFrame([row, ("c2", *done[1:])], cols), "scoring").collect()]
    assert len(t) == 1 and t[0]["data"]["position"] == "score:A:2" and t[0]["data"]["image"].endswith("crops/a%20b.png")
    assert t[0]["predictions"][0]["result"][0]["value"]["width"] == 50.0 and t[0]["predictions"][0]["result"][0]["value"]["height"] == 100.0
    xml = an.labelling_config(("a", "b"))
    assert '<Label value="b" />' in xml and "geometry_state" in xml and '<Choice value="illegible" />' in an.labelling_config()


def test_ground_truth_audit(spark, tmp_path):
    import json

    side = {"roster": [4], "team_fouls": {"Q1": 0, "Q2": 0, "Q3": 0, "Q4": 0}, "individual_fouls_reviewed": True}
    zero = {"Q1": 2, "Q2": 0, "Q3": 0, "Q4": 0}
    good = {"game_id": "a", "source_file": "s/a", "writer_name": "Ana", "review": {"status": "reviewed", "reviewed_at": "2020-01-01", "method": "manual"}, "teams": {"A": side, "B": side}, "period_scores": {"A": zero, "B": {**zero, "Q1": 0}}, "final_score": {"A": 2, "B": 0},
            "scoring": [{"team": "A", "period": "Q1", "points": 2}]}
    seen = {**side, "individual_foul_observations": {"4": [{"slot": 1, "review_state": "unresolved", "note": "x"}]}}
    files = {"a": good, "b": {**good, "game_id": "b", "source_file": "s/b", "teams": {"A": seen, "B": side}, "review": {"status": "reviewed", "reviewed_at": None, "method": "manual"}}, "c": {"teams": 1}, "orphan": {}}
    for n, x in files.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(x, indent=1))
    catalog = spark.createDataFrame([(n, f"s/{n}", "h", k) for k, n in enumerate("abcb")], "document_id string, source_path string, sha256 string, ord int")
    rows, report = gt.audit(gt.read_ground_truth(spark, str(tmp_path)), catalog, "s1")
    got = {r.document_id: r for r in rows.collect()}
    assert got["a"].issues == [] and got["b"].issues == ["reviewed_at_missing"] and got["b"].individual_foul_observation_counts == {"unresolved": 1}
    assert got["c"].issues == ["game_id_mismatch", "source_file_mismatch", "teams_missing"]
    r = report.first()
    assert (r.ground_truth_documents, r.reviewed_ground_truth_documents, r.known_writers, r.status) == (3, 1, 1, "in_progress") and r.duplicate_documents == ["b"] and r.orphan_ground_truth == ["orphan"]
    # The fingerprint is that of the rows as one JSON text, keys in order; the same corpus as the last metrics' is ready once all is reviewed.
    import hashlib

    text = json.dumps([got[k].asDict() for k in sorted(got)], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert r.corpus_sha256 == hashlib.sha256(text.encode()).hexdigest()
    one = catalog.filter("document_id = 'a'")
    both, orphans, twice = gt.matched(gt.read_ground_truth(spark, str(tmp_path / "a.json")), one)
    a = gt.audit_rows(both, "s1")
    assert gt.audit_report(a, one, orphans, twice, "x", "x").first().status == "ready" and gt.audit_report(a, one, orphans, twice, "x").first().status == "in_progress"


def test_coverage_and_defaults(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    cols = "document_id string, field_id string, field_type string, expected string, predicted string, confidence double, writer_known boolean, writer_seen boolean, capture string"
    p = spark.createDataFrame([("a", "f", "t", "1", None, 0.5, None, None, None)], cols)
    with pytest.raises(ValueError, match="cover every"):
        gv.assert_covered(docs, p)
    with pytest.raises(ValueError, match="outside"):
        gv.assert_covered(docs.filter("document_id = 'b'"), p)
    r = gv.checked_predictions(p).first()
    assert (r.writer_known, r.writer_seen, r.capture) == (False, False, "unspecified")
    for bad, message in ((("a", " ", "t", "1", None, 0.5, None, None, None), "field_id"), (("a", "f", None, "1", None, 0.5, None, None, None), "field_type"), (("a", "g", "t", None, None, 0.5, None, None, None), "expected")):
        with pytest.raises(Exception, match=message):
            gv.checked_predictions(spark.createDataFrame([bad], cols)).collect()
    with pytest.raises(Exception, match="Duplicate prediction"):
        gv.checked_predictions(p.unionByName(p)).collect()


def test_core_fields_of_missing_sides(spark):
    from tallyforge.operators import assessment as asm

    def empty(columns):
        return spark.createDataFrame([], "document_id long, side string, " + columns)

    docs = spark.createDataFrame([(1,)], "document_id long")
    teams = spark.createDataFrame([(1, "A", "x", "accepted", 0, None, "accepted")], "document_id long, side string, name string, roster_status string, final_score long, final_candidate long, final_status string")
    periods = spark.createDataFrame([(1, "A", p, 0, None, "accepted") for p in (1, 2, 3, 4)], "document_id long, side string, period long, written long, candidate long, status string")
    got = asm.core_fields(docs, teams, empty("participation_status string, starter_status string, starter boolean"), empty("status string"), empty("status string"), empty("period long"), periods).collect()
    assert len(got) == 18 and {r.reason for r in got if r.side == "B"} == {asm.MISSING}
    side = {r.path.split(".")[2]: r.status for r in got if r.side == "A"}
    assert [k for k, s in side.items() if s == "accepted"] == ["name", "period_scoring", "scoring_events", "final_score"]
    assert {r.reason for r in got if r.path == "teams.A.starters"} == {"starter evidence requires review; detected 0 starters"}
