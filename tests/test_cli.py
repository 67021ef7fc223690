"""Commands over a dataset folder, the streamed import, drawn numbers and debug parts."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cases import MANIFEST, crop_task
from test_files import png

from tallyforge import cli
from tallyforge.operators import images as im
from tallyforge.operators import synthetic as sy
from tallyforge.plans import template as tp
from tallyforge.streaming import reviews as st


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_schema(spark):
    got = cli.run(spark, ["schema"])
    assert len(got["core_fields"]) == 18 and {f["status"] for f in got["core_fields"]} == {"unresolved"} == {got["status"]}


def test_analyze_and_debug(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page = np.full((350, 248, 3), 255, np.uint8)
    (tmp_path / "in" / "d1.png").write_bytes(png(page))
    lines(tmp_path / "rosters.jsonl", [{"document_id": "d1", "side": "A", "row_no": 1, "jersey": 4}])
    size = ["--size", "248", "350"]
    got = cli.run(spark, ["analyze", str(tmp_path / "in"), "--rosters", str(tmp_path / "rosters.jsonl"), "--output", str(tmp_path / "out"), *size])
    assert got == {"scoring_events": 0, "team_fouls": 8, "fouls": 0, "terminals": 0, "players": 1}
    assert cli.run(spark, ["debug", str(tmp_path / "in"), "--output", str(tmp_path / "debug"), *size])["parts"] == [{"alignment_method": "resize", "document_id": "d1", "n": 16}]


def test_ingest_audit_and_baseline(spark, tmp_path):
    root = str(tmp_path / "data")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("U 15/1.png", png(np.zeros((3, 4, 3), np.uint8)))
        z.writestr("U 17/2.pdf", b"%PDF")
    got = cli.run(spark, ["dataset-ingest", str(tmp_path / "a.zip"), "--dataset", root])
    assert got["documents"] == 2 and {s["status"]: s["n"] for s in got["statuses"]} == {"alignment_review": 1, "unreadable": 1}
    truth = list((tmp_path / "data" / "ground_truth").glob("*.json"))
    assert len(truth) == 1
    audit = cli.run(spark, ["dataset-audit", "--dataset", root, "--seed", "s"])
    assert audit["status"] == "in_progress" and audit["review_status_counts"] == {"pending": 1}
    x = json.loads(truth[0].read_text())
    q = {"Q1": 2, "Q2": 0, "Q3": 0, "Q4": 0}
    side = {**x["teams"]["A"], "roster": [4], "team_fouls": q, "individual_fouls_reviewed": True}
    x |= {"review": {"status": "reviewed", "reviewed_at": "2020", "method": "manual"}, "teams": {"A": side, "B": side}, "period_scores": {"A": q, "B": q}, "final_score": {"A": 2, "B": 2}, "warnings": [], "evaluation_split": "test",
          "scoring": [{"team": s, "period": "Q1", "points": 2} for s in "AB"]}
    truth[0].write_text(json.dumps(x))
    cli.run(spark, ["dataset-ingest", str(tmp_path / "a.zip"), "--dataset", root])
    assert json.loads(truth[0].read_text()) == x
    row = {"document_id": truth[0].stem, "field_type": "t", "expected": "1", "predicted": "1", "confidence": 0.9}
    lines(tmp_path / "p.jsonl", [{**row, "field_id": "a"}, {**row, "field_id": "b", "predicted": None, "confidence": 0}])
    with pytest.raises(ValueError, match="No reviewed"):
        cli.run(spark, ["dataset-baseline", str(tmp_path / "p.jsonl"), "--dataset", root, "--seed", "s", "--split", "train"])
    got = cli.run(spark, ["dataset-baseline", str(tmp_path / "p.jsonl"), "--dataset", root, "--seed", "s"])
    assert got["threshold_found"] and got["prediction_records"] == 2 and got["end_to_end"][0]["unresolved"] == 1
    assert cli.run(spark, ["dataset-audit", "--dataset", root, "--seed", "s"])["status"] == "ready"


def test_reviews(spark, tmp_path):
    root = str(tmp_path)
    lines(tmp_path / "catalog.jsonl", [{"document_id": "d", "sha256": "s", "selected_pilot": True}])
    crop = {"crop_id": "c1", "document_id": "d", "field_type": "jersey", "source_image_hash": "s", "crop_image_hash": "h", "bbox_original": [0, 0, 40, 20], "status": "unlabeled"}
    lines(tmp_path / "crops" / "manifest.jsonl", [crop])
    lines(tmp_path / "crops" / "media.jsonl", [{**crop, "media": "a.png", "side": "A", "running_score": 2, "image_width": 80, "image_height": 40}])
    assert cli.run(spark, ["dataset-review-prepare", "--dataset", root, "--stage", "jerseys"]) == {"stage": "jerseys", "tasks": 1}
    (tmp_path / "e.json").write_text(json.dumps([crop_task()]))
    assert cli.run(spark, ["dataset-review-import", str(tmp_path / "e.json"), "--dataset", root, "--stage", "jerseys"])["states"] == [{"n": 1, "review_state": "adjusted"}]
    s = cli.run(spark, ["dataset-review-status", "--dataset", root])
    by = {c["stage"]: c for c in s["crops"]}
    assert (by["jerseys"]["trainable"], by["jerseys"]["audit_pending"], by["fouls"]["candidates"], s["geometry"]["expected_regions"], s["ready_for_training"]) == (1, 1, 0, 10, False)
    cli.run(spark, ["dataset-review-import", str(tmp_path / "e.json"), "--dataset", root, "--stage", "jerseys", "--audit-only"])
    by = {c["stage"]: c for c in cli.run(spark, ["dataset-review-status", "--dataset", root])["crops"]}
    assert by["jerseys"]["audit_pending"] == 0 and by["jerseys"]["ready"]


def test_streamed_import(spark, tmp_path):
    m = spark.createDataFrame([(c, "d", "jersey", None, None, None, "s", "h", [0, 0, 40, 20], "unlabeled") for c in ("c1", "c2")], MANIFEST)
    c = spark.createDataFrame([("d", "s")], "document_id string, sha256 string")
    folder = tmp_path / "in"
    folder.mkdir()
    for n, task in enumerate((crop_task("c1"), crop_task("c2", decision="illegible", label=None), crop_task("c1", label="13"))):
        (folder / f"{n}.json").write_text(json.dumps([task]))
        st.start_import(spark, str(folder), m, c, "jerseys", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.crop_id: (r.review_state, r.label) for r in st.latest_reviews(spark, str(tmp_path / "out")).collect()}
    assert got == {"c1": ("adjusted", "13"), "c2": ("illegible", None)}


def test_drawn_numbers(spark):
    a, b = (sy.numbers(spark, 40, 5, p).orderBy("id").collect() for p in (2, 5))
    assert a == b and len({r.label for r in a}) > 20
    assert all(im.ink(im.pixels(64, 32, bytes(r.image.rgb)))[0].any() or im.ink(im.pixels(64, 32, bytes(r.image.rgb)))[1].any() for r in a)


def test_debug_parts(spark):
    page = np.full((200, 100, 3), 255, np.uint8)
    rows = spark.createDataFrame([("d", (100, 200, page.tobytes()))], f"document_id string, image {im.IMAGE}")
    got = im.debug_parts(rows, tp.template(spark))
    assert got.count() == 16
    over = got.filter(F.col("name") == "regions-overlay").first().image
    assert (im.pixels(over.width, over.height, bytes(over.rgb)) == (255, 0, 0)).all(axis=2).any()
