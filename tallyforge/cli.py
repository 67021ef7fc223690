"""Commands over a dataset folder: catalog.jsonl, ground_truth/*.json, crops/, review/ and evaluation/ below it. Run `python -m tallyforge.cli -h`."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis as ay
from .operators import annotations as an
from .operators import evaluation as ev
from .operators import governance as gv
from .operators import groundtruth as gt
from .operators import images as im
from .operators import pages as pg
from .plans import template as tp
from .sources import files

CATALOG = "document_id string, original_name string, source_path string, category string, extension string, sha256 string, size_bytes long, status string, error string, selected_pilot boolean"
PREDICTION = "document_id string, field_id string, field_type string, expected string, predicted string, confidence double, writer_known boolean, writer_seen_in_training boolean, capture_condition string"
MANIFEST = "crop_id string, document_id string, field_type string, label string, predicted_label string, model_trainable boolean, source_image_hash string, crop_image_hash string, bbox_original array<int>, status string"
REGION_NAMES = tuple(n for n in tp.REGIONS if not n.endswith(("_jersey", "_participation")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *args: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=text)
        for flag, options in args:
            c.add_argument(flag, **options)

    root = ("--dataset", {"default": "dataset"})
    seed = ("--seed", {"required": True, "help": "names the deterministic split"})
    stage = ("--stage", {"required": True, "choices": ["geometry", *an.STAGE_FIELDS]})
    command("schema", "print an empty document's core fields")
    size = ("--size", {"type": int, "nargs": 2, "default": tp.PAGE, "metavar": ("WIDTH", "HEIGHT"), "help": "pixels of a straight page"})
    command("analyze", "images of pages and rosters to tables of events, fouls, terminals, team fouls and players", ("images", {}), ("--rosters", {"required": True, "help": "JSON lines of document_id, side, row_no, jersey"}), ("--output", {"required": True}), size)
    command("debug", "straight pages, outlines and parts of the form's regions as a table", ("images", {}), ("--output", {"default": "debug"}), size)
    command("dataset-ingest", "archives of scans to catalogue rows, pilots and empty ground truth", ("archive", {}), root, ("--pilot-count", {"type": int, "default": 5}))
    command("dataset-audit", "what ground truth lacks, the evaluation manifest and the report", root, seed)
    command("dataset-baseline", "metrics of predictions on reviewed documents", ("predictions", {}), root, seed, ("--split", {"action": "append", "choices": list(gt.SPLITS)}), ("--max-accepted-error-rate", {"type": float, "default": 0.01}), ("--min-automation-rate", {"type": float, "default": 0.10}))
    command("dataset-review-prepare", "the review form of a stage, and its tasks from crops/media.jsonl", root, stage)
    command("dataset-review-import", "a review export onto the manifest or the regions", ("export", {}), root, stage, ("--audit-only", {"action": "store_true"}))
    command("dataset-review-status", "progress of the reviews by stage", root)
    return p


def _catalog(spark: SparkSession, root: str) -> DataFrame:
    return files.read_jsonl(spark, f"{root}/catalog.jsonl", CATALOG)


def _told(rows: DataFrame) -> list[dict]:
    """Rows of a report, which are few."""
    return [json.loads(x.value) for x in files.report(rows).collect()]


def _saved(path: str, result: object) -> object:
    files.write_document(json.dumps(result, ensure_ascii=False, indent=2, sort_keys=True), path)
    return result


def _pages(spark: SparkSession, images: str) -> DataFrame:
    """(document_id, image) of PNG and JPEG files, named by their stems."""
    name = F.regexp_extract("origin", r"([^/]*)\.[^./]*$", 1)
    return files.read_images(spark, images).select(name.alias("document_id"), F.struct("width", "height", "rgb").alias("image"))


def analyze(spark: SparkSession, images: str, rosters: str, output: str, size: Sequence[int]) -> dict:
    listed = files.read_jsonl(spark, rosters, "document_id string, side string, row_no int, jersey long")
    tables = ay.analyzed(_pages(spark, images), listed, size=tuple(size))
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{output}/{name}")
    return {name: spark.read.parquet(f"{output}/{name}").count() for name in tables}


def debug(spark: SparkSession, images: str, output: str, size: Sequence[int]) -> dict:
    pages = pg.normalized(_pages(spark, images), *size)
    im.debug_parts(pages.select("document_id", "alignment_method", "image"), tp.template(spark)).write.mode("overwrite").parquet(output)
    return {"output": output, "parts": _told(spark.read.parquet(output).groupBy("document_id", "alignment_method").agg(F.count(F.lit(1)).alias("n")).orderBy("document_id"))}


def ingest(spark: SparkSession, archive: str, root: str, pilot_count: int) -> dict:
    rows = files.ingested(files.read_archives(spark, archive), files.image_header)
    chosen = gv.pilots(rows, pilot_count)
    marked = rows.join(chosen.select("document_id", F.lit(True).alias("selected_pilot")), "document_id", "left").na.fill({"selected_pilot": False})
    files.write_jsonl(marked.orderBy("document_id"), f"{root}/catalog.jsonl", "overwrite")
    catalog = _catalog(spark, root)
    for r in catalog.filter("selected_pilot").collect():  # as many as pilots
        quarters = dict.fromkeys(gt.QUARTERS)
        side = {"roster": [], "team_fouls": quarters, "individual_fouls": {}, "individual_fouls_reviewed": False, "individual_foul_observations": {}}
        empty = {"game_id": r.document_id, "source_file": r.source_path, "writer_name": None, "evaluation_split": None, "review": {"status": "pending", "reviewed_at": None, "method": "manual"}, "teams": dict.fromkeys(gt.SIDES, side), "scoring": [], "period_scores": dict.fromkeys(gt.SIDES, quarters), "final_score": dict.fromkeys(gt.SIDES), "warnings": ["pendente"]}
        path = f"{root}/ground_truth/{r.document_id}.json"
        if files.read_or_empty(spark, path, "game_id string", whole=True).isEmpty():  # what was filled in is never overwritten
            files.write_document(json.dumps(empty, ensure_ascii=False, indent=2), path)
    return _saved(f"{root}/ingest-summary.json", {"documents": catalog.count(), "statuses": _told(gv.ingest_summary(catalog, gv.pilots(catalog, pilot_count)))})


def _audited(spark: SparkSession, root: str, seed: str) -> tuple[DataFrame, dict]:
    last = files.read_or_empty(spark, f"{root}/evaluation/baseline-metrics.json", "corpus_sha256 string", whole=True).first()
    catalog = _catalog(spark, root).withColumn("ord", F.monotonically_increasing_id())
    rows, report = gt.audit(gt.read_ground_truth(spark, f"{root}/ground_truth"), catalog, seed, last.corpus_sha256 if last else None)
    return rows, _told(report)[0]


def audit(spark: SparkSession, root: str, seed: str) -> dict:
    rows, report = _audited(spark, root, seed)
    files.write_jsonl(rows, f"{root}/evaluation/evaluation-manifest", "overwrite")
    return _saved(f"{root}/evaluation/audit.json", report)


def baseline(spark: SparkSession, predictions: str, root: str, seed: str, splits: Sequence[str], max_error: float, min_automation: float) -> dict:
    manifest, report = _audited(spark, root, seed)
    eligible = manifest.filter(F.col("split").isin(*splits) & F.col("review_status").isin(*gt.REVIEWED) & F.col("ground_truth_complete")).select("document_id")
    if eligible.isEmpty():
        raise ValueError("No reviewed and complete documents are available")
    rows = files.read_jsonl(spark, predictions, PREDICTION).withColumnsRenamed({"writer_seen_in_training": "writer_seen", "capture_condition": "capture"})
    gv.assert_covered(eligible, rows)
    p = gv.checked_predictions(rows).cache()
    overall = ev.chosen_threshold(ev.sweep(p), max_error, min_automation).first()
    own = ev.chosen_threshold(ev.sweep(p, "field_type"), max_error, min_automation, "field_type")
    result = {
        "corpus_sha256": report["corpus_sha256"], "prediction_records": p.count(), "evaluation_splits": list(splits), "threshold": overall.threshold, "threshold_found": overall.found, "field_type_thresholds": _told(own.orderBy("field_type")),
        "slices": _told(ev.sliced(p, overall.threshold, own).orderBy("slice", "value")), "writers": _told(ev.by_writer(p, overall.threshold).orderBy("writer")), "end_to_end": _told(ev.decision_states(p, overall.threshold)),
    }
    p.unpersist()
    return _saved(f"{root}/evaluation/baseline-metrics.json", result)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return files.read_or_empty(spark, f"{root}/crops/manifest.jsonl", MANIFEST)


def _reviewed(spark: SparkSession, root: str) -> DataFrame | None:
    """Reviews as the last import left them, in the folder that review/crops.current names."""
    at = files.read_or_empty(spark, f"{root}/review/crops.current.json", "path string").first()
    return spark.read.parquet(at.path) if at else None


def review_import(spark: SparkSession, export: str, root: str, stage: str, audit_only: bool) -> dict:
    import uuid

    tasks, catalog = an.read_export(spark, export), _catalog(spark, root)
    path = f"{root}/review/{'regions' if stage == 'geometry' else 'crops'}-{uuid.uuid4().hex}"
    if stage == "geometry":
        if audit_only:
            raise ValueError("An audit is of crops only")
        at = files.read_or_empty(spark, f"{root}/review/regions.current.json", "path string").first()
        new = an.imported_regions(tasks, catalog, tp.template(spark))
        (gv.merged_regions(spark.read.parquet(at.path), new) if at else new).write.parquet(path)
        files.write_document(json.dumps({"path": path}), f"{root}/review/regions.current.json")
        return {"stage": stage, "tasks": tasks.count(), "regions": spark.read.parquet(path).count()}
    earlier = _reviewed(spark, root)
    if audit_only:
        if earlier is None:
            raise ValueError("No reviews to audit")
        out = an.audited_crops(tasks, earlier, catalog, stage)
    else:
        out = an.reviewed_manifest(_manifest(spark, root), an.imported_crops(tasks, _manifest(spark, root), catalog, stage), earlier, stage)
    # A new folder each time: what is read is never overwritten.
    out.write.parquet(path)
    files.write_document(json.dumps({"path": path}), f"{root}/review/crops.current.json")
    counts = spark.read.parquet(path).groupBy("review_state").agg(F.count(F.lit(1)).alias("n"))
    return {"stage": stage, "tasks": tasks.count(), "states": _told(counts.orderBy("review_state"))}


def review_status(spark: SparkSession, root: str) -> dict:
    manifest = _manifest(spark, root)
    reviewed = _reviewed(spark, root)
    empty = spark.createDataFrame([], "crop_id string, review_state string, label string, model_trainable boolean, source_image_hash string, crop_image_hash string, audit_required boolean, audit_state string")
    crops = _told(gv.review_progress(manifest, empty if reviewed is None else reviewed).orderBy("stage"))
    at = files.read_or_empty(spark, f"{root}/review/regions.current.json", "path string").first()
    regions = spark.read.parquet(at.path) if at else spark.createDataFrame([], "document_id string, region string, state string")
    geometry = _told(gv.geometry_progress(_catalog(spark, root).filter("selected_pilot"), regions, REGION_NAMES))
    return {"geometry": geometry[0], "crops": crops, "ready_for_training": all(c["ready"] for c in crops)}


def review_prepare(spark: SparkSession, root: str, stage: str) -> dict:
    form = an.labelling_config(REGION_NAMES) if stage == "geometry" else an.labelling_config(vocabulary="0-99" if stage in ("scoring", "jerseys") else ", ".join(an.FOUL_LABELS))
    files.write_document(form, f"{root}/review/{stage}.xml")
    if stage == "geometry":
        return {"stage": stage, "tasks": 0}
    more = "side string, running_score long, row long, slot long, period string, predicted_type string, media string, image_width int, image_height int, review_state string"
    tasks = an.crop_tasks(files.read_or_empty(spark, f"{root}/crops/media.jsonl", f"{MANIFEST}, {more}"), stage)
    tasks.select("task").write.mode("overwrite").text(f"{root}/review/{stage}.tasks")
    return {"stage": stage, "tasks": tasks.count()}


def schema(spark: SparkSession) -> dict:
    from .operators import assessment as asm

    side = lambda cols: spark.createDataFrame([], "document_id long, side string, " + cols)
    tables = {"teams": "name string, roster_status string, final_score long, final_candidate long, final_status string", "players": "participation_status string, starter_status string, starter boolean", "fouls": "status string", "events": "status string", "team_fouls": "period long", "periods": "period long, written long, candidate long, status string"}
    fields = asm.core_fields(spark.createDataFrame([(1,)], "document_id long"), **{k: side(v) for k, v in tables.items()})
    return {"core_fields": _told(fields.orderBy("side", "pos").select("path", "status", "reason")), "status": _told(asm.document_status(fields))[0]["status"], "warnings": []}


def run(spark: SparkSession, argv: Sequence[str]) -> object:
    """What a command gives; it is printed as JSON."""
    a = parser().parse_args(argv)
    if a.command == "schema":
        return schema(spark)
    if a.command == "analyze":
        return analyze(spark, a.images, a.rosters, a.output, a.size)
    if a.command == "debug":
        return debug(spark, a.images, a.output, a.size)
    if a.command == "dataset-ingest":
        return ingest(spark, a.archive, a.dataset, a.pilot_count)
    if a.command == "dataset-audit":
        return audit(spark, a.dataset, a.seed)
    if a.command == "dataset-baseline":
        return baseline(spark, a.predictions, a.dataset, a.seed, a.split or ["test"], a.max_accepted_error_rate, a.min_automation_rate)
    if a.command == "dataset-review-prepare":
        return review_prepare(spark, a.dataset, a.stage)
    if a.command == "dataset-review-import":
        return review_import(spark, a.export, a.dataset, a.stage, a.audit_only)
    return review_status(spark, a.dataset)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("tallyforge").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:]), ensure_ascii=False, indent=2))
    spark.stop()


if __name__ == "__main__":
    main()
