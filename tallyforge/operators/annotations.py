"""Reviews made in an annotation tool: exports to tables, decisions on crops and regions, audits, and the tasks that are given out.

An export is JSON: a list of tasks, each with data, annotations and their results. Whatever contradicts the catalogue, the manifest
or itself fails the import and is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FOUL_LABELS, box_from_percent, box_to_percent, box_to_pixels, checked, checked_pixel_box, final_label, media_url, position_text, result_id
from . import governance as gv
from .ordered import latest_annotation

# What may be decided of a crop, which of it may train, the states of a region, and the fields of the stages.
DECISIONS = ("accepted", "adjusted", "rejected_empty", "rejected_grid", "rejected_wrong_crop", "erasure", "illegible")
USABLE = ("accepted", "adjusted")
STAGE_FIELDS = {"scoring": ("scoring_event", "jersey"), "jerseys": ("scoring_event", "jersey"), "fouls": ("foul_event", "foul_terminal", "foul_symbol")}

_VALUE = "struct<x:double,y:double,width:double,height:double,rotation:double,rectanglelabels:array<string>,choices:array<string>,text:array<string>>"
_RESULT = f"struct<id:string,type:string,from_name:string,to_name:string,value:{_VALUE}>"
_DATA = "struct<image:string,crop_id:string,document_id:string,source_image_hash:string,crop_image_hash:string,image_width:int,image_height:int>"
TASK = f"struct<data:{_DATA},file_upload:string,annotations:array<struct<was_cancelled:boolean,result:array<{_RESULT}>>>>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row a task (data, file_upload, annotations) of export files, a file a row until it is taken apart; one that is no list, or a task without data, fails."""
    v = F.try_parse_json("value")
    text = spark.read.text(path, wholetext=True)
    tasks = checked(v, ~F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)), "The export must be a task list")
    each = text.select(F.explode(F.variant_get(tasks, "$", f"array<{TASK}>")).alias("t")).select("t.*")
    return each.withColumn("data", checked(F.col("data"), F.col("data").isNull(), "A task is missing its data object"))


def _results(kind: str, name: str) -> Column:
    return F.filter("results", lambda r: (r["type"] == kind) & (r["from_name"] == name))


def _latest(tasks: DataFrame) -> DataFrame:
    """Tasks with the results of the last annotation that was not cancelled; null where there is none."""
    t = latest_annotation(tasks)
    return t.withColumn("results", F.when(F.col("latest").isNotNull(), F.coalesce("latest.result", F.array().cast(f"array<{_RESULT}>")))).drop("latest")


def crop_answers(tasks: DataFrame) -> DataFrame:
    """(crop_id, data, box, decision, label) of tasks; decision is null where none was made. Not exactly one box, several decisions or labels on it, or an unknown decision fail."""
    t = _latest(tasks).withColumn("crop_id", F.coalesce("data.crop_id", F.lit("")))
    named = lambda what: F.concat(F.lit(what), F.col("crop_id"))
    t = t.withColumn("boxes", _results("rectanglelabels", "bbox"))
    t = t.withColumn("b", checked(F.try_element_at("boxes", F.lit(1)), F.col("results").isNotNull() & (F.size("boxes") != 1), named("Exactly one bounding box is needed in crop ")))
    mine = lambda r: F.coalesce(r["id"], F.lit("")) == F.coalesce(F.col("b.id"), F.lit(""))
    t = t.withColumn("choices", F.filter(_results("choices", "decision"), mine)).withColumn("texts", F.filter(_results("textarea", "final_label"), mine))
    chosen = F.flatten(F.transform("choices", lambda c: F.coalesce(c["value"]["choices"], F.array().cast("array<string>"))))
    t = t.withColumn("chosen", checked(chosen, (F.size("choices") > 1) | (F.size(chosen) > 1), named("More than one decision for crop ")))
    decision = F.try_element_at("chosen", F.lit(1))
    decision = checked(decision, decision.isNotNull() & ~decision.isin(*DECISIONS), named("Invalid decision for crop "))
    label = F.nullif(F.trim(F.get(F.get("texts", 0)["value"]["text"], 0)), F.lit(""))
    label = checked(label, F.size("texts") > 1, named("More than one final label for crop "))
    v = F.col("b.value")
    box = F.when(F.col("results").isNotNull(), box_from_percent(v["x"], v["y"], v["width"], v["height"]))
    return t.select("crop_id", "data", box.alias("box"), F.when(F.col("results").isNotNull(), decision).alias("decision"), F.when(F.col("results").isNotNull(), label).alias("label"))


def _placed(tasks: DataFrame, manifest: DataFrame, catalog: DataFrame, stage: str) -> DataFrame:
    """Answers beside their manifest rows m; unknown or repeated crops, another stage's, and other versions of sheet or crop fail."""
    a = gv.unique_rows(crop_answers(tasks), "crop_id", "crop_id in export")
    m = gv.unique_rows(manifest, "crop_id", "crop_id in manifest")
    m = m.select(F.col("crop_id").alias("_id"), F.struct(*[c for c in m.columns if c != "crop_id"]).alias("m"))
    sheets = catalog.select(F.col("document_id").alias("_doc"), F.col("sha256").alias("sheet"))
    j = a.join(m, F.col("crop_id") == F.col("_id"), "left").join(sheets, F.col("m.document_id") == F.col("_doc"), "left")
    named = lambda what: F.concat(F.lit(what), F.col("crop_id"))
    same = F.coalesce("data.source_image_hash", F.lit("")) == F.col("sheet")
    # The check put on last is made first.
    row = checked(F.col("m"), F.coalesce("data.crop_image_hash", F.lit("")) != F.coalesce("m.crop_image_hash", F.lit("")), named("A different crop version of crop "))
    row = checked(row, ~F.coalesce(same & (F.coalesce("m.source_image_hash", "sheet") == F.col("sheet")), F.lit(False)), named("Scoresheet version mismatch for crop "))
    row = checked(row, ~F.col("m.field_type").isin(*STAGE_FIELDS[stage]), named(f"Not of stage {stage}: crop "))
    row = checked(row, F.col("_id").isNull(), named("Unknown crop_id in export: "))
    return j.withColumn("m", row).withColumn("size_ok", (F.col("data.image_width") > 0) & (F.col("data.image_height") > 0)).drop("_id", "_doc")


def _boxes(j: DataFrame, first: Column) -> DataFrame:
    """Adds the earlier box, the whole crop where there was none, and the revised one, both in pixels."""
    w, h = F.col("data.image_width"), F.col("data.image_height")
    w = checked(w, ~F.coalesce(F.col("size_ok"), F.lit(False)), F.concat(F.lit("Invalid dimensions for crop "), F.col("crop_id")))
    whole = F.array(F.lit(0), F.lit(0), w, h)
    return j.withColumn("old_box", checked_pixel_box(F.coalesce(first, whole), w, h)).withColumn("new_box", box_to_pixels(F.col("box"), w, h))


def imported_crops(tasks: DataFrame, manifest: DataFrame, catalog: DataFrame, stage: str) -> DataFrame:
    """(crop_id, bbox_original, bbox_revised, label_original, label_final, review_state, status) of the tasks that were decided.

    An accepted crop whose box or label was changed is adjusted. A crop that may not train keeps its predicted label. manifest: crop_id,
    document_id, field_type, label, predicted_label, model_trainable, bbox_original and both hashes; catalog: document_id, sha256.
    """
    j = _boxes(_placed(tasks, manifest, catalog, stage).filter("decision is not null"), F.col("m.bbox_original"))
    fit, keeps = F.col("decision").isin(*USABLE), F.coalesce(~F.col("m.model_trainable"), F.lit(False))
    final = F.when(fit, F.when(keeps, F.coalesce("m.predicted_label", "label", F.lit(""))).otherwise(final_label(F.col("m.field_type"), F.col("label"))))
    j = j.withColumn("final", final)
    changed = (F.col("old_box") != F.col("new_box")) | ~F.col("m.label").eqNullSafe(F.col("final"))
    state = F.when((F.col("decision") == "accepted") & changed, "adjusted").otherwise(F.col("decision"))
    return j.select(
        "crop_id", F.col("old_box").alias("bbox_original"), F.col("new_box").alias("bbox_revised"), F.col("m.label").alias("label_original"), F.col("final").alias("label_final"), state.alias("review_state"),
        F.when(fit, "labeled").otherwise("excluded").alias("status"))


def reviewed_manifest(manifest: DataFrame, decided: DataFrame, earlier: DataFrame | None, stage: str) -> DataFrame:
    """All crops of the manifest with their reviews: decided ones, else the earlier ones, else pending; the stage's audit sample is drawn anew.

    Columns: those of imported_crops, document_id, field_type, model_trainable, both hashes, label, audit_required, audit_state. Reviews of crops that are
    no longer in the manifest go.
    """
    keep = ("document_id", "field_type", "model_trainable", "source_image_hash", "crop_image_hash")
    own = ("bbox_original", "bbox_revised", "label_original", "label_final", "review_state", "status", "audit_required", "audit_state")
    new = decided.select("crop_id", F.struct(*own[:6], F.lit(False).alias("audit_required"), F.lit(None).cast("string").alias("audit_state")).alias("new"))
    j = manifest.join(new, "crop_id", "left")
    was = F.col("new")
    if earlier is not None:
        j = j.join(earlier.select("crop_id", F.struct(*own).alias("old")), "crop_id", "left")
        was = F.coalesce("new", "old")
    none = F.struct(F.col("bbox_original"), F.lit(None).cast("array<int>").alias("bbox_revised"), F.col("label").alias("label_original"), F.lit(None).cast("string").alias("label_final"), F.lit("pending").alias("review_state"), F.col("status"), F.lit(False).alias("audit_required"), F.lit(None).cast("string").alias("audit_state"))
    r = j.select("crop_id", *keep, F.col("label").alias("_auto"), F.coalesce(was, none).alias("r"))
    label = F.when(F.col("r.review_state") == "pending", F.col("_auto")).otherwise(F.col("r.label_final"))
    return gv.audited(r.select("crop_id", *keep, "r.*", label.alias("label")), STAGE_FIELDS[stage])


def audited_crops(tasks: DataFrame, reviewed: DataFrame, catalog: DataFrame, stage: str) -> DataFrame:
    """reviewed with the second look of the sample: a decision that changes box or label, or refuses the crop, is a correction. A crop outside the sample fails."""
    j = _placed(tasks, reviewed, catalog, stage)
    j = j.withColumn("m", checked(F.col("m"), ~F.coalesce("m.audit_required", F.lit(False)), F.concat(F.lit("Not in the audit sample: crop "), F.col("crop_id")))).filter("decision is not null")
    j = _boxes(j, F.coalesce("m.bbox_revised", "m.bbox_original"))
    fit = F.col("decision").isin(*USABLE)
    j = j.withColumn("final", F.when(fit, final_label(F.col("m.field_type"), F.col("label"))))
    changed = (F.col("old_box") != F.col("new_box")) | ~F.col("m.label").eqNullSafe(F.col("final")) | ~fit
    state = F.when((F.col("decision") == "accepted") & changed, "adjusted").otherwise(F.col("decision"))
    done = j.select("crop_id", F.struct(
        F.col("new_box").alias("bbox_revised"), F.col("final").alias("label_final"), F.col("final").alias("label"), state.alias("review_state"), F.when(fit, "labeled").otherwise("excluded").alias("status"),
        F.when(changed, "corrected").otherwise("passed").alias("audit_state")).alias("d"))
    names = ("bbox_revised", "label_final", "label", "review_state", "status", "audit_state")
    k = reviewed.join(done, "crop_id", "left")
    return k.select(*[F.when(F.col("d").isNotNull(), F.col(f"d.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in reviewed.columns])


def resolved_documents(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tasks with document_id: the written one, which the catalogue must know in that version, or the pilot whose id ends the uploaded file's name, which must be one."""
    t = tasks.withColumn("_row", F.monotonically_increasing_id()).withColumn("written", F.nullif(F.col("data.document_id"), F.lit("")))
    t = t.withColumn("upload", F.regexp_extract(F.coalesce("file_upload", F.lit("")), r"([^/]*)$", 1))
    known = catalog.select(F.col("document_id").alias("known"), "sha256")
    w = t.filter("written is not null").join(known, F.col("written") == F.col("known"), "left")
    w = w.withColumn("document_id", checked(F.col("known"), F.col("known").isNull(), F.concat(F.lit("Unknown document in export: "), F.col("written"))))
    w = w.withColumn("document_id", checked(F.col("document_id"), F.coalesce("data.source_image_hash", F.lit("")) != F.col("sha256"), F.concat(F.lit("Scoresheet version mismatch for "), F.col("written"))))
    # Every end of the name after a dash is a key, so that the names meet ids in an equi-join.
    parts = F.split(F.regexp_replace("upload", r"\.png$", ""), "-")
    ends = F.when(F.col("upload").endswith(".png"), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "-")))
    u = t.filter("written is null").withColumn("end", F.explode_outer(ends)).join(catalog.filter("selected_pilot").select(F.col("document_id").alias("known")), F.col("end") == F.col("known"), "left")
    g = u.groupBy("_row").agg(F.first(F.struct("data", "file_upload", "annotations", "upload")).alias("t"), F.count_distinct("known").alias("n"), F.max("known").alias("known"))
    g = g.select("t.*", checked(F.col("known"), F.col("n") != 1, F.concat(F.lit("No unique document for upload: "), F.col("t.upload"))).alias("document_id"))
    cols = ("document_id", "data", "file_upload", "annotations")
    return w.select(*cols).unionByName(g.select(*cols))


def imported_regions(tasks: DataFrame, catalog: DataFrame, template: DataFrame) -> DataFrame:
    """(document_id, region, state, bbox_original, box, source_image_hash) of reviewed geometry. template: (region, x, y, width, height).

    A repeated document or region, a box without exactly one known name, and an unknown or repeated state fail. A box without a state is usable.
    """
    t = _latest(gv.unique_rows(resolved_documents(tasks, catalog), "document_id", "document in export")).filter("results is not null")
    named = lambda what: F.concat(F.lit(what), F.col("document_id"))
    t = t.withColumn("states", _results("choices", "geometry_state"))
    ids = F.transform("states", lambda c: F.coalesce(c["id"], F.lit("")))
    t = t.withColumn("states", checked(F.col("states"), F.size(F.array_distinct(ids)) < F.size(ids), named("A region with several states in ")))
    r = t.select("document_id", "states", F.explode(_results("rectanglelabels", "region")).alias("b"))
    labels = F.coalesce("b.value.rectanglelabels", F.array().cast("array<string>"))
    r = r.withColumn("region", checked(F.try_element_at(labels, F.lit(1)), F.size(labels) != 1, named("A region without a unique label in ")))
    own = F.filter("states", lambda c: F.coalesce(c["id"], F.lit("")) == F.coalesce(F.col("b.id"), F.lit("")))
    chosen = F.coalesce(F.get(own, 0)["value"]["choices"], F.array(F.lit("usable")))
    r = r.withColumn("state", checked(F.try_element_at(chosen, F.lit(1)), (F.size(chosen) != 1) | ~F.coalesce(F.try_element_at(chosen, F.lit(1)).isin("usable", "unusable"), F.lit(False)), named("Invalid geometry state in ")))
    v = F.col("b.value")
    box = box_from_percent(v["x"], v["y"], v["width"], v["height"])
    r = r.withColumn("key", F.concat_ws("/", "document_id", "region")).withColumn("box", F.array(box["x"], box["y"], box["width"], box["height"]))
    r = gv.unique_rows(r.select("key", "document_id", "region", "state", "box"), "key", "region").drop("key")
    # The template is a few rows, a constant of the page's form.
    r = r.join(F.broadcast(template.select("region", F.array("x", "y", "width", "height").alias("bbox_original"))), "region", "left")
    r = r.withColumn("bbox_original", checked(F.col("bbox_original"), F.col("bbox_original").isNull(), F.concat(F.lit("Unknown region: "), F.col("region"))))
    return r.join(catalog.select("document_id", F.col("sha256").alias("source_image_hash")), "document_id").select("document_id", "region", "state", "bbox_original", "box", "source_image_hash")


def _rectangle(id_: Column, name: str, label: Column, percent: Column, width: Column, height: Column) -> Column:
    value = F.struct(percent["x"].alias("x"), percent["y"].alias("y"), percent["width"].alias("width"), percent["height"].alias("height"), F.lit(0.0).alias("rotation"), F.array(label).alias("rectanglelabels"))
    return F.struct(id_.alias("id"), F.lit("rectanglelabels").alias("type"), F.lit(name).alias("from_name"), F.lit("image").alias("to_name"), width.alias("original_width"), height.alias("original_height"), F.lit(0).alias("image_rotation"), value.alias("value"))


def crop_tasks(crops: DataFrame, stage: str) -> DataFrame:
    """(crop_id, task): one JSON task for each crop of the stage that was not decided yet, with its box as a prediction.

    crops: crop_id, document_id, field_type, side, running_score, row, slot, period, predicted_type, predicted_label, label, media, image_width, image_height, bbox_original,
    source_image_hash, crop_image_hash, review_state.
    """
    c = crops.filter(F.col("field_type").isin(*STAGE_FIELDS[stage])).filter("coalesce(review_state, 'pending') = 'pending'")
    w, h = F.col("image_width"), F.col("image_height")
    box = F.coalesce("bbox_original", F.array(F.lit(0), F.lit(0), w, h))
    rect = _rectangle(result_id(F.col("crop_id"), F.lit("bbox")), "bbox", F.lit("candidate"), box_to_percent(box, w, h), w, h)
    position = position_text(F.col("field_type"), F.col("side"), F.col("running_score"), F.col("row"), F.col("slot"))
    data = F.struct(
        media_url(F.col("media")).alias("image"), "crop_id", "document_id", "field_type", position.alias("position"), "period", "predicted_type", "predicted_label", "label", "source_image_hash", "crop_image_hash", "image_width", "image_height")
    task = F.struct(data.alias("data"), F.array(F.struct(F.lit("automatic").alias("model_version"), F.lit(1.0).alias("score"), F.array(rect).alias("result"))).alias("predictions"))
    return c.select("crop_id", F.to_json(task, {"ignoreNullFields": "false"}).alias("task"))


def labelling_config(regions: tuple[str, ...] = (), vocabulary: str = "0-99") -> str:
    """The review form as XML: boxes of these regions with their state, or without regions a crop's box, decision and label."""
    choices = lambda name, values: f'  <Choices name="{name}" toName="image" perRegion="true" choice="single" showInline="true">\n' + "".join(f'    <Choice value="{v}" />\n' for v in values) + "  </Choices>\n"
    box = lambda name, labels: f'  <RectangleLabels name="{name}" toName="image">\n' + "".join(f'    <Label value="{v}" />\n' for v in labels) + "  </RectangleLabels>\n"
    image = '  <Image name="image" value="$image" />\n'
    if regions:
        return "<View>\n" + image + box("region", regions) + choices("geometry_state", ("usable", "unusable")) + "</View>"
    text = '  <TextArea name="final_label" toName="image" perRegion="true" editable="true" rows="1" />\n'
    head = '  <Header value="Crop: $crop_id | Document: $document_id | Position: $position | Period: $period | Predicted: $predicted_type $predicted_label" />\n'
    return "<View>\n" + head + image + box("bbox", ("candidate",)) + choices("decision", DECISIONS) + text + f'  <Header value="Allowed labels: {vocabulary}" />\n</View>'
