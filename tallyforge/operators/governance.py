"""Splits, leakage, pilots, audit samples, staleness and merges of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import checked, checked_rectangle, split_bucket, split_name, trainable


def with_split(rows: DataFrame, key: Column, seed: str) -> DataFrame:
    return rows.withColumn("split", split_name(split_bucket(key, seed)))


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys that lie in more than one split, with their splits."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n")).filter("n > 1")


def assert_no_leakage(rows: DataFrame, key: str) -> None:
    bad = leakage(rows, key).orderBy(key).limit(20).collect()
    if bad:
        raise ValueError(f"{key} in several splits: " + ", ".join(str(r[key]) for r in bad))


def unique_rows(rows: DataFrame, key: str, what: str) -> DataFrame:
    """rows as they are, one for each key; a repeated key fails the query and is named."""
    rest = [c for c in rows.columns if c != key]
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    once = checked(F.col("_r"), F.col("_n") > 1, F.concat(F.lit(f"Duplicate {what}: "), F.col(key).cast("string")))
    return g.select(key, once.alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def pilots(catalog: DataFrame, limit: int) -> DataFrame:
    """One usable document a category: ready first, then a JPEG of the first category that has one, then the smallest id."""
    usable = catalog.filter("status <> 'unreadable'").withColumn("jpeg", F.col("extension").isin("jpg", "jpeg", ".jpg", ".jpeg"))
    lead = usable.filter("jpeg").agg(F.min("category").alias("jpeg_category"))
    order = lambda jpeg_first: F.struct((F.col("status") != "ready").alias("a"), (~F.col("jpeg") if jpeg_first else F.lit(False)).alias("b"), "document_id", "status")
    # Each category's best with and without regard to JPEG; the one-row lead says which counts.
    best = usable.groupBy("category").agg(F.min(order(True)).alias("x"), F.min(order(False)).alias("y")).withColumn("one", F.lit(1))
    best = best.join(F.broadcast(lead.withColumn("one", F.lit(1))), "one", "left").withColumn("z", F.when(F.col("category") == F.col("jpeg_category"), F.col("x")).otherwise(F.col("y")))
    return best.select("category", "z.document_id", "z.status").orderBy("category").limit(max(limit, 1))


def audit_sample(crops: DataFrame) -> DataFrame:
    """Of each field type's trainable crops, the tenth (rounded up) with the smallest SHA-1 of their id.

    Counts by the hash's first three digits tell in which of 4,096 bins a type's sample ends: only that bin is ranked.
    """
    t = crops.filter(trainable(F.col("model_trainable"), F.col("review_state"), F.col("label"))).select("field_type", "crop_id", F.sha1(F.col("crop_id").cast("string")).alias("h"))
    t = t.withColumn("bin", F.substring("h", 1, 3))
    up = Window.partitionBy("field_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = t.groupBy("field_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(up)).withColumn("due", F.ceil(F.sum("n").over(Window.partitionBy("field_type")) / 10))
    bins = bins.select("field_type", "bin", (F.col("due") - (F.col("upto") - F.col("n"))).alias("left"), "n").filter(F.col("left") > 0)
    some = t.join(bins, ["field_type", "bin"])
    whole = some.filter(F.col("left") >= F.col("n")).select("field_type", "crop_id")
    ranked = some.filter(F.col("left") < F.col("n")).withColumn("r", F.row_number().over(Window.partitionBy("field_type", "bin").orderBy("h", "crop_id")))
    return whole.unionByName(ranked.filter(F.col("r") <= F.col("left")).select("field_type", "crop_id"))


def audited(crops: DataFrame, field_types: tuple[str, ...]) -> DataFrame:
    """crops(audit_required, audit_state, ...) of these types with their sample drawn anew: a crop still in it keeps passed or corrected, a new one is pending."""
    due = audit_sample(crops.filter(F.col("field_type").isin(*field_types))).select("crop_id", F.lit(True).alias("_due"))
    ours, due_now = F.col("field_type").isin(*field_types), F.col("_due").isNotNull()
    kept = F.coalesce("audit_required", F.lit(False)) & F.col("audit_state").isin("passed", "corrected")
    state = F.when(~ours, F.col("audit_state")).when(due_now, F.when(kept, F.col("audit_state")).otherwise("pending"))
    required = F.when(ours, due_now).otherwise(F.col("audit_required"))
    return crops.join(due, "crop_id", "left").select(*[state.alias(c) if c == "audit_state" else required.alias(c) if c == "audit_required" else F.col(c) for c in crops.columns])


def is_stale(pairs: tuple[tuple[str, str], ...] = (("source_hash", "reviewed_hash"),)) -> Column:
    """Whether, of these pairs of hashes, both of one are known and differ."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | F.coalesce(F.col(a) != F.col(b), F.lit(False))
    return out


def stale(crops: DataFrame, pairs: tuple[tuple[str, str], ...] = (("source_hash", "reviewed_hash"),)) -> DataFrame:
    """Rows of which both hashes of a pair, of the source or of the crop, are known and differ."""
    return crops.filter(is_stale(pairs))


def reviewed_trainable(automatic: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(crop_id) of reviews that may train: usable, labelled, of a crop that may, with both hashes equal to the crop's, missing ones too."""
    a = automatic.select("crop_id", F.col("model_trainable").alias("_may"), F.col("source_image_hash").alias("_s"), F.col("crop_image_hash").alias("_c"))
    good = F.coalesce("_may", F.lit(True)) & F.col("review_state").isin("accepted", "adjusted") & F.col("label").isNotNull()
    same = F.col("source_image_hash").eqNullSafe(F.col("_s")) & F.col("crop_image_hash").eqNullSafe(F.col("_c"))
    return reviewed.join(a, "crop_id").filter(good & same).select("crop_id").distinct()


def crop_summary(automatic: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: crops, those labelled by a rule or a usable review, each alone, and the rest."""
    labelled = automatic.filter("status = 'labeled' and crop_id is not null").select("crop_id").distinct()
    by_review = reviewed_trainable(automatic, reviewed)
    marks = labelled.withColumn("a", F.lit(1)).join(by_review.withColumn("r", F.lit(1)), "crop_id", "full")
    m = marks.agg(F.count(F.lit(1)).alias("labeled"), F.count("a").alias("automatic_labeled"), F.count("r").alias("reviewed_labeled"))
    n = automatic.agg(F.count(F.lit(1)).alias("crops"))
    both = n.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one")
    return both.select("crops", "labeled", "automatic_labeled", "reviewed_labeled", (F.col("crops") - F.col("labeled")).alias("unlabeled"))


def merged_reviews(base: DataFrame, reviewed: DataFrame, key: str = "crop_id") -> DataFrame:
    """All of base; reviewed columns win where there is a reviewed row, others become pending. A reviewed key that repeats fails."""
    r = unique_rows(reviewed, key, "reviewed row").select(F.col(key).alias("_k"), F.struct(*[c for c in reviewed.columns if c != key]).alias("_r"))
    j = base.join(r, F.col(key) == F.col("_k"), "left")
    cols = [F.when(F.col("_k").isNotNull(), F.col(f"_r.{c}")).otherwise(F.lit("pending") if c == "review_state" else F.col(c)).alias(c) if c in reviewed.columns and c != key else F.col(c) for c in base.columns]
    return j.select(*cols)


# The field types of the stages, and the share of usable crops that a stage needs.
STAGES = {"jerseys": ("jersey", "scoring_event"), "fouls": ("foul_symbol", "foul_event", "foul_terminal")}
QUALITY = 0.98


def crop_states(automatic: DataFrame, reviewed: DataFrame, stages: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """automatic's crops of a stage with its name, their state (stale, that of the review, or pending) and what a valid review says."""
    names = F.create_map(*[F.lit(x) for s, kinds in stages.items() for k in kinds for x in (k, s)])
    r = unique_rows(reviewed.filter("crop_id is not null"), "crop_id", "reviewed crop")
    r = r.select("crop_id", F.struct(*[c for c in reviewed.columns if c != "crop_id"]).alias("r"))
    a = automatic.withColumn("stage", F.try_element_at(names, F.col("field_type"))).filter("stage is not null").join(r, "crop_id", "left")
    old = is_stale((("source_image_hash", "r.source_image_hash"), ("crop_image_hash", "r.crop_image_hash")))
    state = F.when(old, "stale").otherwise(F.coalesce(F.nullif(F.col("r.review_state"), F.lit("")), F.lit("pending")))
    valid = F.col("r").isNotNull() & ~old & F.coalesce(trainable(F.col("r.model_trainable"), F.col("r.review_state"), F.col("r.label")), F.lit(False))
    need = valid & F.coalesce("r.audit_required", F.lit(False))
    return a.select("crop_id", "field_type", "stage", state.alias("state"), valid.alias("valid"), need.alias("audit"), (need & F.coalesce(F.col("r.audit_state").isin("passed", "corrected"), F.lit(False))).alias("audit_done"))


def review_progress(automatic: DataFrame, reviewed: DataFrame, stages: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """By stage, also one without crops: candidates, decided, pending, stale, trainable, audits, the share of usable geometry, and whether it is ready to train on."""
    c = crop_states(automatic, reviewed, stages)
    n = lambda cond: F.count_if(cond)
    is_ = lambda *names: F.col("state").isin(*names)
    g = c.groupBy("stage").agg(
        F.count(F.lit(1)).alias("candidates"), n(~is_("pending", "stale")).alias("decided"), n(is_("pending")).alias("pending"), n(is_("stale")).alias("stale"), n(F.col("valid")).alias("trainable"),
        n(F.col("audit")).alias("audit_required"), n(F.col("audit_done")).alias("audit_completed"), n(is_("accepted", "adjusted", "erasure", "illegible")).alias("geometrically_correct"))
    every = automatic.sparkSession.createDataFrame([(s,) for s in stages], "stage string").join(g, "stage", "left").na.fill(0)
    rate = F.when(F.col("decided") > 0, F.col("geometrically_correct") / F.col("decided")).otherwise(F.lit(0.0))
    p = every.withColumn("audit_pending", F.col("audit_required") - F.col("audit_completed")).withColumn("completion", F.when(F.col("candidates") > 0, F.col("decided") / F.col("candidates")).otherwise(F.lit(1.0)))
    p = p.withColumn("geometric_correct_rate", rate).withColumn("geometric_quality_met", (F.col("decided") == F.col("candidates")) & (F.col("stale") == 0) & (rate >= QUALITY))
    return p.withColumn("ready", (F.col("pending") == 0) & (F.col("stale") == 0) & (F.col("trainable") > 0) & (F.col("audit_pending") == 0) & F.col("geometric_quality_met"))


def geometry_progress(pilot_documents: DataFrame, regions: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row: regions expected of the pilots, reviewed, still to review, and unusable. regions: (document_id, region, state)."""
    r = regions.filter(F.col("region").isin(*names)).dropDuplicates(["document_id", "region"])
    j = pilot_documents.select("document_id").distinct().join(r, "document_id", "left")
    g = j.agg(F.count_distinct("document_id").alias("documents"), F.count("region").alias("reviewed_regions"), F.count_if(F.col("state") == "unusable").alias("unusable_regions"))
    g = g.withColumn("expected_regions", F.col("documents") * len(names)).withColumn("pending_regions", F.greatest(F.lit(0).cast("long"), F.col("expected_regions") - F.col("reviewed_regions")))
    return g.withColumn("completion", F.when(F.col("expected_regions") > 0, F.col("reviewed_regions") / F.col("expected_regions")).otherwise(F.lit(1.0)))


def regions_in_use(documents: DataFrame, template: DataFrame, overrides: DataFrame) -> DataFrame:
    """(document_id, region, x, y, width, height): the template's regions, or where one was revised, that; unusable ones are left out.

    template: (region, x, y, width, height); overrides: (document_id, region, state, box), box an array of four shares. A review without a
    whole box changes nothing. The template is a few rows, a constant of the page's form.
    """
    every = documents.select("document_id").distinct().withColumn("one", F.lit(1)).join(F.broadcast(template.withColumn("one", F.lit(1))), "one").drop("one")
    j = every.join(overrides.select("document_id", "region", "state", "box"), ["document_id", "region"], "left").filter(~F.coalesce(F.col("state") == "unusable", F.lit(False)))
    own = F.coalesce(F.size("box") == 4, F.lit(False))
    cols = [F.when(own, F.get("box", k)).otherwise(F.col(c)) for k, c in enumerate(("x", "y", "width", "height"))]
    rect = checked_rectangle(*cols, slack=1e-6)
    return j.select("document_id", "region", rect.alias("r")).select("document_id", "region", "r.*")


def merged_regions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Regions (document_id, region, ...) of both; a new one replaces the old one of its name, others stay."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in ("document_id", "region")]
    return both.groupBy("document_id", "region").agg(F.max_by(F.struct(*rest), "_new").alias("r")).select("document_id", "region", *[F.col(f"r.{c}").alias(c) for c in rest])


def state_counts(crops: DataFrame) -> DataFrame:
    return crops.groupBy("field_type", F.coalesce("review_state", F.lit("pending")).alias("review_state")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(rows: DataFrame, order: str) -> DataFrame:
    """SHA-256 over the rows as one JSON array in order, keys sorted, nulls written; one row.

    Such a hash is made byte after byte, so the sorted rows stream through one task, which holds a batch of them at a time.
    """
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, first = hashlib.sha256(b"["), True
        for batch in batches:
            for j in batch.column(0).to_pylist():
                h.update(j.encode() if first else b"," + j.encode())
                first = False
        h.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["fingerprint"])

    j = rows.select(F.col(order).alias("_o"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("j"))
    # Every partition but the one that holds all rows yields nothing.
    return j.repartition(1).sortWithinPartitions("_o", "j").select("j").mapInArrow(run, "fingerprint string")


def ingest_summary(catalog: DataFrame, pilot_documents: DataFrame | None = None) -> DataFrame:
    """By status, how many and of which categories; with the pilots also their ids, in order, beside each."""
    out = catalog.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    if pilot_documents is None:
        return out
    ids = pilot_documents.groupBy("status").agg(F.transform(F.array_sort(F.collect_list(F.struct("category", "document_id"))), lambda x: x["document_id"]).alias("pilots"))
    return out.join(ids, "status", "left").withColumn("pilots", F.coalesce("pilots", F.array().cast(ids.schema["pilots"].dataType)))


def assert_covered(eligible: DataFrame, predictions: DataFrame, key: str = "document_id") -> None:
    """An error if a prediction is of a document that is not eligible, or an eligible one has none; twenty are named."""
    for a, b, message in ((predictions, eligible, "Predictions reference documents outside the reviewed set: "), (eligible, predictions, "Predictions do not cover every reviewed document: ")):
        bad = uncovered(a, b, key).orderBy(key).limit(20).collect()
        if bad:
            raise ValueError(message + ", ".join(str(r[key]) for r in bad))


def checked_predictions(rows: DataFrame) -> DataFrame:
    """Prediction rows with defaults for what is absent; no expected text, confidence, field id or type, or a repeated (document_id, field_id), fails."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    need = checked(F.col("expected"), F.col("expected").isNull() | F.col("confidence").isNull(), "Predictions require string expected and numeric confidence")
    need = checked(need, blank("field_id"), "Predictions require a non-empty field_id")
    need = checked(need, blank("field_type"), "Predictions require a non-empty field_type")
    p = rows.withColumn("expected", need).withColumn("writer_known", F.coalesce("writer_known", F.lit(False))).withColumn("writer_seen", F.coalesce("writer_seen", F.lit(False)))
    p = p.withColumn("capture", checked(F.coalesce("capture", F.lit("unspecified")), F.trim("capture") == "", "capture_condition must be a non-empty string"))
    one = unique_rows(p.withColumn("_key", F.concat_ws(":", "document_id", "field_id")), "_key", "prediction field_id")
    return one.drop("_key")


def writers(manifest: DataFrame, split: str | None = None) -> DataFrame:
    """(writer_id): the distinct known writers, of all rows or of one split."""
    m = manifest if split is None else manifest.filter(F.col("split") == split)
    return m.filter("writer_id is not null and writer_id <> ''").select("writer_id").distinct()


def with_writer_exposure(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds writer_known, and writer_seen: whether the writer is one of the training split."""
    seen = writers(manifest, "train").withColumn("_seen", F.lit(True))
    return rows.join(seen, "writer_id", "left").withColumn("writer_known", F.col("writer_id").isNotNull()).withColumn("writer_seen", F.coalesce("_seen", F.lit(False))).drop("_seen")


def uncovered(eligible: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return eligible.select(key).distinct().join(covered.select(key).distinct(), key, "left_anti")
