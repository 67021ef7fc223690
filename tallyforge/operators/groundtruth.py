"""Audit of hand-made ground truth: what is missing or contradicts itself in each document, and what the corpus lacks.

Documents are JSON of any shape, so they are read as variants and every value's type is looked at before it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import anonymous_writer, checked, review_status, split_bucket, split_name
from . import governance as gv

SIDES = ("A", "B")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
REVIEWED = ("reviewed", "verified")
SPLITS = ("train", "validation", "test")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text, ground_truth_sha256) of *.json files, named by their stems; a file is one row."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("document_id"), F.col("value").alias("text"), F.sha2("value", 256).alias("ground_truth_sha256"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path)), F.lit("MISSING"))


def _object(v: Column, path: str) -> Column:
    return _type(v, path).startswith("OBJECT")


def _list(v: Column, path: str) -> Column:
    return _type(v, path).startswith("ARRAY")


def _whole(v: Column, path: str) -> Column:
    """A whole number; true and false count as such."""
    return _type(v, path).rlike(r"^(BIGINT|BOOLEAN|DECIMAL\\([0-9]+,0\\))$")


def _text(v: Column, path: str) -> Column:
    """The value if it is a text, else null."""
    return F.when(_type(v, path) == "STRING", _get(v, path, "string"))


def _empty_list(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _items(v: Column, path: str) -> Column:
    return F.when(_list(v, path), _get(v, path, "array<variant>")).otherwise(_empty_list("variant"))


def warnings_of(v: Column) -> Column:
    """The warnings that are texts."""
    return F.transform(F.filter(_items(v, "$.warnings"), lambda w: F.schema_of_variant(w) == "STRING"), lambda w: F.try_variant_get(w, "$", "string"))


def status_of_review(v: Column) -> Column:
    return review_status(_text(v, "$.review.status"), warnings_of(v))


def observation_states(v: Column, side: str) -> Column:
    """States of a side's foul observations that are objects: pending where none is written."""
    path = f"$.teams.{side}.individual_foul_observations"
    lists = F.when(_object(v, path), F.map_values(_get(v, path, "map<string,variant>"))).otherwise(_empty_list("variant"))
    entries = F.flatten(F.transform(lists, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(_empty_list("variant"))))
    state = lambda e: F.when(_type(e, "$.review_state") == "MISSING", "pending").otherwise(F.coalesce(F.try_variant_get(e, "$.review_state", "string"), F.lit("None")))
    return F.transform(F.filter(entries, lambda e: F.schema_of_variant(e).startswith("OBJECT")), state)


def _scored(scoring: Column, side: str, quarter: str) -> Column:
    """The sum of whole points of a side's events in a quarter."""
    own = F.filter(scoring, lambda e: F.coalesce((_text(e, "$.team") == side) & (_text(e, "$.period") == quarter) & _whole(e, "$.points"), F.lit(False)))
    return F.aggregate(own, F.lit(0).cast("long"), lambda acc, e: acc + F.try_variant_get(e, "$.points", "long"))


def issues(v: Column, document_id: Column, source_path: Column) -> Column:
    """Codes of what is wrong with one document, in the order of the checks."""
    when = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    status, words = status_of_review(v), warnings_of(v)
    told = status.isin(*REVIEWED)
    some = lambda path: F.length(F.trim(_text(v, path))) > 0
    no = lambda c: ~F.coalesce(c, F.lit(False))
    out = [
        when(~_text(v, "$.game_id").eqNullSafe(document_id), "game_id_mismatch"), when(~_text(v, "$.source_file").eqNullSafe(source_path), "source_file_mismatch"),
        when(told & ~_object(v, "$.review"), "review_metadata_missing"), when(told & _object(v, "$.review") & no(some("$.review.reviewed_at")), "reviewed_at_missing"),
        when(told & _object(v, "$.review") & no(some("$.review.method")), "review_method_missing"), when(F.exists(words, lambda w: F.lower(w).contains("pendente")), "pending_review_warning_present"),
    ]
    teams = _object(v, "$.teams")
    out.append(when(~teams, "teams_missing"))
    rest: list[Column] = []
    quarters = lambda path: [_whole(v, f"{path}.{q}") for q in QUARTERS]
    every = lambda conds: F.array_min(F.array(*[c.cast("int") for c in conds])) == 1
    for s in SIDES:
        t = f"$.teams.{s}"
        has, seen = _object(v, t), f"{t}.individual_foul_observations"
        odd = (_type(v, seen) != "MISSING") & ~_object(v, seen)
        rest += [
            when(~has, f"team_{s}_missing"), when(has & (F.size(_items(v, f"{t}.roster")) == 0), f"team_{s}_roster_missing"), when(has & ~(_object(v, f"{t}.team_fouls") & every(quarters(f"{t}.team_fouls"))), f"team_{s}_team_fouls_incomplete"),
            when(has & no((_type(v, f"{t}.individual_fouls_reviewed") == "BOOLEAN") & _get(v, f"{t}.individual_fouls_reviewed", "boolean")), f"team_{s}_individual_fouls_unreviewed"),
            when(has & odd, f"team_{s}_individual_foul_observations_invalid"), when(has & F.array_contains(observation_states(v, s), "pending"), f"team_{s}_individual_foul_observations_pending"),
        ]
    for s in SIDES:
        rest.append(when(~(_object(v, f"$.period_scores.{s}") & every(quarters(f"$.period_scores.{s}"))), f"team_{s}_period_scores_incomplete"))
    number = lambda path: F.when(_whole(v, path), _get(v, path, "long"))
    finals = {s: number(f"$.final_score.{s}") for s in SIDES}
    rest.append(when(finals["A"].isNull() | finals["B"].isNull(), "final_score_incomplete"))
    scoring = _items(v, "$.scoring")
    rest.append(when(~_list(v, "$.scoring"), "scoring_missing"))
    rest.append(when((F.size(scoring) == 0) & (F.greatest(F.coalesce(finals["A"], F.lit(0)), F.coalesce(finals["B"], F.lit(0))) > 0), "scoring_empty"))
    by = {(s, q): number(f"$.period_scores.{s}.{q}") for s in SIDES for q in QUARTERS}
    for s in SIDES:
        # A sum with a missing part is null, and then nothing is said.
        rest.append(when(by[s, "Q1"] + by[s, "Q2"] + by[s, "Q3"] + by[s, "Q4"] != finals[s], f"team_{s}_period_total_mismatch"))
    for s in SIDES:
        for q in QUARTERS:
            rest.append(when((F.size(scoring) > 0) & (_scored(scoring, s, q) != by[s, q]), f"team_{s}_{q}_scoring_mismatch"))
    split = _type(v, "$.evaluation_split")
    bad_split = when(~split.isin("MISSING", "VOID") & no(_text(v, "$.evaluation_split").isin(*SPLITS)), "evaluation_split_invalid")
    return F.array_compact(F.array(*out, *[F.when(teams, c) for c in rest], bad_split))


def matched(ground_truth: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground truth with its catalogue row, the last by `ord` of repeated ids; ids of ground truth that no row has; ids that repeat.

    A catalogue row without an id fails.
    """
    known = catalog.withColumn("document_id", checked(F.col("document_id"), F.coalesce(F.col("document_id") == "", F.lit(True)), "Every catalog record must have a document_id"))
    g = known.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("source_path", "sha256"), "ord").alias("c"))
    both = ground_truth.join(g.select("document_id", "c.source_path", F.col("c.sha256").alias("source_sha256")), "document_id")
    return both, ground_truth.select("document_id").join(g, "document_id", "left_anti"), g.filter("n > 1").select("document_id")


def audit_rows(rows: DataFrame, seed: str) -> DataFrame:
    """One row a document of rows(document_id, text, ground_truth_sha256, source_path, source_sha256): its split, writer, review, issues.

    A text that is no JSON object fails. The split is the written one, or follows from the writer, or the document.
    """
    v = F.try_parse_json("text")
    r = rows.withColumn("v", checked(v, ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.concat(F.lit("Ground truth must be a JSON object: "), F.col("document_id"))))
    v = F.col("v")
    r = r.withColumn("issues", issues(v, F.col("document_id"), F.col("source_path"))).withColumn("writer_id", anonymous_writer(_text(v, "$.writer_name")))
    written = F.when(_text(v, "$.evaluation_split").isin(*SPLITS), _text(v, "$.evaluation_split"))
    key = F.coalesce(F.concat(F.lit("writer:"), F.col("writer_id")), F.col("document_id"))
    states = F.array_sort(F.concat(*[F.when(_object(v, f"$.teams.{s}"), observation_states(v, s)).otherwise(_empty_list("string")) for s in SIDES]))
    counts = F.map_from_entries(F.transform(F.array_distinct(states), lambda x: F.struct(x, F.size(F.filter(states, lambda y: y == x)))))
    return r.select(
        "document_id", "source_sha256", "ground_truth_sha256", "writer_id", F.coalesce(written, split_name(split_bucket(key, seed))).alias("split"), F.when(written.isNotNull(), "explicit").otherwise("derived").alias("split_source"),
        status_of_review(v).alias("review_status"), counts.alias("individual_foul_observation_counts"), (F.size("issues") == 0).alias("ground_truth_complete"), "issues",
    )


def isolation_errors(rows: DataFrame) -> DataFrame:
    """(kind, id, splits) of documents and writers that lie in more than one split."""
    one = gv.leakage(rows, "document_id").select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), "splits")
    return one.unionByName(gv.leakage(rows, "writer_id").select(F.lit("writer").alias("kind"), F.col("writer_id").alias("id"), "splits"))


def audit_report(rows: DataFrame, catalog: DataFrame, orphans: DataFrame, duplicates: DataFrame, corpus: str, baseline: str | None = None) -> DataFrame:
    """One row: counts, ids that are wrong, four criteria, and ready if all hold. corpus: the fingerprint of rows; baseline: that of the last metrics."""
    good = F.col("review_status").isin(*REVIEWED) & F.col("ground_truth_complete")
    n = rows.agg(
        F.count(F.lit(1)).alias("ground_truth_documents"), F.count_if(good).alias("reviewed_ground_truth_documents"), F.count_distinct("writer_id").alias("known_writers"),
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    by = rows.groupBy("review_status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_status", "n")))).alias("review_status_counts"))
    ids = lambda d, name: d.agg(F.array_sort(F.collect_set("document_id")).alias(name))
    parts = [n, by, catalog.agg(F.count(F.lit(1)).alias("catalog_documents")), ids(duplicates, "duplicate_documents"), ids(orphans, "orphan_ground_truth"), isolation_errors(rows).agg(F.count(F.lit(1)).alias("leaks"))]
    one = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        one = one.join(p.withColumn("one", F.lit(1)), "one")
    some = F.col("ground_truth_documents") > 0
    criteria = F.struct(
        (some & (F.col("reviewed_ground_truth_documents") == F.col("ground_truth_documents"))).alias("reviewed_ground_truth"), (some & (F.size("duplicate_documents") == 0)).alias("corpus_identified"),
        (F.col("leaks") == 0).alias("document_and_writer_isolation"), F.lit(baseline is not None and baseline == corpus).alias("baseline_metrics_reproducible"))
    one = one.withColumn("corpus_sha256", F.lit(corpus)).withColumn("split_counts", F.struct(*SPLITS)).withColumn("exit_criteria", criteria)
    ready = F.col("exit_criteria.reviewed_ground_truth") & F.col("exit_criteria.corpus_identified") & F.col("exit_criteria.document_and_writer_isolation") & F.col("exit_criteria.baseline_metrics_reproducible")
    return one.withColumn("status", F.when(ready, "ready").otherwise("in_progress")).drop("one", "leaks", *SPLITS)


def audit(ground_truth: DataFrame, catalog: DataFrame, seed: str, baseline: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, report): audit_rows of the catalogued documents, and the report over them."""
    both, orphans, duplicates = matched(ground_truth, catalog)
    rows = audit_rows(both, seed)
    corpus = gv.fingerprint(rows, "document_id").first().fingerprint
    return rows, audit_report(rows, catalog, orphans, duplicates, corpus, baseline)
