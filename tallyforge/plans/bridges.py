"""The driver's tables seen as game-sheet observations; SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRIDGES = {
    "scoring_events": """
WITH e AS (SELECT user_id AS document_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, event_id, ts,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS points,
  CASE event_type WHEN 'click' THEN 'free_throw' WHEN 'purchase' THEN 'three_point' WHEN 'error' THEN 'ambiguous' ELSE 'two_point' END AS shot_type,
  CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 99 ELSE 4 + event_id % 12 END AS jersey,
  CASE WHEN event_id % 29 = 0 THEN 'unknown' WHEN day(ts) BETWEEN 1 AND 7 OR day(ts) BETWEEN 15 AND 21 THEN 'red' ELSE 'blue' END AS ink_color
  FROM {events}),
r AS (SELECT *, CAST(SUM(points) OVER (PARTITION BY document_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
  + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS running_score FROM e)
SELECT document_id, side, event_id, CAST(points AS BIGINT) AS points, shot_type, CAST(jersey AS BIGINT) AS jersey, ink_color, CAST(running_score AS BIGINT) AS running_score,
  CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, 'accepted' AS status,
  CAST(ROW_NUMBER() OVER (PARTITION BY document_id, side ORDER BY running_score, event_id) AS BIGINT) AS seq FROM r""",
    "players": """
SELECT d.document_id, s.side, CAST(4 + r.r AS BIGINT) AS jersey, CAST(1 + r.r AS BIGINT) AS row_no, (d.document_id + r.r * r.r) % 7 <> 0 AS participated,
  (r.r < 5 AND (d.document_id + r.r * r.r) % 7 <> 0) AS starter
FROM (SELECT DISTINCT user_id AS document_id FROM {events}) d CROSS JOIN (SELECT 'A' AS side UNION ALL SELECT 'B' AS side) s
CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) r""",
    "foul_cells": """
WITH e AS (SELECT user_id AS document_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, 4 + CAST(FLOOR(event_id / 10) AS BIGINT) % 12 AS jersey,
  1 + event_id % 5 AS slot, CAST(FLOOR(event_id / 5) AS BIGINT) % 18 AS k, event_id, user_id % 6 AS first_half_slots,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'red' ELSE 'blue' END AS ink_color FROM {events}),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, side, jersey, slot ORDER BY event_id) AS rn FROM e)
SELECT document_id, side, jersey, slot, first_half_slots, ink_color,
  CASE k WHEN 0 THEN 'P' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' WHEN 4 THEN 'T' WHEN 5 THEN 'T1' WHEN 6 THEN ' u ' WHEN 7 THEN 'U1' WHEN 8 THEN 'U2' WHEN 9 THEN 'U3'
    WHEN 10 THEN 'D' WHEN 11 THEN 'D2' WHEN 12 THEN 'GD' WHEN 13 THEN 'Pc' WHEN 14 THEN 'Tc' WHEN 15 THEN 'Uc' WHEN 16 THEN 'Dc' ELSE 'F' END AS symbol
FROM o WHERE rn = 1""",
    "team_foul_cells": """
SELECT d.document_id, s.side, CAST(p.n AS BIGINT) AS period, CAST(c.n AS BIGINT) AS slot,
  CASE WHEN (7 * d.document_id + 3 * p.n + c.n) % 11 = 0 THEN 'ambiguous' WHEN (5 * d.document_id + p.n + 3 * c.n) % 13 = 0 THEN 'empty'
    WHEN c.n <= (d.document_id + p.n + s.o) % 5 THEN 'x' ELSE 'unused' END AS kind, CAST((d.document_id + 3 * c.n + p.n) % 50 AS DOUBLE) / 50 AS confidence
FROM (SELECT DISTINCT user_id AS document_id FROM {events}) d CROSS JOIN (SELECT 'A' AS side, 0 AS o UNION ALL SELECT 'B', 2) s
CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c""",
    "written_scores": """
SELECT d.document_id, s.side, CAST(p.n AS BIGINT) AS period, CASE WHEN (d.document_id + p.n) % 11 = 0 THEN NULL ELSE CAST((d.document_id * 3 + p.n * 7) % 30 AS BIGINT) END AS value,
  CASE (d.document_id + p.n) % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'unresolved' END AS status
FROM (SELECT DISTINCT user_id AS document_id FROM {events}) d CROSS JOIN (SELECT 'A' AS side UNION ALL SELECT 'B') s
CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p""",
    "predictions": """
SELECT l_orderkey AS document_id, l_linestatus AS field_type, l_returnflag AS expected,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'N' ELSE l_returnflag END AS predicted, ROUND(ABS(l_discount) * 10, 2) AS confidence,
  CASE l_linenumber % 3 WHEN 0 THEN 'camera_image' WHEN 1 THEN 'pdf_scan' ELSE 'other' END AS capture, l_suppkey % 2 = 0 AS writer_known, l_suppkey % 5 = 0 AS writer_seen FROM {lineitem}""",
    "catalog": """
SELECT doc_id AS document_id, CONCAT('cat', CAST(doc_id % 7 AS VARCHAR(20))) AS category, CASE doc_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' ELSE 'jpeg' END AS extension,
  CASE WHEN doc_id % 10 = 0 THEN 'unreadable' WHEN doc_id % 10 IN (1, 2) THEN 'alignment_review' ELSE 'ready' END AS status, lang AS writer FROM {documents}""",
    "reviews": """
SELECT d.doc_id AS crop_id, d.lang AS field_type, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted' WHEN l.quality = 1 THEN 'adjusted' ELSE 'illegible' END AS review_state,
  CONCAT('h', CAST(d.n_chars AS VARCHAR(20))) AS source_hash, CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN 'stale' ELSE CONCAT('h', CAST(d.n_chars AS VARCHAR(20))) END AS reviewed_hash,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.source END AS label, d.doc_id % 5 <> 0 AS model_trainable
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "ground_truth": """
SELECT doc_id AS document_id, CONCAT('s/', CAST(doc_id AS VARCHAR(20))) AS source_path, CONCAT('{{"game_id": "', CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR(20)) END, '", "source_file": "s/', CASE WHEN doc_id % 13 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR(20)) END, '"',
  CASE doc_id % 5 WHEN 0 THEN ', "review": {{"status": "pending"}}' WHEN 1 THEN ', "review": {{"status": " Reviewed ", "reviewed_at": "2020-01-01", "method": "manual"}}' WHEN 2 THEN ', "review": {{"status": "verified", "reviewed_at": " "}}'
    WHEN 3 THEN ', "warnings": ["Gabarito PENDENTE.", 1]' ELSE ', "review": "reviewed", "warnings": [1]' END,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE CONCAT(', "teams": {{"A": ', CONCAT('{{"roster": [', CASE WHEN (doc_id + 0) % 6 = 0 THEN '' ELSE '4, 5' END, '], "team_fouls": {{"Q1": 1, "Q2": ', CASE WHEN (doc_id + 0) % 8 = 0 THEN 'null' ELSE '2' END, ', "Q3": 0, "Q4": true}}, "individual_fouls_reviewed": ',
    CASE WHEN (doc_id + 0) % 9 = 0 THEN 'false' ELSE 'true' END, CASE (doc_id + 0) % 4 WHEN 0 THEN ', "individual_foul_observations": []' WHEN 1 THEN ', "individual_foul_observations": {{"4": [{{"slot": 1, "review_state": "verified"}}, {{"slot": 2}}], "5": [7], "6": 1}}'
    WHEN 2 THEN ', "individual_foul_observations": {{"5": [{{"slot": 1, "review_state": "unresolved"}}]}}' ELSE '' END, '}}'), ', "B": ', CASE WHEN doc_id % 10 = 3 THEN 'null' ELSE CONCAT('{{"roster": [', CASE WHEN (doc_id + 1) % 6 = 0 THEN '' ELSE '4, 5' END, '], "team_fouls": {{"Q1": 1, "Q2": ', CASE WHEN (doc_id + 1) % 8 = 0 THEN 'null' ELSE '2' END, ', "Q3": 0, "Q4": true}}, "individual_fouls_reviewed": ',
    CASE WHEN (doc_id + 1) % 9 = 0 THEN 'false' ELSE 'true' END, CASE (doc_id + 1) % 4 WHEN 0 THEN ', "individual_foul_observations": []' WHEN 1 THEN ', "individual_foul_observations": {{"4": [{{"slot": 1, "review_state": "verified"}}, {{"slot": 2}}], "5": [7], "6": 1}}'
    WHEN 2 THEN ', "individual_foul_observations": {{"5": [{{"slot": 1, "review_state": "unresolved"}}]}}' ELSE '' END, '}}') END, '}}') END,
  ', "period_scores": {{"A": {{"Q1": ', CAST(doc_id % 4 AS VARCHAR(20)), ', "Q2": 2, "Q3": 0, "Q4": ', CASE WHEN doc_id % 17 = 0 THEN '1.5' ELSE '1' END, '}}, "B": {{"Q1": 0, "Q2": 0, "Q3": 0, "Q4": 0}}}}, "final_score": {{"A": ', CAST(doc_id % 4 + 3 + CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END AS VARCHAR(20)), ', "B": ',
  CASE WHEN doc_id % 19 = 0 THEN '"0"' ELSE '0' END, '}}', CASE doc_id % 4 WHEN 0 THEN ', "scoring": []' WHEN 1 THEN '' WHEN 2 THEN ', "scoring": [{{"team": "A", "period": "Q1", "points": 2}}, {{"team": "A", "period": "Q2", "points": 2}}, {{"team": "A", "period": "Q4", "points": true}}, 5, {{"team": "C", "period": "Q1", "points": 3}}]'
    ELSE ', "scoring": [{{"team": "B", "period": "Q4", "points": 1}}, {{"team": "A", "period": "Q1", "points": 3}}]' END, CASE doc_id % 6 WHEN 0 THEN ', "evaluation_split": "test"' WHEN 1 THEN ', "evaluation_split": null' WHEN 2 THEN ', "evaluation_split": "dev"' ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE CONCAT(', "writer_name": " W', CAST(doc_id % 29 AS VARCHAR(20)), '"') END, '}}') AS text FROM {documents}""",
    "automatic_crops": """
SELECT d.doc_id AS crop_id, CASE d.doc_id % 5 WHEN 0 THEN 'jersey' WHEN 1 THEN 'scoring_event' WHEN 2 THEN 'foul_event' WHEN 3 THEN 'foul_symbol' ELSE 'other' END AS field_type, CAST(d.n_chars AS VARCHAR(20)) AS source_image_hash,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST(d.n_chars % 7 AS VARCHAR(20)) END AS crop_image_hash, d.doc_id % 6 <> 0 AS model_trainable, CASE WHEN d.doc_id % 8 = 0 THEN 'labeled' ELSE 'unlabeled' END AS status FROM {documents} d""",
    "reviewed_crops": """
SELECT d.doc_id AS crop_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted' WHEN l.quality = 1 THEN 'adjusted' WHEN d.doc_id % 4 = 0 THEN 'rejected_empty' ELSE 'illegible' END AS review_state,
  CASE WHEN d.doc_id % 17 = 0 THEN 'old' WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(d.n_chars AS VARCHAR(20)) END AS source_image_hash, CAST(d.n_chars % 7 AS VARCHAR(20)) AS crop_image_hash, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.source END AS label,
  d.doc_id % 6 <> 0 AS model_trainable, d.doc_id % 10 = 3 AS audit_required, CASE d.doc_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'corrected' ELSE 'pending' END AS audit_state FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "pixels": """
SELECT l_orderkey AS cell, l_partkey % 40 AS x, l_suppkey % 40 AS y FROM {lineitem}""",
    "candidates": """
SELECT vec_id, label AS truth, embedding FROM {embeddings}""",
}

_TABLES = ("events", "lineitem", "documents", "labels", "embeddings", "conversations", "orders")


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The observations of that name as a DataFrame."""
    sql = BRIDGES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def bridge_sql(name: str) -> str:
    """The same as a DuckDB subquery."""
    return "(" + BRIDGES[name].format(**{t: t for t in _TABLES}) + ")"
