"""Which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _hash_share(column: str = "doc_id"):
    """The hash of the id as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / float(1 << 53)


def sampled_texts(docs: DataFrame, labels: DataFrame | None, per_label: int, max_chars: int, max_rows: int) -> list[tuple[int, object, str]]:
    """(doc_id, label, text) of at most per_label rows of each label and max_rows in all, spread by a hash of doc_id.

    labels: (doc_id, label), or None where docs has a column label. Only texts of at most max_chars are counted and drawn.
    Rows whose hash is beyond what a label's count makes likely to be drawn are dropped before any ranking, so that a task
    ranks little more than per_label rows of a label, whatever share of all rows it has.
    """
    short = docs.filter(F.length("text") <= max_chars).filter("doc_id is not null").filter(~held_out())
    if labels is None:
        marks = short.filter("label is not null").select("doc_id", "label")
    else:
        marks = labels.filter("label is not null and doc_id is not null").join(short.select("doc_id"), "doc_id", "left_semi").select("doc_id", "label")
    counts = marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(max_rows).collect()
    if not counts:
        return []
    # Six standard deviations more than per_label: fewer are drawn with 1e-9.
    reach = per_label + 6 * per_label**0.5 + 36
    table = docs.sparkSession.createDataFrame([(r.label, min(1.0, reach / r.n)) for r in counts], marks.select("label").schema.add("most", "double"))
    spread = Window.partitionBy("label").orderBy(_hash_share(), "doc_id")
    near = marks.join(F.broadcast(table), "label").filter(_hash_share() <= F.col("most"))
    ids = (
        near.withColumn("r", F.row_number().over(spread))
        .filter(F.col("r") <= per_label)
        .select("doc_id", "label", "r")
        .orderBy("r", "label", "doc_id")
        .limit(max_rows)
        .collect()
    )
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in ids], marks.schema)
    if labels is None:
        rows = short.join(F.broadcast(wanted.withColumnRenamed("label", "l2").withColumnRenamed("doc_id", "d2")), (F.col("doc_id") == F.col("d2")) & F.col("label").eqNullSafe(F.col("l2"))).select("doc_id", "label", "text").collect()
    else:
        rows = short.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text").collect()
    # Of repeated ids with one label, the greatest text.
    return sorted({(r.doc_id, r.label): (r.doc_id, r.label, r.text) for r in sorted(rows, key=lambda r: r.text)}.values(), key=lambda r: (r[0], str(r[1])))
