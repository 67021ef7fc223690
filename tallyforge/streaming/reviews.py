"""Review exports as a stream: files that arrive in a folder are imported batch by batch, each onto the reviews of the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotations as an


def task_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """The tasks of export files as they arrive, a file taken whole."""
    text = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(folder)
    return text.select(F.explode(F.variant_get(F.parse_json("value"), "$", f"array<{an.TASK}>")).alias("t")).select("t.*")


def start_import(spark: SparkSession, folder: str, manifest: DataFrame, catalog: DataFrame, stage: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start importing; each batch n writes all crops of the manifest to target/batch=n, the latest reviews winning.

    A batch reads the folder of the batch before it, so one that is tried again after a failure gives the same rows: it overwrites its own
    folder only. All available files are taken, then the query ends; start it again to go on.
    """

    def merge(tasks: DataFrame, n: int) -> None:
        s = tasks.sparkSession
        earlier = s.read.parquet(f"{target}/batch={n - 1}") if n else None
        decided = an.imported_crops(tasks, manifest, catalog, stage)
        an.reviewed_manifest(manifest, decided, earlier, stage).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return task_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_reviews(spark: SparkSession, target: str) -> DataFrame:
    """The reviews after the last batch, without its number."""
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("batch").alias("b")).first().b
    return rows.filter(F.col("batch") == last).drop("batch")
