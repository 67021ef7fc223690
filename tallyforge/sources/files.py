"""Records from files, and files of records: JSON lines, JSON documents, archives of scans, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as sc

# What an archive's entries may be.
SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON lines; blank lines are passed over, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that hold no JSON object, counted from 1.

    A file is read whole by one task here, as line numbers need; it is a diagnosis of files that read_jsonl refused.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "value"))
    bad = F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")
    return text.filter((F.trim("value") != "") & bad).select("file", (F.col("k") + 1).cast("long").alias("line"), "value")


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file (*.json), with `stem`, the file's name without its suffix."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, whole: bool = False) -> DataFrame:
    """JSON records of a path, one a line or, with whole, one a file; none where the path does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole).json(path)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    if not info.is_dir() and info.filename.lower().endswith(SUFFIXES):
                        # One entry is held at a time.
                        yield pd.DataFrame({"archive": [path], "entry": [info.filename], "content": [archive.read(info)]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entry, category, extension, content) of scans in ZIP archives; an archive, of at most 2 GB, is one task's.

    The category is the entry's folder. An absolute path, one that climbs, or one without a folder fails the read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    entries = files.mapInPandas(_entries, "archive string, entry string, content binary")
    extension = F.lower(F.regexp_extract("entry", r"\.([^.]*)$", 1))
    return entries.select("archive", F.translate("entry", "\\", "/").alias("entry"), sc.category_of(F.col("entry")).alias("category"), extension.alias("extension"), "content")


def ingested(entries: DataFrame, read: Callable[[bytes], tuple[int, int, str, bool]] | None = None) -> DataFrame:
    """Catalogue rows of read_archives: id, names, hash, size, page count, image size, alignment and status.

    read(content) gives (width, height, alignment method, border found) of an image, or raises: then the row is unreadable and keeps the
    error. Without it every row is one of an image that could not be read.
    """
    outcome = "width int, height int, alignment_method string, used_perspective_warp boolean, error string"

    @F.pandas_udf(outcome)
    def seen(content: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in content:
            try:
                if read is None:
                    raise RuntimeError("no image reader was given")
                rows.append((*read(raw), None))
            except Exception as e:  # an unreadable page is a result
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in outcome.split(", ")])

    sha = F.sha2("content", 256)
    stem = F.regexp_replace(F.element_at(F.split("entry", "/"), -1), r"\.[^.]*$", "")
    e = entries.withColumn("seen", seen("content")).withColumn("sha256", sha).withColumn("document_id", sc.document_id(F.col("category"), stem, sha))
    suffix, category = F.concat(F.lit("."), F.col("extension")), sc.slug(F.col("category"))
    return e.select(
        "document_id", F.col("entry").alias("original_name"), F.concat(F.lit("source/"), category, F.lit("/"), F.col("document_id"), suffix).alias("source_path"), category.alias("category"), suffix.alias("extension"), "sha256",
        F.octet_length("content").cast("long").alias("size_bytes"), F.when(F.col("extension") != "pdf", 1).alias("page_count"), F.col("seen.width").alias("image_width"), F.col("seen.height").alias("image_height"), "seen.alignment_method",
        "seen.used_perspective_warp", sc.catalogue_status(F.col("seen.used_perspective_warp"), F.col("seen.error")).alias("status"), "seen.error",
    )


def image_header(content: bytes) -> tuple[int, int, str, bool]:
    """Width and height of a PNG or JPEG from its head, taken as it is: no border was looked for. Another file raises."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big"), "resize", False
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 < len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's head
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big"), "resize", False
        at += 2 + size
    raise ValueError("neither PNG nor JPEG")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, rgb): PNG and JPEG images, their pixels row by row as red, green and blue bytes; other files fail the read.

    Spark decodes them. Pages of PDF files need a renderer that is not here: read_archives gives their bytes.
    """
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw, n):
            if n <= 0:
                raise ValueError("not an image")
            x = np.frombuffer(raw, np.uint8).reshape(-1, n)
            return (np.repeat(x, 3, axis=1) if n == 1 else x[:, 2::-1]).tobytes()  # held as blue, green, red

        return pd.Series([one(a, b) for a, b in zip(data, channels, strict=True)])

    return i.select("origin", "width", "height", rgb("data", "nChannels").alias("rgb"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines; nulls are written."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path, "append")


def report(rows: DataFrame) -> DataFrame:
    """One JSON text for each row of a report, its keys in alphabetical order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write_document(text: str, path: str) -> None:
    """One JSON document on the driver's disk, its folders made, with a newline at its end."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text if text.endswith("\n") else text + "\n", encoding="utf-8")


def write_crops(rows: DataFrame, path: str) -> None:
    """(field_type, split, document_id, name, png, ...): a table of crops in folders by field type and split."""
    rows.write.mode("append").partitionBy("field_type", "split").parquet(path)
