"""WARC archives: a writer with revisit records and a splittable reader.

Files hold one gzip member a record. Tasks scan byte ranges for the gzip magic and check each candidate by decoding it: a
whole member, whose content begins with the WARC version line, is a record's candidate, owned by the range that it starts
in. A range may begin inside a member whose payload holds gzip members of its own, stored as they are; no range can
tell these from records. So the candidates' starts and ends are followed from each file's first byte, as a reader of the
whole file would, and only members met on that way are read. Results are the same for every split.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, small_batches, written

#: Payloads of at least so many bytes are archived once.
REVISIT_BYTES = 100
SPLIT, MOST_TASKS = 8 << 20, 100_000
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # records carry no capture time


def _id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit has the response's HTTP head, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"Content-Length: {len(body)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, size, n = TaskContext.get(), None, 0, 0
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                raw = record(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            # Only files of tasks that ended are in the result; a lost attempt's file has another name and is never read.
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return run


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); returns the files written (path, bytes, records).

    Of payloads with equal SHA-256 of at least REVISIT_BYTES bytes, the smallest page_id's is a response and the others
    are revisits. A null html is an empty payload, a null url is about:blank, a null page_id is written as None and is
    never a revisit nor referred to. Of rows with one page_id and equal payloads, each is a response. Other columns are not looked at.
    """
    small_batches(pages.sparkSession, 128)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html"), 256))
    # Only digests that occur more than once travel to the join.
    firsts = pages.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first <> last").select("digest", "first")
    again = F.when((F.col("first") != F.col("page_id")) & (F.octet_length("html") >= REVISIT_BYTES), F.col("first"))
    rows = pages.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", again.alias("refers_to"))
    return written(rows.mapInArrow(_writer(folder), "path string, bytes long, records long"), "warc-files")


class _Window:
    """Bytes of a file, read in pieces as asked; what lies before `at` is given up."""

    def __init__(self, stream, size: int, at: int):
        self.stream, self.size, self.at = stream, size, at
        self.buf, self.base = b"", at

    def piece(self, at: int, most: int) -> bytes:
        """At most `most` bytes from `at`, of which at least one unless the file ends there."""
        if not self.base <= at < self.base + len(self.buf):
            if at >= self.size:
                return b""
            self.buf, self.base = self.stream.read_at(min(READ, self.size - at), at), at
        k = at - self.base
        return self.buf[k : k + most]

    def next_magic(self, end: int) -> int | None:
        """The first place in [at, end) where the magic starts."""
        while self.at < end:
            held = self.piece(self.at, READ)
            if not held:
                return None
            k = held.find(MAGIC)
            if k >= 0:
                return self.at + k if self.at + k < end else None
            # The magic may lie across this piece's end.
            ahead = self.at + len(held)
            if ahead >= self.size:
                return None
            back = max(self.at, ahead - len(MAGIC) + 1)
            if len(held) < len(MAGIC):
                self.buf, self.base = self.stream.read_at(min(READ, self.size - self.at), self.at), self.at
                if len(self.buf) <= len(held):
                    return None
                continue
            self.at, self.buf, self.base = back, b"", back
        return None


def _inflated(win: _Window, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the content of the gzip member at `at`, each with the member's end (0 until it is known); stops early if there is none."""
    z, used = zlib.decompressobj(31), at
    while not z.eof:
        given = win.piece(used, 4096 if used == at else READ)
        if not given:
            return
        used += len(given)
        while given and not z.eof:
            try:
                out = z.decompress(given, READ)
            except zlib.error:
                return
            given = z.unconsumed_tail
            yield out, used - len(z.unused_data) if z.eof else 0


def candidates(stream, size: int, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a WARC record) of every whole gzip member that starts in [start, end), members inside others too."""
    win = _Window(stream, size, start)
    while (at := win.next_magic(end)) is not None:
        head, stop = b"", 0
        for out, stop in _inflated(win, at):
            head = (head + out[:5])[:5]
        if stop:
            yield at, stop, head == b"WARC/"
        win.at = at + 1


def followed(spans: Iterator[tuple[int, int, bool]]) -> list[int]:
    """Starts of the records among a file's candidates: each member's end is where the next one may start."""
    at, out = 0, []
    for start, stop, record in sorted(spans):
        if start >= at:
            at = stop
            if record:
                out.append(start)
    return out


def member(stream, size: int, at: int) -> bytes:
    """The content of the whole gzip member at `at`."""
    return b"".join(out for out, _ in _inflated(_Window(stream, size, at), at))


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields and HTTP fields (names in lower case), and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")

    def fields(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode("utf-8", "replace").split("\r\n")[1:])}

    own = fields(head)
    block = rest[: _count(own.get("content-length"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, fields(http), payload


def _count(field: str | None) -> int:
    return int(field) if field and re.fullmatch(r"[0-9]{1,18}", field) else 0


def _page(uri: str | None) -> int | None:
    tail = re.fullmatch(r"<?urn:page:(-?[0-9]{1,19})>?", uri or "")
    return int(tail[1]) if tail and -(1 << 63) <= int(tail[1]) < 1 << 63 else None


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as stream:
                spans = list(candidates(stream, size, start, end))
            if spans:
                starts, stops, records = zip(*spans, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(spans)), pa.array([size] * len(spans), pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(records, pa.bool_())], ["path", "bytes", "start", "stop", "record"])


def _walk(split: int):
    def run(table: pa.Table) -> pa.Table:
        path, size = (table[c][0].as_py() for c in ("path", "bytes"))
        starts = followed(zip(*(table[c].to_pylist() for c in ("start", "stop", "record")), strict=True))
        parts: dict[int, list[int]] = {}
        for s in starts:
            parts.setdefault(s // split, []).append(s)
        return pa.table({"path": pa.array([path] * len(parts), pa.string()), "bytes": pa.array([size] * len(parts), pa.int64()), "part": pa.array(list(parts), pa.int64()), "starts": pa.array(list(parts.values()), pa.list_(pa.int64()))})

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_file(name) as stream:
                win = _Window(stream, size, starts[0])
                for at in starts:
                    own, http, payload = parsed(b"".join(out for out, _ in _inflated(win, at)))
                    kind = own.get("warc-type")
                    if kind == "revisit":
                        n, digest = _count(http.get("content-length")), own.get("warc-payload-digest", "").removeprefix("sha256:")
                    else:
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((_page(own.get("warc-record-id")), own.get("warc-target-uri"), kind, n, digest, _page(own.get("warc-refers-to")), payload))
                    held += len(payload)
                    if held > 4 * READ:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def read_archive(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of files(path, bytes, ...).

    Size and digest are those of the full payload, taken from a revisit's header fields. Bytes that are no record are passed
    over: gzip members of other content as a whole, a member cut off by the file's end or damaged up to the next whole one.
    A record whose id was not written here has a null page_id, one whose lengths are no numbers an empty payload. The
    members' places of one file (some 60 bytes a record) are followed in one task; empty files have no record.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = files.filter("bytes > 0").select("path", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split, F.col("bytes")))
    # As many tasks as ranges: the rows are few, so Spark would join them into one task.
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    found = ranges.repartition(tasks, "path", "start").mapInArrow(_scanner, "path string, bytes long, start long, stop long, record boolean")
    parts = written(found.groupBy("path").applyInArrow(_walk(split), "path string, bytes long, part long, starts array<long>"), "warc-starts")
    return parts.repartition(tasks, "path", "part").select("path", "bytes", "starts").mapInArrow(_reader, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Round trip: write all pages to archives in the shared folder and read them back."""
    files = write_archive(pages, new_path(pages.sparkSession, "warc"))
    return read_archive(files)


def op4(spark, sf_dir: str) -> DataFrame:
    """archived over the whole pages table, without the payloads."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first_id FROM p WHERE b >= 100 GROUP BY d)
SELECT p.page_id, p.b AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.b >= 100
"""
