"""File sources and sinks, by round trips and refused inputs."""

import json
import zipfile

import pytest

from tallyforge.sources import files


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n{"k": 2}\n')
    assert sorted((r.k, r.v) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k long, v string").collect()) == [(1, "x"), (2, None)]
    rows = spark.createDataFrame([(1, None), (2, "é")], "k long, v string")
    files.write_jsonl(rows, str(tmp_path / "out"))
    files.append_jsonl(rows, str(tmp_path / "out"))
    assert sorted(r.k for r in files.read_jsonl(spark, str(tmp_path / "out"), "k long, v string").collect()) == [1, 1, 2, 2]
    assert files.read_or_empty(spark, str(tmp_path / "none"), "k long").count() == 0


def test_bad_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": \n[1]\n{"k": 2}\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k long").collect()
    assert sorted((r.line, r.value.strip()) for r in files.bad_lines(spark, str(tmp_path / "b.jsonl")).collect()) == [(3, '{"k":'), (4, "[1]")]


def test_documents(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps({"k": n}, indent=1))
    (tmp_path / "c.txt").write_text("no")
    assert sorted((r.stem, r.k) for r in files.read_documents(spark, str(tmp_path), "k string").collect()) == [("a", "a"), ("b", "b")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("top/u17/1.PDF", "top/u15/2.jpeg", "top/u15/notes.txt"):
            z.writestr(name, name)
    got = files.read_archives(spark, str(tmp_path / "a.zip")).collect()
    assert sorted((r.category, r.extension, bytes(r.content).decode()) for r in got) == [("u15", "jpeg", "top/u15/2.jpeg"), ("u17", "pdf", "top/u17/1.PDF")]
    for k, name in enumerate(("../x/1.pdf", "/x/1.pdf", "1.pdf")):
        with zipfile.ZipFile(tmp_path / f"bad{k}.zip", "w") as z:
            z.writestr(name, "x")
        with pytest.raises(Exception, match="Unsafe"):
            files.read_archives(spark, str(tmp_path / f"bad{k}.zip")).collect()


def png(pixels):
    """A PNG of rows of (r, g, b)."""
    import struct
    import zlib

    h, w, _ = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    import numpy as np

    x = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    (tmp_path / "a.png").write_bytes(png(x))
    r = files.read_images(spark, str(tmp_path)).first()
    assert (r.width, r.height, bytes(r.rgb)) == (4, 5, x.tobytes())
    (tmp_path / "b.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        files.read_images(spark, str(tmp_path)).collect()


def test_ingested(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Sub 15/Jogo 1.PNG", b"good")
        z.writestr("Sub 15/2.pdf", b"bad")

    def read(raw):
        if raw != b"good":
            raise OSError("no page")
        return 10, 20, "resize", False

    got = {r.extension: r for r in files.ingested(files.read_archives(spark, str(tmp_path / "a.zip")), read).collect()}
    a, b = got[".png"], got[".pdf"]
    assert a.document_id.startswith("sub-15-jogo-1-") and a.source_path == f"source/sub-15/{a.document_id}.png" and (a.status, a.page_count, a.image_width, a.size_bytes) == ("alignment_review", 1, 10, 4)
    assert (b.status, b.error, b.page_count, b.category) == ("unreadable", "OSError: no page", None, "sub-15")
    assert {r.status for r in files.ingested(files.read_archives(spark, str(tmp_path / "a.zip"))).collect()} == {"unreadable"}
    files.write_document('{"a": 1}', str(tmp_path / "x" / "y.json"))
    assert (tmp_path / "x" / "y.json").read_text() == '{"a": 1}\n'


def test_report(spark):
    text = files.report(spark.createDataFrame([(2, None)], "b long, a string")).first().value
    assert list(json.loads(text).items()) == [("a", None), ("b", 2)]
