import io
import struct
import zipfile

import pytest

from tessella.sources import zipped


def joined(df) -> bytes:
    return b"".join(bytes(r.piece) for r in sorted(df.collect(), key=lambda r: (r.section, r.place)))


def test_archive_opens_and_equals_the_files(spark):
    files = [(f"d{i % 7}/ä{i}.md", (f"text {i} " * (i % 50)).encode()) for i in range(300)] + [("empty.md", b""), ("null.md", None), ("big.bin", bytes(range(256)) * 4000)]
    df = spark.createDataFrame(files, "file_path string, content binary").repartition(9)
    pieces = zipped.one_archive(df)
    places = sorted((r.section, r.place, len(r.piece)) for r in pieces.collect())
    at = 0
    for _, place, n in places:  # each piece lies where the ones before end
        assert place == at
        at += n
    z = zipfile.ZipFile(io.BytesIO(joined(pieces)))
    assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {p: c or b"" for p, c in files}
    assert z.namelist() == sorted(z.namelist(), key=lambda n: n.encode())
    assert zipfile.ZipFile(io.BytesIO(joined(zipped.one_archive(df.limit(0))))).namelist() == []
    with pytest.raises(Exception, match="unsafe"):
        zipped.one_archive(spark.createDataFrame([("../x", b"a")], "file_path string, content binary")).collect()


def test_places_beyond_four_gigabytes(spark):
    big = (1 << 32) + 5
    found = zipped.placed(spark.createDataFrame([(f"f{i}", big) for i in range(9)], "file_path string, length long").repartition(4), 7)
    assert sorted((r.file_path, r.place) for r in found.collect()) == [(f"f{i}", 7 + i * big) for i in range(9)]
    entry = zipped.central_entry(b"n", 1, 2, 3, big)
    assert struct.unpack("<I", entry[42:46])[0] == 0xFFFFFFFF and entry.endswith(struct.pack("<HHQ", 1, 8, big))
    # A reader finds a directory that lies beyond 4 GB by the records of its end.
    end = zipped.end_records(70_000, 10, big)
    locator = end[-42:-22]
    assert struct.unpack("<IIQI", locator) == (0x07064B50, 0, big + 10, 1) and struct.unpack("<Q", end[48:56])[0] == big
    assert len(zipped.local_header(b"n", 1, big, big)) == 30 + 1 + 20


def test_many_files(spark):
    df = spark.range(66_000).selectExpr("concat('f', id) AS file_path", "cast('x' AS binary) AS content")
    z = zipfile.ZipFile(io.BytesIO(joined(zipped.one_archive(df))))
    assert len(z.namelist()) == 66_000 and z.read("f65999") == b"x"


def test_whole_export(spark):
    from tessella.sources import sinks

    files = spark.createDataFrame([("a/b.md", b"B")], "file_path string, content binary")
    chat = spark.createDataFrame([(2, "assistant", "yes"), (1, "user", "ask")], "id long, role string, content string").selectExpr("*", "array('f') AS sources", "timestamp'2024-01-01' AS created_at")
    z = zipfile.ZipFile(io.BytesIO(joined(sinks.whole_export(files, chat, "k: 5"))))
    assert set(z.namelist()) == {"knowledge/a/b.md", "config.yaml", "chat/000000000000.jsonl"} and z.read("config.yaml") == b"k: 5"
    assert [line.split(b'"content":"')[1][:3] for line in z.read("chat/000000000000.jsonl").splitlines()] == [b"ask", b"yes"]
