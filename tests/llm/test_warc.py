import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import warc
from gleaner.llm.warc import WarcReader, archive_pages, mark_revisits, read_warc, warc_records, write_warc
from gleaner.session import shared_path
from tests.llm.texts import order

SCHEMA = "page_id long, url string, html string, refers_to string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", "y") for p, u, h in rows], SCHEMA)


ROWS = [
    (1, "http://a/1", "<p>" + "x" * 2000),
    (2, "http://a/2", "<p>" + "x" * 2000),
    (9, "http://a/9", "<p>" + "x" * 2000),
    (3, None, "short"),
    (4, "http://a/\r\nWARC-Type: metadata", "short"),
    (5, "http://ü/5", None),
    (6, "", ""),
    (7, "u", "é" * 500),
    (8, "u", "é" * 500),
    (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 40),
    (11, "u", "\x00\r\n" * 100_000),
    (None, "u", "<p>" + "x" * 2000),
    (None, "u", "unique" * 300),
    (12, "u", "same id" * 200),
    (12, "u", "same id" * 200),
]


def brute(rows):
    keep = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000 and p is not None:
            keep[h] = max(keep.get(h, p), p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        first = keep.get(h) if len(body) >= 1000 else None
        revisit = first is not None and first != p
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_pages_come_back(spark):
    found = archive_pages(pages(spark, ROWS), shared_path(spark, "w"))
    assert order(map(tuple, found.drop("target_uri").collect())) == order(brute(ROWS))


def test_payloads_and_filters(spark):
    path = shared_path(spark, "w")
    write_warc(warc_records(mark_revisits(pages(spark, ROWS))), path, "none", 4)
    every = read_warc(spark, path)
    bodies = {r["record_id"]: bytes(r["payload"]) for r in every.where("record_type = 'response'").collect()}
    assert bodies["<urn:page:11>"] == ("\x00\r\n" * 100_000).encode() and bodies["<urn:page:5>"] == b""
    revisits = read_warc(spark, path, "none").where(F.col("record_type") == "revisit")
    assert {r["refers_to"] for r in revisits.collect()} == {"<urn:page:9>", "<urn:page:8>"}
    assert every.where(F.col("target_uri").startswith("http://a")).count() == 4
    assert every.where(F.col("record_id").isin("<urn:page:1>", "<urn:page:3>")).count() == 2
    assert every.where("refers_to is not null and content_length > 10").count() == 4


def rows_of(path, payload="bytes", *filters):
    reader = WarcReader({"path": str(path), "payload": payload})
    list(reader.pushFilters(list(filters)))
    return [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]


RECORD = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def some_records(n=300):
    rng = __import__("random").Random(3)
    kinds = [("response" if k % 3 else "revisit", k, "HTTP/1.1 200\r\n\r\n" + "".join(rng.choices("ab\r\n ", k=rng.choice([0, 5, 3000, 200_000])))) for k in range(n)]
    return kinds, [RECORD.format(t, k, len(b), b).encode() for t, k, b in kinds]


@pytest.mark.parametrize("layout", ["sized", "members", "one", "several", "plain"])
def test_archives_of_any_layout(tmp_path, layout):
    """Members that tell their size, plain members, one for all or for some records, not packed."""
    kinds, data = some_records()
    packed = {
        "sized": lambda: b"".join(map(warc.member, data)),
        "members": lambda: b"".join(map(gzip.compress, data)),
        "one": lambda: gzip.compress(b"".join(data)),
        "several": lambda: b"".join(gzip.compress(b"".join(data[k : k + 7])) for k in range(0, len(data), 7)),
        "plain": lambda: b"".join(data),
    }[layout]()
    path = tmp_path / ("a.warc" if layout == "plain" else "a.warc.gz")
    path.write_bytes(packed)
    if layout != "plain":
        assert gzip.decompress(packed) == b"".join(data)
    from pyspark.sql.datasource import EqualTo, In

    found = rows_of(path)
    assert [(r["record_type"], r["record_id"], r["payload"]) for r in found] == [(t, f"<{k}>", b.encode()[16:] if t == "response" else None) for t, k, b in kinds]
    assert [r["record_id"] for r in rows_of(path, "none")] == [f"<{k}>" for _, k, _ in kinds]
    assert [r["record_id"] for r in rows_of(path, "bytes", EqualTo(("record_type",), "revisit"))] == [f"<{k}>" for t, k, _ in kinds if t == "revisit"]
    some = rows_of(path, "digest", In(("record_id",), ("<7>", "<200>", "<299>")))
    assert [(r["record_id"], r["payload_length"]) for r in some] == [(f"<{k}>", len(kinds[k][2]) - 16) for k in (7, 200, 299)]


def test_payloads_that_are_not_wanted_are_not_unpacked(tmp_path, monkeypatch):
    kinds, data = some_records()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, data)))
    got = []
    more = warc.Records._more

    def counted(self):
        before = len(self.out)
        out = more(self)
        got.append(len(self.out) - before)
        return out

    monkeypatch.setattr(warc.Records, "_more", counted)
    monkeypatch.setattr(warc.Records, "STEP", 1 << 12)
    assert len(rows_of(tmp_path, "none")) == len(kinds)
    assert sum(got) < 0.1 * sum(map(len, data))


def test_response_without_http_headers(tmp_path):
    (tmp_path / "a.warc").write_text(RECORD.format("response", 1, 3, "abc"), newline="")
    assert rows_of(tmp_path)[0]["payload"] == b"abc"


def test_only_committed_files_count(spark):
    path = shared_path(spark, "w")
    write_warc(warc_records(mark_revisits(pages(spark, ROWS))), path, records_per_file=4)
    write_warc(warc_records(mark_revisits(pages(spark, ROWS[:2]))), path)
    store, root = warc._store(path)
    with store.open_output_stream(f"{root}/left-by-a-lost-task.warc.gz") as out:
        out.write(b"half a record")
    assert read_warc(spark, path, "none").count() == len(ROWS) + 2


def test_object_stores(monkeypatch):
    """Paths in a store are its own: they may begin with the bucket."""
    from pyarrow import fs

    asked = []
    memory = fs._MockFileSystem()
    memory.create_dir("bucket/key")
    with memory.open_output_stream("bucket/key/a.warc") as out:
        out.write(RECORD.format("revisit", 1, 2, "ab").encode())
    monkeypatch.setattr(fs, "FileSystem", type("Any", (), {"from_uri": staticmethod(lambda uri: (asked.append(uri), (memory, "bucket/key"))[1])}))
    assert [r["record_id"] for r in rows_of("s3a://bucket/key")] == ["<1>"]
    assert set(asked) == {"s3://bucket/key"}


def test_filtered_records_are_not_decoded(tmp_path):
    from pyspark.sql.datasource import EqualTo

    record = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <x>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    (tmp_path / "a.warc").write_text(record.format("response", 8, "not http") + record.format("revisit", 4, "\r\n\r\n"), newline="")
    reader = WarcReader({"path": str(tmp_path), "payload": "bytes"})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("content_length",), 4)])) == [EqualTo(("content_length",), 4)]
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r["record_type"] for r in rows] == ["revisit"]


def test_broken_archives(tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100\r\n\r\nHTTP/1.1 200\r\n\r\nabc"
    for name, data in (("cut.warc", head), ("cut.warc.gz", gzip.compress(head)), ("odd.warc", b"hello\r\n")):
        (tmp_path / name).write_bytes(data)
        reader = WarcReader({"path": str(tmp_path / name)})
        with pytest.raises(ValueError):
            [list(reader.read(p)) for p in reader.partitions()]


def test_empty_table(spark):
    assert archive_pages(pages(spark, []), shared_path(spark, "w")).count() == 0
