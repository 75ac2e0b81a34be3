"""WARC archives, written and read by a Python data source.

Writing: each record is a gzip member of its own, whose extra field ``sl`` holds the sizes of the
member, packed and unpacked. Every task writes files of its own under new names; the driver then
lists those of the tasks that succeeded in a file of commits, and only these count.

Reading: ``spark.read.format("warc")`` plans one partition for each archive file, takes filters on
the record type and on the other header columns, and parses the headers of a record first. A
record that is filtered out, or whose payload isn't asked for, is passed over: by a seek where
the member tells its size or the file isn't packed, else without decoding it.
"""

from __future__ import annotations

import hashlib
import json
import operator
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from gleaner.llm.tasks import column
from gleaner.session import materialise

EOL = "\r\n"
#: Begins the names of files that list what was committed.
COMMITS = "_committed-"
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, computed_digest string, payload binary"
#: Header of each column that a filter can be pushed to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


# Writing


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]+", "%0D%0A")


def page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def mark_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``page_id, url?, payload, refers_to``: what every page's record refers to, null for responses.

    Of equal payloads of at least ``least`` bytes the page with the largest id is the response.
    Payloads are compared by SHA-256. Only groups of two or more are joined back, and that table
    is written first, so the planner broadcasts it or not by its true size. Rows that repeat the
    largest id are responses all; rows with a null id in a group revisit it.
    """
    payload = F.coalesce(column(payload_col), F.lit(""))
    key = F.when(F.octet_length(payload) >= least, F.sha2(payload, 256))
    keyed = pages.select(column(id_col).alias("page_id"), key.alias("payload_key"))
    groups = keyed.where("payload_key is not null").groupBy("payload_key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1 and first_id is not null").select("payload_key", "first_id"), "payloads")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(column(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"), key.alias("payload_key")).join(groups, "payload_key", "left")
    same = F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", F.when(~same, F.col("first_id")).alias("refers_to"))


def warc_records(marked: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One string ``record`` for each row of :func:`mark_revisits`, without the final CRLFs.

    ``WARC-Payload-Length`` is an extension field: a revisit has no payload to count.
    """
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), size.cast("string"), F.lit(EOL * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(size)

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    head = F.concat_ws(
        EOL,
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", page_uri(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _clean(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        field("WARC-Payload-Length", size.cast("string")),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, field("WARC-Refers-To", page_uri(F.col("refers_to")))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
    )
    return marked.select(F.concat(head, F.lit(EOL * 2), http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with its sizes in the extra field ``sl``, where they fit."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 24 + len(body) + 8
    extra = b"\x0c\x00sl\x08\x00" + struct.pack("<II", size, len(data)) if max(size, len(data)) < 1 << 32 else b"\x00\x00"
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _store(path: str):
    """``(file system, path in it)``. Spark's name of a scheme may differ from Arrow's."""
    from pyarrow import fs

    scheme, told, rest = path.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + told + rest)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes the first column, records without their final CRLFs, as archive files."""

    def __init__(self, options: dict):
        self.path, self.packed = options["path"], options.get("compression", "gzip") == "gzip"
        self.most, self.most_bytes = int(options.get("recordsPerFile", 20_000)), 128 << 20

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        names, out, n, size = [], None, 0, 0
        try:
            for batch in iterator:
                for value in batch.column(0):
                    if out is None or n >= self.most or size >= self.most_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                        out, n, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0, 0
                    data = value.as_py().encode("utf-8", "surrogatepass") + b"\r\n\r\n"
                    out.write(member(data) if self.packed else data)
                    n, size = n + 1, size + len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{COMMITS}{uuid.uuid4().hex}") as out:
            out.write(json.dumps([name for m in messages if m for name in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for name in (name for m in messages if m for name in m.names):
            store.delete_file(f"{root}/{name}")


def write_warc(records: DataFrame, path: str, compression: str = "gzip", records_per_file: int = 20_000) -> None:
    """Write records as archive files below ``path``, adding to what is there."""
    spark = records.sparkSession
    spark.dataSource.register(WarcDataSource)
    writer = records.select("record").write.format("warc").option("compression", compression).option("recordsPerFile", records_per_file)
    writer.mode("append").save(path)


# Reading


class ArchiveFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _passes(test: Filter, value: str | None) -> bool:
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return False
    if isinstance(test, IsNotNull):
        return True
    if isinstance(test, In):
        return value in test.value
    compare = operator.eq if isinstance(test, EqualTo) else str.startswith
    return compare(value, test.value)


class Records:
    """The bytes of an archive, packed or not, with a way past the rest of a record.

    Bytes are unpacked a few at a time, so those of a record that is passed over mostly aren't.
    """

    STEP = 1 << 16

    def __init__(self, raw, packed: bool):
        self.raw, self.packed = raw, packed
        self.into, self.pending, self.out = None, b"", b""
        self.start = self.length = None  # of the present member, as its extra field tells

    def _more(self) -> bool:
        """Add to ``out``; False at the end."""
        if not self.packed:
            data = self.raw.read(self.STEP)
            self.out += data
            return bool(data)
        if self.into is None:
            if len(self.pending) < 64:
                self.pending += self.raw.read(self.STEP)
            if not self.pending:
                return False
            self.start, self.length = self.raw.tell() - len(self.pending), self._told(self.pending)
            self.into = zlib.decompressobj(31)
        if not self.pending:
            self.pending = self.raw.read(self.STEP)
            if not self.pending:
                raise ValueError("the archive ends within a record")
        try:
            self.out += self.into.decompress(self.pending, self.STEP)
        except zlib.error as failure:
            raise ValueError(f"not a gzip member: {failure}") from failure
        self.pending = self.into.unconsumed_tail
        if self.into.eof:
            self.pending, self.into = self.into.unused_data, None
        return True

    @staticmethod
    def _told(data: bytes) -> int | None:
        """The packed size of a member, if its extra field is ``sl`` alone."""
        if len(data) >= 24 and data[3] & 4 and data[10:16] == b"\x0c\x00sl\x08\x00":
            return struct.unpack("<I", data[16:20])[0]
        return None

    def readline(self) -> bytes:
        at = -1
        while (at := self.out.find(b"\n")) < 0:
            if not self._more():
                at = len(self.out) - 1
                break
        line, self.out = self.out[: at + 1], self.out[at + 1 :]
        return line

    def read(self, size: int) -> bytes:
        parts, left = [self.out[:size]], size - min(size, len(self.out))
        self.out = self.out[size:]
        while left > 0:
            if not self._more():
                raise ValueError("the archive ends within a record")
            parts.append(self.out[:left])
            self.out = self.out[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def record_starts(self) -> tuple[int, int] | None:
        """``(place, size)`` of the member that the next record is, if that is known."""
        if self.packed and not self.out.strip(b"\r\n"):
            self.out = b""
            if self.into is not None:
                return None  # the member goes on: it has several records
            if self._more() and self.length is not None:
                return self.start, self.length
        return None

    def skip(self, size: int, known: tuple[int, int] | None) -> None:
        """Past ``size`` bytes, or past the whole of a member of known place and size."""
        if known and (self.into is None or self.start == known[0]):
            end = sum(known)
            behind = self.raw.tell() - len(self.pending)
            if self.into is not None or behind < end:
                if end <= self.raw.tell():
                    self.pending = self.pending[len(self.pending) - (self.raw.tell() - end) :]
                else:
                    self.raw.seek(end)
                    self.pending = b""
            self.into, self.out = None, b""
            return
        if not self.packed and size > len(self.out):
            ahead = size - len(self.out)
            if self.raw.tell() + ahead > self.raw.size():
                raise ValueError("the archive ends within a record")
            self.raw.seek(self.raw.tell() + ahead)
            self.out = b""
            return
        while size > 0:
            size -= len(self.read(min(size, self.STEP)))


def read_headers(stream: Records) -> dict[str, str] | None:
    """The header fields of the next record, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


class WarcReader(DataSourceReader):
    """``payload`` option: ``none`` (headers only), ``digest`` (size and SHA-1 of the payload), ``bytes``."""

    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("payload", "bytes")
        if self.mode not in ("none", "digest", "bytes"):
            raise ValueError(f"payload must be none, digest or bytes, not {self.mode}")
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, (EqualTo, EqualNullSafe, In, IsNotNull, IsNull, StringStartsWith)) and len(test.attribute) == 1 and test.attribute[0] in HEADERS:
                self.tests.append((HEADERS[test.attribute[0]], test))
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        commits = [x.path for x in found if x.base_name.startswith(COMMITS)]
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", ".")))
        if commits:
            listed = set()
            for path in commits:
                with store.open_input_stream(path) as data:
                    listed.update(json.loads(data.read()))
            names = [x for x in names if x.rpartition("/")[2] in listed]
        return [ArchiveFile(x) for x in names] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, held = [], 0
        with _store(self.path)[0].open_input_file(partition.path) as raw:
            stream = Records(raw, partition.path.endswith(".gz"))
            while True:
                known = stream.record_starts()
                fields = read_headers(stream)
                if fields is None:
                    break
                size = int(fields["content-length"])
                if not all(_passes(test, fields.get(name)) for name, test in self.tests):
                    stream.skip(size, known)
                    continue
                row, took = self.record(fields, stream, size, known)
                rows.append(row)
                held += took + 500
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def record(self, fields: dict[str, str], stream: Records, size: int, known: tuple[int, int] | None) -> tuple[tuple, int]:
        told = fields.get("warc-payload-length")
        length, computed, payload = int(told) if told else None, None, None
        if self.mode == "none" or fields.get("warc-type") != "response":
            stream.skip(size, known)
        else:
            block = stream.read(size)
            head = block.find(b"\r\n\r\n") if fields.get("content-type", "application/http").lower().startswith("application/http") else -1
            body = block[head + 4 :] if head >= 0 else block
            length, computed = len(body), hashlib.sha1(body).hexdigest()
            payload = body if self.mode == "bytes" else None
        digest = fields.get("warc-payload-digest")
        return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, length, size, computed, payload), len(payload or b"")


ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "none|digest|bytes").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """The records of the archives below ``path``; filters on header columns reach the reader.

    An empty folder gives no rows. An archive that ends within a record, or that doesn't start
    with one, is an error. Of a response's block what follows the HTTP headers is the payload; without
    such headers the whole block is. Archives with several records in a gzip member are read too.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def archive_pages(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives at ``path`` and read every record back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri``. Digest
    and size of a response come from its payload as read, those of a revisit from its headers. A
    null html is an empty payload, a null url an empty target, a null page_id an empty record id,
    which is null again when read; line ends in a url are percent-encoded.
    """
    write_warc(warc_records(mark_revisits(pages, least)), path)
    back = read_warc(pages.sparkSession, path, "digest")

    def number(column: str) -> Column:
        return F.expr(f"try_cast(substring({column}, 11, length({column}) - 11) as bigint)")

    told = F.regexp_replace("payload_digest", "^sha1:", "")
    return back.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.coalesce("computed_digest", told).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
    )
