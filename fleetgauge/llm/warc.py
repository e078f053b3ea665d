"""WARC archives: one gzip member per record, written by tasks and read in byte ranges.

A file of members needs no index to be split: a task looks for the gzip magic in its range of
bytes, takes a place for the start of a member only if it decodes to a WARC header, follows the
members from there, and owns the records that start inside its range.

Files are opened with pyarrow's file systems (local or shared folders, HDFS, S3, GCS), by the path
that Spark uses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fleetgauge.llm.common import apart

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that one task reads.
RANGE_BYTES = 32 << 20
#: Payloads under this size are always written whole.
MIN_REVISIT_BYTES = 1000
_BLOCK = 1 << 20
#: A longer record header is no header.
_HEADER_LIMIT = 1 << 20
_MANIFEST = "_records.json"
_FIELDS = (
    "record_id string, record_type string, target_uri string, payload binary, "
    "payload_bytes bigint, payload_digest string, refers_to string"
)
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _one_line(value: str) -> str:
    """Header values hold no control characters: they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(record_id: str, record_type: str, target_uri: str | None, payload: bytes | None,
                  payload_bytes: int, payload_digest: str, refers_to: str | None) -> bytes:
    """A gzip member with one record: an HTTP response, or without payload a revisit of one."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block += payload or b""
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{_one_line(record_id)}>"), ("WARC-Date", DATE)]
    if target_uri is not None:
        fields.append(("WARC-Target-URI", _one_line(target_uri)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(payload_digest)).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_one_line(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name; later lines of a folded value are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of the record header at the start of `data`; None if it is none, or not whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    fields = _fields(data[:end])
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
        return None
    return fields, end + 4


class Members:
    """Members of one file, decoded where they are asked for, over a buffer of a few blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, pos: int) -> bytes:
        """Up to a block of bytes from `pos` on."""
        if not self.base <= pos < self.base + len(self.held):
            self.base, self.held = pos, self.file.read_at(min(_BLOCK, self.size - pos), pos) if pos < self.size else b""
        return self.held[pos - self.base :]

    def decode(self, pos: int, only_header: bool = False) -> tuple[bytes, int]:
        """Content of the member at `pos` and the position after it; as far as the record header if asked. ValueError if it is none."""
        inflate, parts, held = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            data = self.at(pos)
            if not data:
                raise ValueError("the file ends within a member")
            if only_header:
                data = data[:4096]
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from None
            pos += len(data) - len(inflate.unused_data)
            held += len(parts[-1])
            if only_header:
                content = b"".join(parts)
                if not content.startswith(b"WARC/"[: len(content)]) or held > _HEADER_LIMIT and _header(content) is None:
                    raise ValueError("no record header")
                if _header(content) is not None:
                    return content, pos
        return b"".join(parts), pos

    def record(self, pos: int) -> tuple[dict[str, str], bytes, int]:
        """Header fields and block of the record at `pos`, and the position of the next."""
        content, after = self.decode(pos)
        found = _header(content)
        if found is None:
            raise ValueError("no record header")
        fields, start = found
        end = start + int(fields["content-length"])
        if content[end:] != b"\r\n\r\n":
            raise ValueError("a member must hold exactly one record")
        return fields, content[start:end], after

    def candidates(self, begin: int, end: int) -> Iterator[int]:
        """Places of the gzip magic that start in [begin, end)."""
        pos = begin
        while pos < end:
            data = self.file.read_at(min(_BLOCK + 2, self.size - pos), pos)
            at = data.find(MAGIC)
            while 0 <= at < min(_BLOCK, end - pos):
                yield pos + at
                at = data.find(MAGIC, at + 1)
            pos += _BLOCK

    def _is_start(self, pos: int) -> bool:
        try:
            return _header(self.decode(pos, only_header=True)[0]) is not None
        except ValueError:
            return False

    def _unbroken(self, pos: int, end: int) -> bool:
        """Records follow one another from `pos` to the end of the range."""
        try:
            while pos < min(end, self.size):
                pos = self.record(pos)[2]
        except ValueError:
            return False
        return True

    def records(self, begin: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """Records that start in [begin, end).

        The first valid candidate from which whole records follow one another counts: the magic, or
        even a member, may occur in the data of a record. If there are candidates but none of these
        is such, they lie within a record or the file is damaged: then the records are followed
        from the beginning of the file, and the damage, if it is one, is an error.
        """
        start, doubt = 0 if begin == 0 else None, False
        for pos in self.candidates(begin, end) if begin else ():
            if self._is_start(pos):
                if self._unbroken(pos, end):
                    start = pos
                    break
                doubt = True
        if start is None and not doubt:
            return
        pos = start or 0
        while pos < min(end, self.size):
            fields, block, after = self.record(pos)
            if pos >= begin:
                yield pos, fields, block
            pos = after


def _result(fields: dict[str, str], block: bytes, verify: bool) -> tuple:
    """Values of _FIELDS for one record."""
    kind = fields["warc-type"]
    payload, length = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            payload = b""
        length = len(payload)
        if kind == "revisit":
            length = int(_fields(head).get("content-length", 0))
    digest = fields.get("warc-payload-digest", "")
    told = None
    if digest.lower().startswith("sha1:"):
        value = digest[5:]
        told = value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()
    if kind == "revisit":
        payload = None
    else:
        own = hashlib.sha1(payload).hexdigest() if verify or told is None else told
        if told is not None and told != own:
            raise ValueError(f"record {fields['warc-record-id']}: payload differs from its digest")
        told = own
    refers = fields.get("warc-refers-to")
    return (
        fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), payload,
        length, told, refers.strip("<>") if refers else None,
    )


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.verify = options.get("verify", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _open(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = [x for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name.endswith(".warc.gz")]
            if store.get_file_info(f"{path}/{_MANIFEST}").type == fs.FileType.File:
                with store.open_input_stream(f"{path}/{_MANIFEST}") as f:
                    names = set(json.loads(f.read()))
                found = [x for x in found if x.base_name in names]
        return [
            Range(x.path, x.size, a, min(a + self.range, x.size))
            for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.range)
        ]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("file", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
        ])
        if partition is None:
            return
        store, _ = _open(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as file:
            for pos, fields, block in Members(file, partition.size).records(partition.begin, partition.end):
                rows.append((partition.path, pos, *_result(fields, block, self.verify)))
                held += len(block) + 200
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """One file per task and attempt; only the files of the attempts that count enter the manifest."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in iterator:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(encode_record(*row))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list) -> None:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{_MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder or file), df.write.format("warc").mode("append").save(new folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "file string, at bigint, " + _FIELDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write_records(records: DataFrame, path: str) -> None:
    """Write the columns of _FIELDS to a new folder; payload null means a record without payload."""
    records.sparkSession.dataSource.register(WarcDataSource)
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    records.select(*names).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, verify: bool = True) -> DataFrame:
    """Records of a folder of .warc.gz files or of one file: file, at (position) and the columns of _FIELDS.

    Every file must have one record per gzip member. payload is null for revisits, whose
    payload_bytes and payload_digest are those of the payload they stand for. With `verify`
    a payload that differs from its digest is an error, as is a damaged file; a truncated
    file is never read as if it were whole. An empty folder gives no rows.
    """
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(rangebytes=range_bytes, verify=str(verify).lower()).load(path)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A record (columns of _FIELDS) per page, with the UTF-8 body as payload; null is empty.

    Of pages with equal payloads of at least `min_revisit_bytes` bytes the one with the largest key
    is the response, the others revisit it; smaller payloads are responses always. Pages that repeat
    the largest key are responses all. A page without a key is a response with the record id urn:page: .
    Equal payloads are told by SHA-1 and length. Payloads are shuffled once, by key; what is
    joined on the digest, which a third of all pages may share, is (key, digest) only.
    """
    one = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").cast("string").alias("u"), F.encode(F.coalesce(F.col(f"`{body}`"), F.lit("")), "UTF-8").alias("p"))
    one = one.withColumn("n", F.octet_length("p").cast("bigint")).withColumn("d", F.sha1("p"))
    facts = one.where((F.col("n") >= min_revisit_bytes) & F.col("k").isNotNull()).select("k", "n", "d")
    largest = facts.groupBy("d", "n").agg(F.max("k").alias("to"), F.min("k").alias("least")).where(F.col("to") != F.col("least")).drop("least")
    revisits = facts.join(apart(largest, "n"), ["d", "n"]).where(F.col("k") != F.col("to")).select("k", "d", "to").distinct()
    both = one.join(revisits.toDF("rk", "rd", "to"), (F.col("k") == F.col("rk")) & (F.col("d") == F.col("rd")), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    whole = F.col("to").isNull()
    return both.select(
        name(F.col("k")).alias("record_id"), F.when(whole, "response").otherwise("revisit").alias("record_type"),
        F.col("u").alias("target_uri"), F.when(whole, F.col("p")).alias("payload"), F.col("n").alias("payload_bytes"),
        F.col("d").alias("payload_digest"), F.when(~whole, name(F.col("to"))).alias("refers_to"),
    )
