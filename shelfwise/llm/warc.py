"""WARC archives as a PySpark data source, for reading and writing.

Reading plans one partition per stretch of a file. A record's header block comes
first; predicates on header fields are decided on it, and the payload of a
record that fails is skipped over without being decoded.

Archives are plain ``.warc`` files whose payloads are gzip-encoded HTTP bodies,
so a reader can jump from record to record. ``.warc.gz`` files of other origin
are read as one stream each.

The payload of a request or response is its decoded HTTP body, that of other kinds
their block as it is; a revisit has none. Writing to an archive again adds records.

Defined results: a null payload is an empty one; a null url or id leaves its
header out and comes back as null; an empty table gives an archive without
records; repeated rows are records of their own; control characters of a url
are percent-encoded in the header and stay so.
"""

import json
import operator
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from shelfwise.llm.common import small_batches
from shelfwise.session import new_path

SCHEMA = (
    "record_type string, page_id bigint, target_uri string, payload_digest string, payload_bytes bigint, "
    "refers_to bigint, payload binary"
)
ARROW = pa.schema([
    ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
    ("payload", pa.binary()),
])
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the tables hold no time of capture
MANIFEST = "manifest"

_FIELDS = {
    "WARC-Type": ("record_type", str), "WARC-Target-URI": ("target_uri", str),
    "WARC-Payload-Digest": ("payload_digest", lambda v: v.removeprefix("sha256:")),
    "X-Page-Id": ("page_id", int), "X-Payload-Length": ("payload_bytes", int), "X-Refers-To-Page": ("refers_to", int),
}
_COMPARE = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt, LessThanOrEqual: operator.le,
}


def _file_system(path: str):
    return pafs.FileSystem.from_uri(path)


def _header_safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(row: dict) -> bytes:
    """One record: header block, then the HTTP block with the encoded payload, or none for a revisit."""
    revisit = row["record_type"] == "revisit"
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    body = b""
    if not revisit:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        body = packer.compress(row["payload"] or b"") + packer.flush()
        http += [b"Content-Encoding: gzip", b"Content-Length: %d" % len(body)]
    block = b"\r\n".join(http) + b"\r\n\r\n" + body
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_header_safe(row['target_uri'])}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return zlib.decompress(body, 47) if b"content-encoding: gzip" in head.lower() else body


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end of a stream that can't be cut


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list
    size: int


class WarcWriter(DataSourceArrowWriter):
    """A file per task under a fresh name; only files that a job committed are in a manifest, one for each job."""

    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def write(self, iterator):
        fs, root = _file_system(self.path)
        name, at, starts = f"{uuid.uuid4().hex}.warc", 0, []
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for row in batch.select([c for c in ARROW.names]).to_pylist():
                    if not starts or at - starts[-1] >= self.split_bytes:
                        starts.append(at)
                    record = record_bytes(row)
                    out.write(record)
                    at += len(record)
        return Written(name, starts, at)

    def commit(self, messages):
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"name": m.name, "starts": m.starts, "size": m.size} for m in messages if m is not None and m.size]
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        """Files of a failed job stay out of the manifest and are never read."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        fields = {name for name, _ in _FIELDS.values()}
        for f in filters:
            name = getattr(f, "attribute", (None,))
            known = len(name) == 1 and name[0] in fields
            if known and (type(f) in _COMPARE or isinstance(f, (In, IsNull, IsNotNull))):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for f in self.tests:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                good = value is None
            elif isinstance(f, IsNotNull):
                good = value is not None
            elif isinstance(f, In):
                good = value in f.value if value is not None else False
            else:
                good = value is not None and _COMPARE[type(f)](value, f.value)
            if not good:
                return False
        return True

    def partitions(self):
        fs, root = _file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        manifests = sorted(x.path for x in found if re.search(rf"/{MANIFEST}-[0-9a-f]+[.]json$", x.path))
        if manifests:
            files = []
            for path in manifests:
                with fs.open_input_stream(path) as f:
                    files += json.loads(f.read())
            return [
                Stretch(f"{root}/{x['name']}", a, b)
                for x in files for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]])
            ] or [Stretch("", 0, 0)]
        return [
            Stretch(x.path, 0, x.size if x.path.endswith(".warc") else None)
            for x in found if x.path.endswith((".warc", ".warc.gz"))
        ] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch):
        if not partition.path:
            return
        fs, _ = _file_system(self.path)
        rows, held = [], 0
        for row in self._records(fs, partition):
            rows.append(row)
            held += len(row["payload"] or b"") + 200
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _records(self, fs, part: Stretch):
        if part.end is None:
            source = pa.BufferedInputStream(fs.open_input_stream(part.path, compression="gzip"), 1 << 16)
            skip = source.read
        else:
            source = fs.open_input_file(part.path)
            source.seek(part.start)
            skip = None
        ahead, at = b"", part.start
        while part.end is None or at < part.end:
            head = ahead
            while b"\r\n\r\n" not in head:
                more = source.read(4096)
                if not more:
                    return
                head += more
            head, _, ahead = head.partition(b"\r\n\r\n")
            row, length, http = self._header(head)
            size = len(head) + 4 + length + 4  # a record ends with two line ends
            wanted = self._wanted(row)
            if wanted and row["record_type"] != "revisit":
                block = ahead[:length] if len(ahead) >= length else ahead + source.read(length - len(ahead))
                row["payload"] = decoded(block) if http else block
                rest = length + 4 - max(len(ahead), length)
                if len(ahead) >= length + 4:
                    ahead = ahead[length + 4 :]
                else:
                    source.read(rest)
                    ahead = b""
            elif len(ahead) >= length + 4:
                ahead = ahead[length + 4 :]
            else:
                left = length + 4 - len(ahead)
                ahead = b""
                if skip is None:
                    source.seek(at + size)
                else:
                    skip(left)
            at += size
            if wanted:
                yield row

    @staticmethod
    def _header(head: bytes):
        row, length, http = dict.fromkeys(ARROW.names), 0, False
        for line in head.decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(": ")
            if name in _FIELDS:
                column, kind = _FIELDS[name]
                row[column] = kind(value)
            elif name == "Content-Length":
                length = int(value)
            elif name == "Content-Type":
                http = value.startswith("application/http")
        return row, length, http


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """A record per row of ``page_id, url, html``.

    Of equal payloads of ``least_bytes`` or more, the rows with the smallest
    page_id are responses and the others revisit it. A null page_id counts as
    larger than any; where all of a group are null, all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"),
        F.length(payload).cast("bigint").alias("payload_bytes"),
    )
    same = (
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    joined = rows.join(same, "payload_digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri",
        "payload_digest", "payload_bytes", F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(rows: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Write records (the columns of ``SCHEMA``) as WARC files under ``path``."""
    register(rows.sparkSession)
    with small_batches(rows.sparkSession):
        rows.write.format("warc").option("split_bytes", str(split_bytes)).mode("append").save(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").load(path)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder and read it back.

    Responses are measured on their decoded payloads; of revisits only headers are read.
    """
    path = new_path(spark, "warc")
    write_archive(records(pages), path)
    # one reader each: a reader keeps the predicates that were pushed into it
    responses = read_archive(spark, path).where("record_type = 'response'").select(
        "page_id", F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to",
    )
    revisits = read_archive(spark, path).where("record_type = 'revisit'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    return responses.unionByName(revisits)
