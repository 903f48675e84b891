"""Web archives as seekable Zstandard bundles.

``write`` makes one WARC record of each page and packs the records of a task into bundles.  A bundle is a
sequence of independent Zstandard frames of about ``FRAME_BYTES`` of records, the first of which holds the
warcinfo record, and ends with the seek table of the Zstandard seekable format (a skippable frame with the
two sizes of every frame and a footer), so any frame is found from the end of the file and read alone.
Other Zstandard readers skip the table and see one stream of WARC records.

Equal payloads of at least ``MIN_REVISIT_BYTES`` are stored once: the page with the largest id is a
response record, the others are revisit records that refer to it.  Groups of equal payloads are found by
an aggregate over their digests and a join back, which Spark splits where one payload is frequent.

Files are written by Spark's own committed writer: a bundle is a row, a row is a file, and the last byte
of the footer (always 0x8F) serves as the line end.  That works on every file system Spark can write to
and leaves no file of a failed or repeated task.  ``read`` gets the bundles with the binary-file source.
``index`` maps record ids to (bundle, frame, start of the frame, offset in the frame); ``fetch`` decompresses
only the frames that hold the wanted ids, of bundles that are read whole.

Defined results: null html is an empty payload.  Smaller payloads and single ones are responses.  Rows
that repeat the largest id of a group are all responses; a row without an id is a revisit of the largest
id if there is one, else a response.  Other columns are not read.
"""
from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from touchline.llm.common import arrow, shared_folder, small_batches

MIN_REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Fixed date: an archive of the same pages has the same bytes.
DATE = "1970-01-01T00:00:00Z"


def record_schema(id_kind: str = "bigint") -> str:
    return (f"page_id {id_kind}, payload_bytes long, payload_digest string, record_type string, refers_to {id_kind}, url string, payload binary, "
            "frame int, frame_at long, offset long, length long")


NO_NAME, NAME = "<urn:x-no-page>", "<urn:x-page:"


def record_name(page_id: int | str | None) -> str:
    return NO_NAME if page_id is None else f"{NAME}{quote(str(page_id), safe='')}>"


def id_of(name: str | None) -> str | None:
    return unquote(name[len(NAME):-1]) if name and name.startswith(NAME) else None


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:info>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (DATE.encode(), len(block), block)


class Bundle:
    """Frames under construction."""

    def __init__(self):
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.size = 0
        self.open = bytearray(info())
        self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(bytes(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def add(self, data: bytes) -> None:
        self.open += data
        if len(self.open) >= FRAME_BYTES:
            self.close_frame()

    def done(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the end of a bundle."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("not a seekable bundle of this kind")
    entries, at, out = tail[-9 - 8 * count:-9], 0, []
    for packed, size in struct.iter_unpack("<II", entries):
        out.append((at, packed, size))
        at += packed
    return out


def records_of(frame: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header, block, offset, length) of every record in an uncompressed frame."""
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        lines = frame[at:body - 4].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("broken record")
        header = dict(line.split(": ", 1) for line in lines[1:])
        end = body + int(header["Content-Length"])
        yield header, frame[body:end], at, end + 4 - at
        at = end + 4


def classed(pages: DataFrame) -> DataFrame:
    """page_id, url, _payload, _digest and refers_to of every row."""
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("_payload"))
    source = source.withColumns({"_digest": F.sha1("_payload"), "_bytes": F.octet_length("_payload")})
    groups = (source.where(F.col("_bytes") >= MIN_REVISIT_BYTES).groupBy(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"))
              .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    joined = source.join(groups, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left")
    return joined.select("page_id", "url", "_payload", "_digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, path: str) -> None:
    """Bundles of all pages under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in small_batches(batches):
            for page_id, url, payload, digest, refers_to in zip(*(c for c in batch.columns)):
                bundle = bundle or Bundle()
                bundle.add(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                if bundle.size >= BUNDLE_BYTES:
                    yield arrow(["bundle"], [pa.array([bundle.done()[:-1]], pa.binary())])
                    bundle = None
        if bundle is not None:
            yield arrow(["bundle"], [pa.array([bundle.done()[:-1]], pa.binary())])

    packed = classed(pages).mapInArrow(run, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", "\u008f").option("maxRecordsPerFile", 1).text(path)


def parse(header: dict[str, str], block: bytes) -> tuple:
    http, payload = block.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind, named = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(fields["Content-Length"]) or hashlib.sha1(payload).hexdigest() != named):
        raise ValueError(f"record {header['WARC-Record-ID']} does not hold its payload")
    return (id_of(header["WARC-Record-ID"]), int(fields["Content-Length"]), named, kind, id_of(header.get("WARC-Refers-To")), header.get("WARC-Target-URI"), payload)


def _read(found: DataFrame, wanted: bool, with_payload: bool, id_kind: str) -> DataFrame:
    """Records of the bundles in ``found`` (path, content, and if ``wanted`` an array of (frame, offset))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                only = {(w["frame"], w["offset"]) for w in batch.column(2)[i].as_py()} if wanted else None
                for k, (at, packed, size) in enumerate(seek_table(content)):
                    if only is not None and not any(f == k for f, _ in only):
                        continue
                    frame = zstandard.ZstdDecompressor().decompress(content[at:at + packed], max_output_size=size)
                    rows = [(path, *parse(header, block), k, at, offset, length) for header, block, offset, length in records_of(frame)
                            if header["WARC-Type"] != "warcinfo" and (only is None or (k, offset) in only)]
                    if rows:
                        columns = [list(c) for c in zip(*rows)]
                        if id_kind != "string":
                            columns[1], columns[5] = ([None if v is None else int(v) for v in columns[c]] for c in (1, 5))
                        if not with_payload:
                            columns[7] = [None] * len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = StructType.fromDDL(f"bundle string, {record_schema(id_kind)}")
    kinds, names = to_arrow_schema(schema).types, schema.names
    return found.mapInArrow(run, schema)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read(spark: SparkSession, path: str, with_payload: bool = True, id_kind: str = "bigint") -> DataFrame:
    """All records under ``path``; responses are checked against their digests.  ``id_kind`` is the type of the page ids (a whole number or string)."""
    return _read(bundles(spark, path), False, with_payload, id_kind)


def index(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """page_id, bundle, frame, frame_at (first byte of the frame), offset (in the frame) and length of every record."""
    return read(spark, path, False, id_kind).select("page_id", "bundle", "frame", "frame_at", "offset", "length")


def fetch(spark: SparkSession, path: str, places: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """The records at ``places`` (rows of the index); only their frames are decompressed."""
    wanted = places.groupBy(F.col("bundle").alias("path")).agg(F.collect_set(F.struct("frame", "offset")).alias("wanted"))
    return _read(bundles(spark, path).join(wanted, "path").select("path", "content", "wanted"), True, True, id_kind)


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder, read the archives back and return a row for each record."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write(pages, path)
    return read(spark, path, False, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "frame", "offset", "length")
