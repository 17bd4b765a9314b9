"""WARC writing with deduplicated payloads, and a normaliser for monolithic gzip archives.

Pages become WARC records in archives of bounded size, each compressed as one gzip stream. The normaliser
inflates such a stream once, cuts it at record boundaries, writes every record as a gzip member of its
own, and lists (record, offset, length) in a sidecar index; a reader then opens one member per record.
Archives are rows of a Parquet table in the shared folder, so that any store Spark reaches can hold them
and a lost executor loses nothing; ``normalize_file`` does the same for a file.

Cases: null html is an empty payload; a null page_id is written as an empty id; repeated rows are written
each, and of equal payloads with equal largest ids every row with that id is a response; extra columns are ignored; an empty
table gives no archive and no rows; a page larger than the bound fills an archive alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Bytes of records in an archive; bytes inflated at a time; payloads shorter than this are never revisits.
ARCHIVE, BLOCK, LEAST = 4 << 20, 1 << 16, 1000
_DATE = "2020-01-01T00:00:00Z"


# -- records --------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit that names the response that holds it."""
    ident = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class RecordCutter:
    """Cuts inflated bytes at record boundaries, holding one record at most."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), -1

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if self.need < 0:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                length = next(int(x.split(b":")[1]) for x in bytes(self.held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                self.need = end + 4 + length + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = -1

    def close(self) -> None:
        if self.held.strip():
            raise ValueError("the archive ends inside a record")


# -- the normaliser -------------------------------------------------------------------------------


def member(raw: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, read once, in bounded blocks."""
    un = zlib.decompressobj(31)
    while data := read(BLOCK):
        while data:
            yield un.decompress(data, BLOCK)
            while un.unconsumed_tail:
                yield un.decompress(un.unconsumed_tail, BLOCK)
            data = un.unused_data
            if un.eof:
                un = zlib.decompressobj(31)
    yield un.flush()


def normalize(read: Callable[[int], bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """(gzip member, headers) of each record of a whole-file gzip stream."""
    cutter = RecordCutter()
    for data in inflate(read):
        for raw in cutter.feed(data):
            yield member(raw), parse(raw)[0]
    cutter.close()


def normalize_file(source: str, target: str) -> int:
    """Rewrite a gzip archive with a member per record; the index goes to ``target + '.idx'`` (id, offset, length)."""
    n = at = 0
    with open(source, "rb") as f, open(target, "wb") as out, open(target + ".idx", "w", encoding="utf-8") as index:
        for data, head in normalize(f.read):
            out.write(data)
            index.write(f"{head['WARC-Record-ID']}\t{at}\t{len(data)}\n")
            at, n = at + len(data), n + 1
    return n


# -- the operator ---------------------------------------------------------------------------------

ARCHIVES = "archive_id long, data binary"
NORMAL = "archive_id long, data binary, ids array<string>, offsets array<long>, lengths array<long>"


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit): which rows are revisits, and of which page.

    Only digests are grouped; the payloads are read again and never shuffled by digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = rows.select("page_id", "digest", "bytes").where(F.col("bytes") >= least).join(large, ["digest", "bytes"]).where(F.col("page_id") < F.col("last"))
    revisits = revisits.groupBy(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest")).agg(F.max("last").alias("refers_to"))
    on = (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return rows.join(revisits, on, "left").select("page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, limit: int = ARCHIVE) -> DataFrame:
    """Archives as single gzip streams of at most about ``limit`` bytes of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        pack, out, size = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0

        def close():
            nonlocal n, pack, out, size
            data = b"".join([*out, pack.flush()])
            n, pack, out, size = n + 1, zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
            return pa.RecordBatch.from_arrays([pa.array([base + n - 1], pa.int64()), pa.array([data], pa.binary())], names=["archive_id", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, refers, revisit = (batch.column(k)[i].as_py() for k in range(6))
                raw = record(page, url, html.encode(), digest, refers, revisit)
                if size and size + len(raw) > limit:
                    yield close()
                out.append(pack.compress(raw))
                size += len(raw)
        if size:
            yield close()

    return materialize(pages.mapInArrow(run, ARCHIVES), "archives")


def normalize_archives(archives: DataFrame) -> DataFrame:
    """Every archive with a gzip member per record, and its sidecar index as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for i in range(batch.num_rows):
                out, ids, offsets, lengths, at = [], [], [], [], 0
                for data, head in normalize(io.BytesIO(batch.column(1)[i].as_py()).read):
                    out.append(data)
                    ids.append(head["WARC-Record-ID"])
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([b"".join(out)], pa.binary()), pa.array([ids], pa.list_(pa.string())), pa.array([offsets], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))],
                    names=["archive_id", "data", "ids", "offsets", "lengths"],
                )

    return materialize(archives.mapInArrow(run, NORMAL), "members")


RECORDS = "archive_id long, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, content binary"


def read_archives(members: DataFrame, content: bool = True) -> DataFrame:
    """The records of normalised archives, each inflated from its own member; a response's digest is checked."""

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive, data, _, offsets, lengths = (batch.column(k)[i].as_py() for k in range(5))
                rows = []
                for at, size in zip(offsets, lengths, strict=True):
                    head, body = parse(zlib.decompress(data[at : at + size], 31))
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                    rows.append((archive, at, number(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, int(head["WARC-Payload-Length"]), digest, number(head["WARC-Refers-To"]) if kind == "revisit" else None, body if content else None))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    return members.mapInArrow(run, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = normalize_archives(write_archives(decided(table(spark, sf_dir, "pages"))))
    return read_archives(members, content=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages
), q AS (
  SELECT page_id, b, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
"""
