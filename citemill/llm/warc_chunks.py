"""WARC archives as a table of record chunks.

Writing: each page is a record, and of pages with equal payloads one holds the
payload and the others are revisits of it. A payload over ``CHUNK_BYTES`` is written
in segments, as the format has them: the record itself and ``continuation`` records
that name its id and their number. Rows are (record, chunk) all the way, so that no
record is put together in memory; a page's chunks follow one another in one file.
Archives are gzip files of plain WARC/1.0 records, written by Spark's text sink, so
any store that Spark can write to will do.

Reading: archives come as lines, in order, a file in one task. A parser that holds
one header or one chunk turns them into rows of record id and chunk number. The
digest is carried from chunk to chunk and each row has the digest and the length of
the payload up to its end; a record's last row has those of the whole payload, also
where the payload never was in memory at once. Records of other writers are cut into
chunks the same way, if they are gzip files and their lines are of bounded length.

Null html is empty. Payloads are equal when length and SHA-256 are. Of equal payloads
the row with the smallest page_id is the response (a null page_id is above all; of
rows that repeat a page_id one is). Rows that repeat a page_id are
records of their own. Line ends in a URL are written as %0D and %0A, a null URL is
left out. An empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import delete_on_exit, staged, table, texts, with_place
from citemill.session import scratch_path

CHUNK_BYTES = 1 << 16
REVISIT_BYTES_MIN = 100
HEADER_BYTES_MAX = 1 << 20
# What the format calls things.
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
RECORD_END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

CHUNK_SCHEMA = (
    "record_id string, chunk_no int, record_type string, uri string, page_id long, refers_to string,"
    " declared_digest string, payload binary, payload_bytes long, payload_digest string, last boolean"
)


def records(pages: DataFrame, min_bytes: int = REVISIT_BYTES_MIN) -> DataFrame:
    """page_id, url, body (binary), digest, n_bytes, record_id and refers_to (null for responses) of every row."""
    body = texts(F.col("html")).cast("binary")
    rows = with_place(pages.select("page_id", "url", "html"), "row_place").select(
        F.col("page_id").cast("long"),
        "url",
        "row_place",
        body.alias("body"),
        F.sha2(body, 256).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )
    by = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("row_place").alias("place"))
    copied = staged(
        rows.where(F.col("n_bytes") >= min_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.min(by).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "n_bytes", "first"),
        "copied-payloads",
    )
    # Only payloads that occur more than once are joined; Spark knows the written table's size.
    found = rows.join(copied, ["digest", "n_bytes"], "left")
    is_first = F.col("first").isNull() | (F.col("first.place") == F.col("row_place"))
    return found.select(
        "page_id",
        "url",
        "body",
        "digest",
        "n_bytes",
        _record_id(F.col("page_id"), F.col("row_place")).alias("record_id"),
        F.when(~is_first, _record_id(F.col("first.page_id"), F.col("first.place"))).alias("refers_to"),
    )


def _record_id(page_id: Column, place: Column) -> Column:
    """A record's address, made of what tells its row apart."""
    name = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), place["file"].cast("string"), place["at"].cast("string")))
    parts = [F.substring(name, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record and chunk: chunk_no from 1, n_chunks, chunk (binary); a revisit has one empty chunk."""
    stored = F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b""))
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(stored), F.lit(1)), F.lit(chunk_bytes))
    chunks = F.transform(starts, lambda start: F.substring(stored, start, F.lit(chunk_bytes)))
    kept = [c for c in rows.columns if c != "body"]
    return rows.select(*kept, F.size(starts).alias("n_chunks"), F.posexplode(chunks).alias("position", "chunk")).select(
        *kept, (F.col("position") + 1).alias("chunk_no"), "n_chunks", "chunk"
    )


def _record(chunk: Column) -> Column:
    """The WARC record of a chunk, without the two line ends after it."""

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    first, revisit = F.col("chunk_no") == 1, F.col("refers_to").isNotNull()
    several = F.col("n_chunks") > 1
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    answer = F.when(first, http).otherwise("")
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    own_id = F.when(first, F.col("record_id")).otherwise(
        F.concat(F.regexp_replace("record_id", ">$", "/"), F.col("chunk_no").cast("string"), F.lit(">"))
    )
    total = F.col("n_bytes") + F.length(http)
    head = [
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own_id),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("Content-Type", F.lit(HTTP_TYPE), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), first),
        line("WARC-Profile", F.lit(REVISIT_PROFILE), revisit),
        line("WARC-Refers-To", F.col("refers_to"), revisit),
        line("X-Page-ID", F.col("page_id"), first),
        line("WARC-Segment-Number", F.col("chunk_no"), several),
        line("WARC-Segment-Origin-ID", F.col("record_id"), ~first),
        line("WARC-Segment-Total-Length", total, several & (F.col("chunk_no") == F.col("n_chunks"))),
        line("Content-Length", F.octet_length(answer) + F.octet_length(chunk)),
        F.lit("\r\n"),
        answer,
        # Bytes stay as they are, also where a character is cut.
        chunk.cast("string"),
    ]
    return F.concat(*head)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write all pages as gzip WARC files below ``path``."""
    chunks = record_chunks(records(pages), chunk_bytes)
    chunks.select(_record(F.col("chunk")).alias("value")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip"
    ).text(path)


class ChunkReader:
    """Turns an archive's bytes, fed piece by piece, into rows of ``CHUNK_SCHEMA``.

    What is held: bytes of one unfinished header or chunk, and the digest so far.
    """

    def __init__(self, chunk_bytes: int, payloads: bool):
        self.chunk_bytes, self.payloads = chunk_bytes, payloads
        self.held = bytearray()
        self.left = -1  # bytes of the block still to come; -1 while a header is read
        self.http = False
        self.start: dict | None = None  # header of the record that segments belong to
        self.digest, self.length, self.number = hashlib.sha256(), 0, 0
        self.segment, self.segment_before, self.goes_on = 0, 0, False

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.held += data
        while True:
            if self.left < 0:
                if not self._header():
                    return
            elif self.http:
                end = self.held.find(b"\r\n\r\n", 0, self.left)
                if end < 0 and len(self.held) < self.left:
                    if len(self.held) > HEADER_BYTES_MAX:
                        raise ValueError("an HTTP header without an end")
                    return
                if end >= 0:  # a block without a header end is all payload
                    del self.held[: end + 4]
                    self.left -= end + 4
                self.http = False
            else:
                size = min(self.left, self.chunk_bytes)
                if len(self.held) < size:
                    return
                yield self._chunk(bytes(self.held[:size]), size == self.left)
                del self.held[:size]
                self.left = self.left - size if size < self.left else -1

    def _header(self) -> bool:
        skip = 0
        while self.held[skip : skip + 2] == b"\r\n":
            skip += 2
        del self.held[:skip]
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            if len(self.held) > HEADER_BYTES_MAX or len(self.held) >= 5 and self.held[:5] != b"WARC/":
                raise ValueError("not a WARC record")
            return False
        lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
        del self.held[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        header = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        self.left = int(header["content-length"])
        self.segment = int(header.get("warc-segment-number", 0))
        self.goes_on = self.segment > 0 and "warc-segment-total-length" not in header
        if header["warc-type"] == "continuation":
            origin = self.start and self.start["warc-record-id"]
            if header.get("warc-segment-origin-id") != origin or self.segment != self.segment_before + 1:
                raise ValueError("a segment that does not follow the one before it")
            self.http = False
        else:
            self.start, self.digest, self.length, self.number = header, hashlib.sha256(), 0, 0
            self.http = header.get("content-type", "").startswith("application/http")
        self.segment_before = self.segment
        return True

    def _chunk(self, data: bytes, block_ends: bool) -> tuple:
        self.digest.update(data)
        self.length += len(data)
        self.number += 1
        header = self.start
        page = header.get("x-page-id")
        return (
            header["warc-record-id"],
            self.number,
            header["warc-type"],
            header.get("warc-target-uri"),
            int(page) if page else None,
            header.get("warc-refers-to"),
            header.get("warc-payload-digest"),
            data if self.payloads else None,
            self.length,
            self.digest.hexdigest(),
            block_ends and not self.goes_on,
        )


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives below ``path``; without ``payloads`` that column is null."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "_metadata.file_path", F.col("value").cast("binary")
    )
    names = [part.split()[0] for part in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, None
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            files = batch.column(0).dictionary_encode()
            where = files.indices.to_numpy()
            edges = [0, *((where[1:] != where[:-1]).nonzero()[0] + 1).tolist(), len(where)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                own = files.dictionary[int(where[start])].as_py()
                if own != file:
                    file, reader = own, ChunkReader(chunk_bytes, payloads)
                data = b"\n".join(batch.column(1).slice(start, end - start).to_pylist()) + b"\n"
                rows = list(reader.feed(data))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return lines.mapInArrow(run, CHUNK_SCHEMA)


def resolved(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id).

    A revisit has the length and digest that were read from the record it refers to.
    """
    whole = chunks.where("last").select(
        "record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"
    )
    targets = whole.where("record_type = 'response'").select(
        F.col("record_id").alias("target"),
        F.col("page_id").alias("target_page"),
        F.col("payload_bytes").alias("target_bytes"),
        F.col("payload_digest").alias("target_digest"),
    )
    # Only responses that are referred to are joined.
    used = whole.where("refers_to is not null").select(F.col("refers_to").alias("target")).distinct()
    found = whole.join(targets.join(used, "target", "left_semi"), F.col("refers_to") == F.col("target"), "left")
    return found.select(
        "page_id",
        F.coalesce("target_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("target_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("target_page").alias("refers_to"),
    )


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder, read those back, one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, chunk_bytes)
    delete_on_exit(spark, path)
    slim = read_chunks(spark, path, chunk_bytes, payloads=False).where("last")
    return resolved(staged(slim, "warc-records"))


SQL = f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, min(page_id) AS first_id FROM d WHERE strlen(body) >= {REVISIT_BYTES_MIN} GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN g USING (body)
"""


@register("op13_warc_chunks", SQL)
def op13_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages"))
