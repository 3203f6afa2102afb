"""WARC archives written and read by Spark, payloads as a table of chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.storage import lookup, materialize

# --- fixed values of the format ---
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_PREFIX = "urn:x-record:"

MIN_REVISIT_BYTES = 1000
CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096

CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk_no int, is_last boolean, "
    "chunk_bytes int, payload_bytes long, running_sha1 string, header_digest string, header_bytes long, data binary"
)


def revisit_plan(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", uri_col: str = "url", min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """Columns page_id, uri, html, digest, n_bytes, refers_to (NULL for a response), one row per page.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the
    response. Pages without id are passed over in that choice; they, and rows repeating the chosen id,
    are responses if no other id was chosen. A NULL payload is empty.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).cast("string").alias("uri"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "n_bytes": F.octet_length("html").cast("long")})
    groups = (
        rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)
    )
    joined = lookup(rows, materialize(groups, "repeated_payloads"), ["digest"], "n_rows", "page_id")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("response_id"), F.col("response_id"))).drop("response_id")


def _record_uri(record_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_PREFIX}"), F.url_encode(F.coalesce(record_id.cast("string"), F.lit(""))), F.lit(">"))


def _segment_start(number: Column, segment_bytes: int) -> Column:
    """Bytes of the payload before segment ``number``: a multiple of the segment size, moved on to the next whole character."""
    at = (number - 1) * segment_bytes
    rest = F.regexp_extract(F.hex(F.substring(F.col("html").cast("binary"), at + 1, F.lit(3))), "^((?:[89AB][0-9A-F])*)", 1)
    return F.when(number <= 1, F.lit(0)).otherwise(at + (F.length(rest) / 2).cast("int"))


def write_archives(plan: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES) -> None:
    """One gzipped archive per partition of ``plan`` (columns of ``revisit_plan``), a record per row.

    Responses carry a short HTTP head and the payload; revisits carry the digest and size of the payload
    they stand for, and the record they refer to. Line ends within a target URI are percent-encoded.
    The archives are byte-exact: a record is cut at its line feeds and the text writer puts them back.

    A payload of more than ``segment_bytes`` (at least 4) is a chain of records, as the format has it for oversized ones: the
    first is the response, continuations follow it in the same archive. So no line of an archive is much
    longer than a segment, also where a payload has no line feeds, and no reader meets it as one value.
    """
    if segment_bytes < 4:
        raise ValueError("a segment holds at least 4 bytes")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    uri = F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    n_segments = F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / segment_bytes).cast("int")))
    rows = plan.withColumn("n_segments", n_segments).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("n_segments"))))
    segment, last = F.col("segment"), F.col("segment") == F.col("n_segments")
    start = _segment_start(segment, segment_bytes)
    stop = F.when(last, F.col("n_bytes").cast("int")).otherwise(_segment_start(segment + 1, segment_bytes))
    payload = F.when(F.col("n_segments") == 1, F.col("html")).otherwise(F.substring(F.col("html").cast("binary"), start + 1, stop - start).cast("string"))
    block = F.when(revisit, F.lit("")).when(segment == 1, F.concat(http, payload)).otherwise(payload)
    first = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _record_uri(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("n_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), _record_uri(F.col("refers_to")))).otherwise(
            F.lit("\r\nContent-Type: application/http; msgtype=response")
        ),
        F.when(F.col("n_segments") > 1, F.lit("\r\nWARC-Segment-Number: 1")).otherwise(F.lit("")),
    )
    further = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: continuation\r\nWARC-Record-ID: <{RECORD_PREFIX}"),
        F.concat_ws(":segment:", F.url_encode(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), segment.cast("string")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Segment-Origin-ID: "), _record_uri(F.col("page_id")),
        F.lit("\r\nWARC-Segment-Number: "), segment.cast("string"),
        F.when(last, F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), (F.octet_length(http) + F.col("n_bytes")).cast("string"))).otherwise(F.lit("")),
    )
    head = F.concat(F.when(segment == 1, first).otherwise(further), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    # The last line feed of the record is the one the writer adds after the last line.
    lines = rows.select(F.explode(F.split(F.concat(head, block, F.lit("\r\n\r")), "\n", -1)).alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The archives as a chunk table: (record_id, chunk_no) with at most ``chunk_bytes`` of payload per row.

    ``running_sha1`` and ``payload_bytes`` cover the payload up to and including the chunk, so the last
    chunk has those of the whole record and no reader needs to put a record together. A record without
    payload has one empty chunk. Gzipped archives are read from start to end, a file per task; a record
    cut short by the end of its file is an error, and so is a segment apart from its chain. A chain of
    segments is one record here. ``with_data=False`` leaves the bytes out. Of the payload a task holds one
    chunk and the line that it reads; archives of other writers may have lines longer than a segment.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(with_data)
        parser = _Parser(chunk_bytes, out)
        current = None
        for batch in batches:
            for file, start, stop in _files(batch.column("file")):
                if file != current:
                    parser.end_of_file(current)
                    current = file
                for line in batch.column("line").slice(start, stop - start).to_pylist():
                    parser.feed(line)
                    if out.full():
                        yield out.take()
        parser.end_of_file(current)
        yield out.take()

    return lines.mapInArrow(parse, CHUNKS)


def _files(column: pa.Array) -> Iterator[tuple[str, int, int]]:
    """Runs of equal file names within a batch."""
    runs = column.dictionary_encode()
    codes = runs.indices.to_pylist()
    start = 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[start]:
            yield runs.dictionary[codes[start]].as_py(), start, i
            start = i


class _Batches:
    """Chunk rows waiting to go out, bounded by rows and bytes."""

    def __init__(self, with_data: bool):
        self.with_data, self.rows, self.bytes = with_data, [], 0

    def add(self, row: tuple, data: bytes) -> None:
        self.rows.append((*row, data if self.with_data else None))
        self.bytes += len(data) if self.with_data else 0

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES or len(self.rows) >= BATCH_ROWS

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in CHUNKS.split(", ")]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class _Parser:
    """Follows the lines of an archive; holds at most one chunk of payload. A chain of segments is one record."""

    def __init__(self, chunk_bytes: int, out: _Batches):
        self.chunk_bytes, self.out = chunk_bytes, out
        self.state, self.head, self.record, self.open = "between", {}, {}, False
        self.within, self.number_of_segment = "payload", 0

    def end_of_file(self, file: str | None) -> None:
        if self.state != "between" or self.open:
            raise ValueError(f"a record is cut short at the end of {file}")

    def feed(self, line: bytes) -> None:
        if self.state == "payload" or self.state == "http":
            self._block(line)
        elif self.state == "header":
            self._header(line)
        elif line.startswith(b"WARC/"):
            self.state, self.head = "header", {}
        elif line.strip():
            raise ValueError("bytes between two records")

    def _header(self, line: bytes) -> None:
        name, _, value = line.rstrip(b"\r").partition(b":")
        if name:
            self.head[name.strip().lower().decode()] = value.strip().decode()
            return
        self.left = int(self.head["content-length"])
        if self.head.get("warc-type") == "continuation":
            self.number_of_segment += 1
            if not self.open or (self.head.get("warc-segment-origin-id"), self.head.get("warc-segment-number")) != (self.record.get("warc-record-id"), str(self.number_of_segment)):
                raise ValueError("a segment does not follow the one before it")
            self.open = "warc-segment-total-length" not in self.head
            self.state = self.within
        else:
            if self.open:
                raise ValueError("the last segment of a record is missing")
            self.record, self.number_of_segment = self.head, 1
            self.open = self.head.get("warc-segment-number") == "1" and "warc-segment-total-length" not in self.head
            self.chunk, self.number, self.total, self.sha = bytearray(), 0, 0, hashlib.sha1()
            self.state = "http" if self.head.get("content-type", "").startswith("application/http") else "payload"
        if not self.left:
            self._finish()

    def _block(self, line: bytes) -> None:
        piece = line + b"\n" if len(line) < self.left else line[: self.left]
        self.left -= len(piece)
        if self.state == "http":
            self.state = "payload" if not piece.strip() else "http"
        else:
            self._payload(piece)
        if not self.left:
            self._finish()

    def _payload(self, piece: bytes) -> None:
        view = memoryview(piece)
        while len(self.chunk) + len(view) > self.chunk_bytes:
            room = self.chunk_bytes - len(self.chunk)
            self.chunk += view[:room]
            view = view[room:]
            self._emit(False)
        self.chunk += view

    def _emit(self, last: bool) -> None:
        self.sha.update(self.chunk)
        self.total += len(self.chunk)
        get = self.record.get
        declared = get("x-payload-length")
        row = (
            _record_name(get("warc-record-id")), get("warc-type"), get("warc-target-uri"), _record_name(get("warc-refers-to")), self.number, last,
            len(self.chunk), self.total, self.sha.hexdigest(), (get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            int(declared) if declared is not None else None,
        )
        self.out.add(row, bytes(self.chunk) if self.out.with_data else b"")
        self.chunk, self.number = bytearray(), self.number + 1

    def _finish(self) -> None:
        if not self.open:
            self._emit(True)
        self.within, self.state = self.state, "between"


def _record_name(uri: str | None) -> str | None:
    bare = (uri or "").strip("<>")
    return unquote(bare.removeprefix(RECORD_PREFIX).replace("+", " ")) or None if bare.startswith(RECORD_PREFIX) else bare or None


def record_ends(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: size and digest of the payload it stands for.

    A response has them from its own bytes, a revisit from its header.
    """
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("is_last").select(
        "record_id", "record_type", "target_uri", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"),
        F.when(revisit, F.col("header_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("running_sha1")).alias("payload_digest"), "header_digest",
    )
