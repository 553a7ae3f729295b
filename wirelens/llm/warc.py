"""WARC archives: writing with revisits and segments, and reading back with segment reassembly.

Writing. A page is an HTTP response with a chunked body. A block longer than
``segment_bytes`` becomes a first segment and continuation records that name
the first record's id and their segment number; the last one carries the total
length. Archives are written by Spark's text sink (records end in two CRLF), so
a lost executor leaves no half archive, and hold a bounded number of records of
bounded size.

Reading. Archives are parsed by the records' own lengths, whatever their
blocks hold. Records without segment numbers are complete; the others are
grouped by origin id, ordered by segment number, checked (numbers 1 to n, total
length) and joined, and then every block's chunk framing is decoded. A group is
one record, never more than one page.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the smallest
page id is the response, the others are revisits that refer to it.

Defined results: a NULL html is an empty payload; a NULL url has no target URI;
rows with a NULL page id are revisits of a numbered page with the same payload
or else responses; rows that repeat a page id and payload get one record type;
an empty table makes no archive and reads as no rows; other columns are ignored.
A record that fails a check keeps a NULL payload and says why in ``problem``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm.frames import columns, cut, work_dir

MIN_REVISIT = 100
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
RECORDS_A_FILE = 1024
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = (
    "type string, record_id string, page_id string, uri string, digest string, refers_to string, "
    "origin string, segment int, total long, block binary"
)
DECODED = "type string, record_id string, page_id string, uri string, digest string, refers_to string, payload binary, problem string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[at : at + size])
        at += size + 2


def record_id(page_id: str | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _line(text: str | None) -> str | None:
    return text if text is None else text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def page_records(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None, is_revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    me = record_id(page_id, digest)
    base = [("WARC-Record-ID", me), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _line(url)), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if is_revisit:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("Content-Type", "application/http;msgtype=response")]
        yield _record([("WARC-Type", "revisit"), *base, *more], HEAD)
        return
    block = HEAD + chunked(payload)
    kind = [("WARC-Type", "response"), *base, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(kind, block)
        return
    yield _record([*kind, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    for n, at in enumerate(range(segment_bytes, len(block), segment_bytes), start=2):
        last = at + segment_bytes >= len(block)
        own = hashlib.sha256(f"{me}{n}".encode()).hexdigest()
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:32]}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", me),
            ("WARC-Segment-Number", str(n)),
            ("WARC-Segment-Total-Length", str(len(block)) if last else None),
        ]
        yield _record(headers, block[at : at + segment_bytes])


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """The pages (page_id, url, html) as gzip-compressed WARC files in the folder ``path``."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = columns(pages, "page_id", "url", "html").select(
        F.col("page_id"), "url", body.alias("payload"), F.sha2(body, 256).alias("digest"), (F.octet_length(body) >= MIN_REVISIT).alias("long")
    )
    # only payloads that repeat, and of them only the digest: a table of known size before pages are joined
    firsts = cut(
        rows.filter("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    )
    marked = rows.join(firsts, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"),
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("is_revisit"),
    )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for record in page_records(*[v.as_py() for v in row], segment_bytes):
                    held.append(record)
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    records = marked.mapInArrow(lay_out, "record binary").select(F.col("record").cast("string"))
    sink = records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE)
    sink.text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; ValueError where a record is cut off."""
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":  # one gzip member a file or a record
            unpack = zlib.decompressobj(31)
            parts.append(unpack.decompress(rest) + unpack.flush())
            rest = unpack.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + len(END)
        stop = start + int(headers["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[start:stop]
        at = stop + len(END)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, by any path that Spark reads."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("warc-type", "warc-record-id", "warc-page-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id")
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = [[] for _ in range(10)]
                for h, block in parse(content.as_py()):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    values = [h.get(n) for n in names] + [number and int(number), total and int(total), block]
                    for held, v in zip(rows, values, strict=True):
                        held.append(v)
                kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
                arrays = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [x.strip().split(" ")[0] for x in RECORD.split(",")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def _decode(kind: str, digest: str | None, parts: list[dict], total: int | None) -> tuple[bytes | None, str | None]:
    numbers = sorted({p["segment"] for p in parts})
    if numbers != list(range(1, len(numbers) + 1)):
        return None, "segments are missing"
    if len(numbers) > 1 and total is None:
        return None, "the last segment is missing"
    by_number = {p["segment"]: p["block"] for p in parts}
    block = b"".join(by_number[n] for n in numbers)
    if total is not None and total != len(block):
        return None, "the total length differs"
    if kind == "revisit":
        return None, None
    head, found, body = block.partition(END)
    try:
        if not found:
            raise ValueError("no HTTP head")
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, str(e)
    if digest and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
        return None, "the digest differs"
    return payload, None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record, with its payload whole."""
    records = read_records(spark, path)
    single = "segment IS NULL"
    info = ["type", "record_id", "page_id", "uri", "digest", "refers_to"]
    whole = records.filter(single).select(*info, F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"), F.lit(None).cast("long").alias("total"), F.lit(1).cast("long").alias("copies"))
    origin = F.coalesce("origin", "record_id")
    grouped = (
        records.filter(f"NOT ({single})")
        .groupBy(origin.alias("record_id"))
        .agg(
            # a page that stands twice in the input has equal records: each segment once, and how many pages there are
            F.collect_set(F.struct("segment", "block")).alias("parts"),
            F.max("total").alias("total"),
            F.count_if(F.col("segment") == 1).alias("copies"),
            *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in info if c != "record_id"],
        )
    )
    complete = whole.unionByName(grouped.select(*info, "parts", "total", "copies"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                kinds, digests, parts, totals = (part.column(i).to_pylist() for i in (0, 4, 6, 7))
                out = [_decode(*x) for x in zip(kinds, digests, parts, totals, strict=True)]
                done = [pa.array([p for p, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())]
                made = pa.RecordBatch.from_arrays([*part.columns[:6], *done], [*info, "payload", "problem"])
                copies = part.column(8).to_pylist()
                if any(c != 1 for c in copies):
                    made = made.take(pa.array([i for i, c in enumerate(copies) for _ in range(max(1, c))]))
                yield made

    return complete.mapInArrow(decode, DECODED)


def archive_roundtrip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives."""
    spark = pages.sparkSession
    kind = columns(pages, "page_id").schema["page_id"].dataType
    path = work_dir(spark)
    write_archive(pages, path, segment_bytes)
    read = read_archive(spark, path)
    light = cut(
        read.select("type", "record_id", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d"))
    )
    is_revisit = F.col("type") == "revisit"
    stored = light.filter(~is_revisit).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("ref"), F.col("n").alias("rn"), F.col("d").alias("rd")).dropDuplicates(["refers_to"])
    # only revisits look anything up; responses, which refer to nothing, stay out of the join
    revisits = light.filter(is_revisit).join(stored, "refers_to", "left").select("page_id", F.col("rn").alias("n"), F.col("rd").alias("d"), "type", "ref")
    both = light.filter(~is_revisit).select("page_id", "n", "d", "type", F.lit(None).cast("string").alias("ref")).unionByName(revisits)
    return both.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("d").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("ref").cast(kind).alias("refers_to"),
    )
