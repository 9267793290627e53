"""WARC archives: writing segmented records with chunked bodies, and reassembling them.

Writing: pages of equal payload are one response, that with the largest id,
and revisits of it. A response whose HTTP block is longer than SEGMENT bytes
becomes a first segment and continuation records; bodies use the chunked
transfer encoding. Archives are text files that end records with an empty
line, written and compressed by Spark's own sink into the shared folder, of
about FILE_BYTES before compression; the sink makes one gzip member of a file.
Only ids and digests are dealt by payload; pages themselves stay where they are
read, but for those that others repeat, and these only where their ids are too
many to send to every task (FEW_REPEATS).

Reading: compressed files are streamed through Spark's text source, split where
records may end and put together by content length, others parsed whole;
continuation records are brought together by their origin's identifier and
ordered by segment number, streamed one record at a time; the total length is
verified, the chunked framing decoded, the payload's digest compared with its
header.

Defined cases: a null html is the empty payload; of equal rows the first is
the response and the others revisit their own id; a null id sorts lowest and
reads back as null; line breaks in an address are percent-encoded; a record
with missing segments, a wrong length or digest raises; empty input gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, lean, remove, remove_path, shuffles_deleted, spread, written

#: Most bytes of a record's block, and of a chunk of a body.
SEGMENT = 32_768
CHUNK = 8_192
#: Bytes of an archive file before compression, about.
FILE_BYTES = 256 << 20
#: Ids of pages of repeated payloads that are broadcast; more are joined.
FEW_REPEATS = 1 << 17
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0

# Fixed values of the formats.
END = "\r\n\r\n"
CUT = END.encode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _cuts(data: bytes, most: int) -> Iterator[bytes]:
    """data in pieces of at most `most` bytes that don't break a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(body: bytes, most: int = CHUNK) -> bytes:
    return b"".join([b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(body, most)]) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        n = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n" or at + n > len(data):
            raise ValueError("a chunk doesn't end where its size says")
        out.append(data[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _record(fields: dict[str, object], block: bytes) -> str:
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"])
    return head + END + block.decode()


def records_of(key: str, url: str, payload: bytes, revisits: str | None) -> Iterator[str]:
    """The WARC records of one page, without the line breaks that end each."""
    common = {"WARC-Record-ID": f"<urn:page:{key}>", "WARC-Date": DATE, "WARC-Target-URI": re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response"}
    if revisits is not None:
        yield _record({"WARC-Type": "revisit", **common, "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{revisits}>"}, HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record({"WARC-Type": "response", **common}, block)
        return
    pieces = list(_cuts(block, SEGMENT))
    yield _record({"WARC-Type": "response", **common, "WARC-Segment-Number": 1}, pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(pieces) else {}
        yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{key}:{k}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<urn:page:{key}>", "WARC-Segment-Number": k, **last}, piece)


def write_archives(pages: DataFrame, path: str, html: str = "html", url: str = "url", id_col: str = "page_id", least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record, or several segments, for every page to archives in the folder path."""
    rows = spread(pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.coalesce(F.col(url), F.lit("urn:unknown")).alias("url")))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    ids = written(rows.select("id", "sha", F.octet_length("html").cast("long").alias("bytes")), "page-ids")
    size = ids.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    per_file = max(1, FILE_BYTES * size["n"] // max(1, (size["bytes"] or 0) + 500 * size["n"]))
    known = ids.filter("sha is not null")
    top = known.groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("name")
    repeats = written(known.join(top, "sha").select(name("id"), "sha", "top").distinct(), "page-repeats")
    few = repeats.count() <= FEW_REPEATS
    placed = rows.select("*", name("id")).join(F.broadcast(repeats.withColumn("shared", F.lit(True))) if few else repeats.withColumn("shared", F.lit(True)), ["name", "sha"], "left")
    alone = placed.filter("shared is null").withColumn("number", F.lit(0)).withColumn("revisit", F.lit(False))
    again = placed.filter("shared is not null").withColumn("number", F.row_number().over(W.partitionBy("name", "sha").orderBy("url")) - 1)
    again = again.withColumn("revisit", (F.col("number") > 0) | ~F.col("id").eqNullSafe(F.col("top")))
    both = [x.select("id", "number", "html", "url", "revisit", "top") for x in (alone, again)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda x: "null" if x is None else x
        for b in batches:
            for k in range(0, b.num_rows, 64):
                out = []
                for r in b.slice(k, 64).to_pylist():
                    out.extend(records_of(f"{name(r['id'])}:{r['number']}", r["url"], r["html"].encode(), f"{name(r['top'])}:0" if r["revisit"] else None))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    with shuffles_deleted(pages.sparkSession):
        both[0].unionByName(both[1]).mapInArrow(lean(run), "value string").write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    remove(ids, repeats)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record of a whole archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = _fields(data[at:end])
        n = int(fields["content-length"])
        begin = end + 4
        if data[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, data[begin : begin + n]
        at = begin + n + 4


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    if not head.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {head[:20]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def joined(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, from archives cut at empty lines, which blocks may hold as well."""
    held, fields, n, need = bytearray(), None, 0, 1
    for piece in pieces:
        held += piece + CUT
        while len(held) >= need:
            if fields is None:
                while held.startswith(b"\r\n"):  # what is left of empty lines where a block ended with a line
                    del held[:2]
                need = 1
                if held:
                    end = held.index(CUT)
                    fields = _fields(bytes(held[:end]))
                    del held[: end + 4]
                    n = int(fields["content-length"])
                    need = n + 4
            else:
                if held[n : n + 4] != CUT:
                    raise ValueError("a record doesn't end where its length says")
                yield fields, bytes(held[:n])
                del held[: n + 4]
                fields, need = None, 1
    if fields is not None:
        raise ValueError("the last record is cut off")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(origin, segment, type, refers_to, digest, total, block) of every record of the archives in path.

    Files whose names end in .gz are streamed; others, of 2 GB at most, are read whole.
    """
    zipped = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("piece"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("content")

    def rows_of(records: Iterable[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for f, block in records:
            total = f.get("warc-segment-total-length")
            rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(f.get("warc-segment-number", 0)), f["warc-type"], f.get("warc-refers-to"), f.get("warc-payload-digest"), int(total) if total else None, block))
            size += len(block)
            if size > 4_000_000:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_of(joined(x.as_py() for b in batches for x in b.column("piece")))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                yield from rows_of(parse(content.as_py()))

    form = "origin string, segment int, type string, refers_to string, digest string, total bigint, block binary"
    return zipped.mapInArrow(lean(streamed), form).unionByName(files.mapInArrow(lean(whole), form))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["origin", "segment", "type", "refers_to", "digest", "total", "block"])


def reassemble(records: DataFrame) -> DataFrame:
    """(record, type, refers_to, digest, payload) of every record, segments brought together and verified."""

    def whole(parts: list[dict]) -> dict:
        first, last = parts[0], parts[-1]
        if len(parts) > 1 or first["segment"]:
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError(f"segments of {first['origin']} are missing or repeat")
            block = b"".join(p["block"] for p in parts)
            if last["total"] != len(block):
                raise ValueError(f"segments of {first['origin']} have {len(block)} bytes, not {last['total']}")
        else:
            block = first["block"]
        payload = None
        if first["type"] != "revisit":
            payload = http_payload(block)
            if first["digest"] and first["digest"] != f"sha1:{digest(payload)}":
                raise ValueError(f"the payload of {first['origin']} doesn't have its digest")
        return {"record": first["origin"], "type": first["type"], "refers_to": first["refers_to"], "digest": first["digest"], "payload": payload}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])
        parts: list[dict] = []
        for b in batches:
            for k in range(0, b.num_rows, 128):
                done = []
                for r in b.slice(k, 128).to_pylist():
                    if parts and (r["origin"] != parts[0]["origin"] or not r["segment"]):
                        done.append(whole(parts))
                        parts = []
                    parts.append(r)
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema)
        if parts:
            yield pa.RecordBatch.from_pylist([whole(parts)], schema)

    form = "record string, type string, refers_to string, digest string, payload binary"
    alone = records.filter("segment = 0").mapInArrow(lean(run), form)
    segmented = records.filter("segment > 0").repartition("origin").sortWithinPartitions("origin", "segment")
    return alone.unionByName(segmented.mapInArrow(lean(run), form))


def archived_pages(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, as its archives say."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, html, url, id_col)
    found = reassemble(read_records(spark, path))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+|null):\d+>$", 1).try_cast("long")
    slim = found.select("record", "type", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.substring("digest", 6, 32).alias("payload_digest"))
    slim = written(slim, "warc-read")
    remove_path(spark, path)
    origins = slim.filter("type = 'response'").select(F.col("record").alias("refers_to"), F.col("bytes").alias("origin_bytes"))
    revisits = slim.filter("refers_to is not null").join(origins, "refers_to", "left")  # responses have no key to be dealt by
    rows = revisits.unionByName(slim.filter("refers_to is null").withColumn("origin_bytes", F.lit(None).cast("long")))
    return rows.select(number(F.col("record")).alias(id_col), F.coalesce("bytes", "origin_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))
