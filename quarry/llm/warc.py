"""Web archives: writing captures as WARC records, reading them back, assembling transactions.

Writing: each page gives a request, a response and a metadata record, the
latter two bound by ``WARC-Concurrent-To``.  Of pages with equal payloads of at least
``least_bytes`` the one with the smallest id is the response; the others are revisit
records that refer to it and carry no payload.  Each record is a gzip member, and
archives are bounded by bytes.  Spark's text writer passes them through; they go wherever
Spark can write.

Reading: a file's members are inflated one by one and cut by ``Content-Length``, never by
searching, so payloads may hold anything.  Assembly: the request and metadata
records join the response or revisit that they are concurrent to, and the
response that a revisit refers to; one nested row per capture comes out.  Keys
are record ids; only a response that many revisits refer to is hot, and that
join has a plain exchange on both sides, which adaptive execution splits.

Payloads never go through a shuffle: from their written table they go into the archives,
in the tasks that read them.  Of the others these tasks need only to know whether a row is a
revisit, one bit a row, broadcast as bitmaps of 32,768 rows (those without revisits have none).  A revisit
carries no payload, so that its join with the row it refers to is narrow.

Defined results: null html counts as an empty payload; a null or odd URL is
percent-encoded where it would break a header; of rows that tie on the
smallest id, one is the response; null ids come after all others; a capture
whose request or metadata record is missing has null there.  Rows are numbered once, in a written table, so that record
ids hold whatever is computed anew.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_hot, materialize, released

END = "\r\n\r\n"
#: Bytes that are inflated at once.
FEED = 1 << 16
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, payload binary, payload_bytes bigint, payload_digest string, fields map<string,string>"


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _header_text(value: Column) -> Column:
    """Nothing that would end a header line or start another word."""
    out = F.coalesce(value, F.lit(""))
    for c, code in (("%0D", "\r"), ("%0A", "\n"), ("%20", " ")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def _record(kind: str, own: Column, uri: Column, date: str, content_type: str, block: Column, more: list[tuple[str, Column]] = ()) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), own, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri]
    for name, value in more:
        lines += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*lines, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _rows(pages: DataFrame, id: str, url: str, html: str) -> DataFrame:
    """``row, id, uri, body, size, digest``, written, so that a row keeps its number whatever is computed anew."""
    return materialize(
        pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), _header_text(F.col(url)).alias("uri"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("body"))
        .withColumns({"size": F.octet_length("body"), "digest": F.unhex(F.sha2("body", 256))})
    )


def _not_marked(rows: DataFrame, row: str, marked: DataFrame, of: str) -> DataFrame:
    """``rows`` whose number is not among the ``marked``; a bit for each is broadcast, so that ``rows`` stay where they are."""
    bits = marked.groupBy(F.bitmap_bucket_number(of).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of)).alias("_bits"))
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(row) == F.col("_bucket"), "left")
    return found.where(F.col("_bits").isNull() | (F.getbit(byte, (at % 8).cast("int")) == 0)).drop("_bucket", "_bits")


def records(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100) -> DataFrame:
    """``value``: three records per page, without the end mark."""
    rows = _rows(pages, id, url, html)
    # Narrow rows tell which captures revisit which; small payloads, which may be frequent, have no part in it.
    large = rows.where(F.col("size") >= least_bytes).select("row", "id", "digest")
    leads = materialize(large.groupBy(F.col("digest").alias("of")).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("of", "n", F.col("lead.row").alias("lead")))
    again = materialize(join_hot(large, "digest", leads, "of", "n", rows.count()).where("row <> lead").select(F.col("row").alias("revisit"), "lead"))
    row, body, uri, size = F.col("row"), F.col("body").cast("string"), F.col("uri"), F.col("size")
    own = _uuid(F.lit("capture"), row)
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    response = _record("response", own, uri, date, "application/http;msgtype=response", F.concat(head, body), digest)
    refers = [("WARC-Refers-To", _uuid(F.lit("capture"), F.col("lead"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))]
    revisit = _record("revisit", own, uri, date, "application/http;msgtype=response", head, digest + refers)
    bound = [("WARC-Concurrent-To", own)]
    request = _record("request", _uuid(F.lit("request"), row), uri, date, "application/http;msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1\r\nUser-Agent: quarry{END}")), bound)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _uuid(F.lit("metadata"), row), uri, date, "application/warc-fields", fields, bound)
    whole = _not_marked(rows, "row", again, "revisit").select(F.explode(F.array(request, response, metadata)).alias("value"))
    others = rows.drop("body").join(again, F.col("row") == F.col("revisit")).select(F.explode(F.array(request, revisit, metadata)).alias("value"))
    return whole.unionAll(others)


def archives(found: DataFrame, archive_bytes: int) -> DataFrame:
    """``archive binary``: records, each a gzip member of its own, side by side up to ``archive_bytes`` and one record more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

        for batch in batches:
            for value in batch.column(0):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(value.as_py() + END.encode()) + packer.flush()
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return found.select(F.col("value").cast("binary")).mapInArrow(run, "archive binary")


#: A gzip member of nothing.  Spark's text writer ends each file by a line separator; this one readers pass over.
_NOTHING = zlib.compressobj(6, zlib.DEFLATED, 31)
_NOTHING = _NOTHING.compress(b"") + _NOTHING.flush()


def write_archives(pages: DataFrame, path: str, *, archive_bytes: int = 32 << 20, **options) -> None:
    """One archive a file; Spark's text writer, which can write wherever Spark can, passes the bytes through as they are."""
    found = records(pages, **options)
    rows = archives(found, archive_bytes).select(F.col("archive").cast("string").alias("value"))
    rows.write.option("lineSep", _NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    # Records read tables of their own only, and the archives hold all of them now.
    released(found)


def _members(data: bytes) -> Iterator[bytes]:
    """The plain bytes of a file: member by member where it is gzip."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        out, fed = [], at
        while not member.eof and fed < len(data):
            out.append(member.decompress(view[fed : fed + FEED]))
            fed = min(fed + FEED, len(data))
        if not member.eof:
            raise ValueError(f"the member at byte {at} is cut short")
        at = fed - len(member.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive."""
    for plain in _members(data):
        yield from _parse(plain)


def _parse(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(header["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut short")
        at = end + 4 + size
        kind = header["warc-type"]
        out = {"record_id": header["warc-record-id"], "type": kind, "concurrent_to": header.get("warc-concurrent-to"), "refers_to": header.get("warc-refers-to"), "uri": header.get("warc-target-uri"), "date": header.get("warc-date"), "payload": None, "payload_bytes": None, "payload_digest": None, "fields": None}
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2] if header.get("content-type", "").startswith("application/http") else block
            out |= {"payload": body, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}
        elif kind == "revisit":
            out["payload_digest"] = header.get("warc-payload-digest", "").rpartition(":")[2] or None
        elif kind == "metadata":
            out["fields"] = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if sep]
        else:
            out |= {"payload": block, "payload_bytes": len(block)}
        yield out


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record; without ``payloads`` sizes and digests only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parse(content.as_py()):
                    size += record["payload_bytes"] or 0
                    if not payloads:
                        record["payload"] = None
                    held.append(record)
                    if len(held) >= 5000 or size >= 32 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """One row per capture: ``record_id, uri, date, capture, request, metadata, original`` (structs; null where a record is missing).

    ``original``: the response that a revisit refers to, without its payload.
    """
    captures = found.where("type in ('response', 'revisit')").select("record_id", "uri", "date", F.struct("type", "payload", "payload_bytes", "payload_digest", "refers_to").alias("capture"))
    requests = found.where("type = 'request'").select(F.col("concurrent_to").alias("req_of"), F.struct("record_id", "payload").alias("request"))
    metadata = found.where("type = 'metadata'").select(F.col("concurrent_to").alias("meta_of"), F.struct("record_id", "fields").alias("metadata"))
    whole = captures.join(requests, F.col("record_id") == F.col("req_of"), "left").join(metadata, F.col("record_id") == F.col("meta_of"), "left").drop("req_of", "meta_of")
    about = found.where("type = 'metadata'").select(F.col("concurrent_to").alias("about"), F.col("fields").alias("about_fields"))
    targets = found.where("type = 'response'").join(about, F.col("record_id") == F.col("about"), "left").select(F.col("record_id").alias("target"), F.struct("record_id", "payload_bytes", "payload_digest", F.col("about_fields").alias("fields")).alias("original"))
    return whole.join(targets, F.col("capture.refers_to") == F.col("target"), "left").drop("target")


def capture_digests(whole: DataFrame, kind: str = "bigint") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of transactions that ``write_archives`` wrote."""
    page = lambda fields: F.try_element_at(fields, F.lit("page-id")).try_cast(kind)
    return whole.select(
        page(F.col("metadata.fields")).alias("page_id"),
        F.coalesce("capture.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.type") == "revisit", page(F.col("original.fields"))).alias("refers_to"),
    )
