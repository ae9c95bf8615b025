"""WARC archives: write pages as records, read them back, put segments together.

Archives are written by Spark's text writer, one record per line with the blank lines
that end a record as the line separator, so a lost task leaves no half archive. Reading
goes through the text reader: the pieces of a compressed file come in order, and a parser
cuts them by the lengths the headers give. Nothing holds more than one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.llm.common import slices
from packetscope.session import ship, written

# bytes of a record's block at most, and of a transfer chunk
SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as archives name payloads."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, without extensions and trailers; None if it is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        start = end + 2
        if size < 0 or body[start + size : start + size + 2] != b"\r\n":
            return None
        parts.append(body[start : start + size])
        at = start + size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message; None if the message is broken."""
    head, found, body = block.partition(_END)
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().lower()
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    """A record without the blank lines after it. Line breaks in values become spaces."""
    lines = ["WARC/1.1"]
    for name, value in {**fields, "Content-Length": len(block)}.items():
        if value is not None:
            lines.append(f"{name}: {' '.join(str(value).split())}")
    return "\r\n".join(lines).encode() + _END + block


def _records(page: dict, segment: int) -> Iterator[bytes]:
    """The records of one page: one, or a first segment and its continuations."""
    payload = page["payload"] or b""
    name = digest(payload)
    own = f"<urn:page:{page['page_id']}:{name}>"
    fields = {
        "WARC-Type": page["kind"],
        "WARC-Record-ID": own,
        "WARC-Target-URI": page["url"],
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{name}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page["kind"] == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{page['refers_to']}:{name}>"
        yield record(fields, _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield record(fields, block)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield record({**fields, "WARC-Segment-Number": 1}, parts[0])
    for number, part in enumerate(parts[1:], 2):
        yield record(
            {
                "WARC-Type": "continuation",
                "WARC-Record-ID": f"<urn:page:{page['page_id']}:{name}:{number}>",
                "WARC-Date": "1970-01-01T00:00:00Z",
                "WARC-Segment-Number": number,
                "WARC-Segment-Origin-ID": own,
                "WARC-Segment-Total-Length": len(block) if number == len(parts) else None,
            },
            part,
        )


def _classified(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Which pages are responses and which revisit another page's equal payload.

    The largest id of each payload is found over digests alone; a payload with many
    copies is one row per task there.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("sum", F.sha1(payload)).withColumn("bytes", F.octet_length(payload))
    best = (
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("sum")
        .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND best IS NOT NULL")
        .select("sum", "best")
    )
    joined = rows.join(best, "sum", "left")
    revisits = F.coalesce(F.col("best").eqNullSafe(F.col("page_id")), F.lit(False)) | F.col("best").isNull()
    return joined.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.when(revisits, "response").otherwise("revisit").alias("kind"),
        F.when(~revisits, F.col("best")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write a record per page, gzipped, one archive per task.

    The payload is the html in UTF-8, null is empty. Of pages with equal payloads of at
    least ``least_bytes``, the one with the largest id is a response and the others are
    revisit records that refer to it; rows that share that id and payload are all
    responses. A null id is never the largest. Blocks longer than ``segment_bytes``
    become continuation records.
    """
    ship(pages.sparkSession)
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")
    )

    def run(batches):
        for batch in slices(batches):
            out = [r for page in batch.to_pylist() for r in _records(page, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = _classified(rows, least_bytes).mapInArrow(run, "value binary")
    # text columns may hold any bytes; the writer hands them on as they are
    (
        records.select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    )


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a file's records, from its pieces between blank lines."""
    buffer = bytearray()
    fields: dict[str, str] | None = None
    need = 0
    for piece in pieces:
        buffer += piece + _END
        while True:
            if fields is None:
                end = buffer.find(_END)
                if end < 0:
                    break
                lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
                del buffer[: end + 4]
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC record where one should start")
                fields = {}
                for line in lines[1:]:
                    name, _, value = line.partition(":")
                    fields[name.strip().lower()] = value.strip()
                need = int(fields["content-length"])
            if len(buffer) < need + 4:
                break
            yield fields, bytes(buffer[:need])
            del buffer[: need + 4]
            fields = None
    if fields is not None:
        raise ValueError("the last record ends early")


_FIELDS = {
    "type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "origin_id": "warc-segment-origin-id",
}
_NUMBERS = {"segment": "warc-segment-number", "total": "warc-segment-total-length"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzipped archives: header fields and block, a row per record.

    Spark does not split gzipped files, so each is read from its start by one task, piece
    by piece.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\r\n\r\n").text(path)
    pieces = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))

    def run(batches):
        rows = ((v, f) for b in slices(batches) for v, f in zip(*(c.to_pylist() for c in b.columns)))
        out: list[dict] = []
        size = 0
        for fields, block in _by_file(rows):
            row = {name: fields.get(field) for name, field in _FIELDS.items()}
            row |= {n: int(fields[f]) if f in fields else None for n, f in _NUMBERS.items()}
            out.append(row | {"block": block})
            size += len(block)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [(n, pa.string()) for n in _FIELDS] + [(n, pa.int64()) for n in _NUMBERS] + [("block", pa.binary())]
    )
    kinds = [f"{n} string" for n in _FIELDS] + [f"{n} long" for n in _NUMBERS] + ["block binary"]
    return pieces.mapInArrow(run, ", ".join(kinds))


def _by_file(rows: Iterator[tuple[bytes, str]]):
    """Records of one file after the other."""
    import itertools

    for _, part in itertools.groupby(rows, key=lambda r: r[1]):
        yield from parsed(v for v, _ in part)


def _payload_udf():
    kind = pa.struct([("ok", pa.bool_()), ("bytes", pa.int64()), ("digest", pa.string())])

    def run(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in blocks:
            out = []
            for block in batch:
                payload = payload_of(block.as_py()) if block.is_valid else None
                ok = payload is not None
                out.append(
                    {"ok": ok, "bytes": len(payload) if ok else None, "digest": digest(payload) if ok else None}
                )
            yield pa.array(out, kind)

    return F.arrow_udf(run, "struct<ok boolean, bytes long, digest string>")


def reassembled(records: DataFrame) -> DataFrame:
    """Whole blocks: ``record_id`` and the other fields, ``block``, ``complete``.

    Records without segments pass through, without a shuffle. Continuations are grouped
    by the id of the record they continue and ordered by number. A block is complete if the
    numbers run from 1 without a gap and the lengths add up to the total its last segment
    names; otherwise ``block`` is null. Equal records that repeat with all their segments
    come out as often as they came in; a continuation without its first segment yields one
    incomplete row.
    """
    whole = records.where("segment IS NULL").select(
        "type", "record_id", "target_uri", "payload_digest", "refers_to", "block",
        F.lit(True).alias("complete"),
    )
    parts = records.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    grouped = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.count(F.when(first, 1)).alias("copies"),
        *[
            F.max(F.when(first, F.col(c))).alias(c)
            for c in ("type", "target_uri", "payload_digest", "refers_to")
        ],
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    hexes = F.transform("parts", lambda p: F.hex(p["block"]))
    joined = F.unhex(F.concat_ws("", hexes))
    gapless = numbers == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    complete = gapless & F.coalesce(F.octet_length(joined) == F.col("total"), F.lit(False))
    segmented = grouped.withColumn("complete", complete).select(
        "type", F.col("origin").alias("record_id"), "target_uri", "payload_digest", "refers_to",
        F.when(F.col("complete"), joined).alias("block"), "complete",
        F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)).cast("int"))).alias("copy"),
    ).drop("copy")
    return whole.unionByName(segmented)


# records that hold a payload of their own
_ANSWERS = "(type = 'response' OR type IS NULL)"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Length and digest are worked out from the decoded payload; ``intact`` says whether it
    could be put together and decoded and has the digest its header names. A revisit takes
    both from the response it refers to, and is not intact without one.

    Archives are parsed once: whole blocks are decoded on the way, and header fields, digests
    and the blocks of segments are written.
    """
    records = read_records(spark, path)
    lone = F.expr(f"CASE WHEN segment IS NULL AND {_ANSWERS} THEN block END")
    records = written(
        records.withColumn("payload", _payload_udf()(lone))
        .withColumn("block", F.when(F.col("segment").isNotNull(), F.col("block"))),
        "records",
    )
    columns = ["type", "record_id", "payload_digest", "refers_to", "complete", "payload"]
    whole = records.where("segment IS NULL").withColumn("complete", F.lit(True))
    parts = reassembled(records.where("segment IS NOT NULL").drop("payload"))
    parts = parts.withColumn("payload", _payload_udf()("block"))
    blocks = whole.select(columns).unionByName(parts.select(columns))
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    answers = blocks.where(_ANSWERS)
    named = F.concat(F.lit("sha1:"), F.col("payload.digest"))
    responses = answers.select(
        "record_id",
        page("record_id").alias("page_id"),
        F.col("payload.bytes").alias("payload_bytes"),
        F.col("payload.digest").alias("payload_digest"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        F.coalesce(F.col("complete") & (named == F.col("payload_digest")), F.lit(False)).alias("intact"),
    )
    targets = responses.groupBy(F.col("record_id").alias("target")).agg(
        F.max("payload_bytes").alias("payload_bytes"),
        F.max("payload_digest").alias("found"),
        F.min("intact").alias("intact"),
    )
    again = blocks.where("type = 'revisit'").select("record_id", "payload_digest", "refers_to")
    revisits = again.join(targets, F.col("refers_to") == F.col("target"), "left").select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.col("found").alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        page("refers_to").alias("refers_to"),
        F.coalesce(
            F.col("intact") & (F.concat(F.lit("sha1:"), F.col("found")) == F.col("payload_digest")),
            F.lit(False),
        ).alias("intact"),
    )
    return responses.drop("record_id").unionByName(revisits)
