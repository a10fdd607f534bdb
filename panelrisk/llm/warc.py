"""WARC archives of web pages: written by Spark, read back, segments put together again.

Writing: a payload that occurs more than once, and has at least ``MIN_REVISIT`` bytes, is stored with the
smallest id and becomes a ``revisit`` record elsewhere.  A response is an HTTP message in chunked transfer
framing.  A block above ``segment_bytes`` is cut into a first record and ``continuation`` records that name
its record id, their segment number and, in the last one, the total length.  Records are written by the
text writer with the record separator as the line ending, so every file is a valid archive (of whole
records) in any store that Spark can write.

Reading: files are parsed by their Content-Length fields, continuations are grouped by the origin's id
in a shuffle, ordered by segment number and checked for gaps and against the total length; then the HTTP
head is cut off, the chunks are decoded, and the digest is compared.  Only segmented blocks are shuffled.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.llm.common import col, scratch, table, written

MIN_REVISIT = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Records of one archive file: with the segment size, this bounds a file and so a reading task.
FILE_RECORDS = 2_000
_BATCH_BYTES = 4 << 20
#: Any fixed time does: the pages carry none.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"

_WHOLE = T.StructType([T.StructField(n, t) for n, t in (
    ("record_id", T.StringType()), ("page", T.StringType()), ("kind", T.StringType()), ("uri", T.StringType()),
    ("digest", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()), ("error", T.StringType()))])
_SEGMENT = T.StructType([T.StructField(n, t) for n, t in (
    ("origin", T.StringType()), ("page", T.StringType()), ("kind", T.StringType()), ("uri", T.StringType()),
    ("digest", T.StringType()), ("segment", T.IntegerType()), ("total", T.LongType()), ("block", T.BinaryType()))])
_PAYLOAD = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for a in range(0, len(payload), size):
        piece = payload[a:a + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, bad framing raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("bad chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(body[at:at + n])
        at += n + 2


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [f"{k}: {_one_line(str(v))}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {length}", "", ""]).encode("utf-8", "replace")


def records(record_id: str, uri: str | None, digest: str, payload: bytes, refers_to: str | None,
            segment_bytes: int = SEGMENT_BYTES, page: str | None = None) -> list[bytes]:
    """The WARC records of one page, without the separators that follow them; ``page`` is its id in the table."""
    base = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return [_head([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *base,
                       ("WARC-Refers-To", f"<{refers_to}>"),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("Content-Type", "application/http; msgtype=response")], len(block)) + block]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(payload))
    cut = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    out = []
    for k, piece in enumerate(cut, 1):
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *base] if k == 1 else \
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>"), *base[:2],
             ("WARC-Segment-Origin-ID", f"<{record_id}>")]
        if len(cut) > 1:
            kind.append(("WARC-Segment-Number", k))
            if k == len(cut):
                kind.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_head([*kind, ("Content-Type", "application/http; msgtype=response")], len(piece)) + piece)
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES,
                   min_revisit: int = MIN_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Writes gzipped archives of ``pages`` to the folder ``path``.

    A null payload is empty; a null url leaves the field out.  Every row has a record id of its own:
    ``urn:page:ID``, and ``urn:page:ID#ROW`` with the row's number for repeated ids and null ids (as the empty
    string); the field ``Page-ID`` has the id itself.  Of equal payloads of at least ``min_revisit`` bytes the
    smallest id is the response; repeated rows with that id are all responses, and revisits, rows without id among
    them, refer to the first; where no row has an id, all are responses.  Other columns are ignored; no rows make an archive without records.
    ``pages`` is read twice and must give its rows in the same order, as files do; otherwise rows are
    written as responses under ``urn:page:ID``.
    """
    base = pages.select(col(id_col).cast("string").alias("id"), col(id_col).alias("key"), col(url_col).alias("url"),
                        F.coalesce(col(payload_col), F.lit("")).cast("binary").alias("payload"),
                        F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    plain = F.concat(F.lit("urn:page:"), F.coalesce("id", F.lit("")))
    rows = written(base.select("row", "id", "key", "digest", (F.octet_length("payload") >= min_revisit).alias("long")), "pages")
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and key is not null").select("key", "n")
    named = rows.join(repeated, "key", "left").withColumn(
        "record_id", F.when(F.col("n").isNotNull() | F.col("key").isNull(), F.concat(plain, F.lit("#"), F.col("row"))))
    own = F.when(F.col("key").isNotNull(), F.struct("key", "row", F.coalesce("record_id", plain).alias("rid")))
    first = (named.filter("long").groupBy("digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("m"))
             .filter("m > 1 and first is not null").select("digest", F.col("first.key").alias("first"), F.col("first.rid").alias("rid")))
    other = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    marks = (named.join(first, "digest", "left")
             .select("row", "digest", "record_id", F.when(other, F.col("rid")).alias("refers_to"))
             .filter("record_id is not null or refers_to is not null"))
    known = base.join(marks, ["row", "digest"], "left").select(
        F.coalesce("record_id", plain).alias("record_id"), "url", "digest", "payload", "refers_to",
        F.lit(segment_bytes).alias("segment_bytes"), F.col("id").alias("page"))

    def lines(stream):
        for batch in stream:
            for a in range(0, batch.num_rows, 250):
                out = []
                for row in zip(*(c.slice(a, 250).to_pylist() for c in batch.columns)):
                    out += records(*row)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (known.mapInArrow(lines, "record binary").select(F.col("record").cast("string").alias("record"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path))


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)[ \t]*$")


def parse(raw: bytes):
    """The records of an archive as dicts; a broken archive raises ValueError."""
    at = 0
    bare = lambda v: v.strip().strip("<>") if v else None
    while at < len(raw):
        if raw[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"record head without end at byte {at}")
        head = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            if m := _FIELD.match(line):
                head[m[1].decode("utf-8", "replace").lower()] = m[2].decode("utf-8", "replace")
        start, n = end + 4, int(head["content-length"])
        if start + n > len(raw):
            raise ValueError(f"record cut short at byte {at}")
        number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
        yield {"record_id": bare(head.get("warc-record-id")), "page": head.get("page-id"), "kind": head.get("warc-type"),
               "refers_to": bare(head.get("warc-refers-to")), "uri": head.get("warc-target-uri"),
               "digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None,
               "origin": bare(head.get("warc-segment-origin-id")), "segment": int(number) if number else None,
               "total": int(total) if total else None, "block": raw[start:start + n]}
        at = start + n
        while raw[at:at + 2] == b"\r\n":
            at += 2


def opened(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    """(payload, None) of a whole HTTP block, or (None, what is wrong): ``http`` for a block without head,
    ``chunks`` for bad framing, ``digest`` where the payload is not what the record promised."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "http"
    if re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", head):
        try:
            body = unchunked(body)
        except ValueError:
            return None, "chunks"
    if digest is not None and hashlib.sha256(body).hexdigest() != digest:
        return None, "digest"
    return body, None


def _whole(r: dict) -> dict | None:
    if r["kind"] == "revisit":
        return {**r, "payload": None, "error": None}
    if r["kind"] == "response" and r["segment"] is None:
        payload, error = opened(r["block"], r["digest"])
        return {**r, "payload": payload, "error": error}
    return None


def _segment(r: dict) -> dict | None:
    return {**r, "origin": r["origin"] or r["record_id"]} if r["segment"] is not None else None


def _read(spark: SparkSession, path: str, pick, schema: T.StructType) -> DataFrame:
    """What ``pick`` makes of the records of all archives in ``path``; a task holds one file at a time."""
    import gzip

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])

    def parsed(stream):
        for batch in stream:
            for raw in batch.column(0):
                data = raw.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for r in filter(None, map(pick, parse(data))):
                    rows.append({f: r[f] for f in fields.names})
                    size += len(r["block"])
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    return (spark.read.format("binaryFile").load(path).filter("length > 0").select("content").mapInArrow(parsed, schema))


def reassemble(segments: DataFrame) -> DataFrame:
    """(record_id, page, uri, digest, block, error) of segmented blocks, from their records (see ``_SEGMENT``).

    Segments are grouped by the origin's record id and ordered by segment number.  ``error`` is ``segments``
    if a number is missing or repeats, or the origin or the last segment is missing, and ``length`` if the
    total differs; the block is then null.
    """
    parts = (segments.groupBy("origin")
             .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"),
                  F.max(F.when(F.col("kind") == "response", F.struct("uri", "digest", "page"))).alias("h")))
    n = F.size("s")
    complete = (F.col("s.segment") == F.sequence(F.lit(1), n)) & F.col("total").isNotNull() & F.col("h").isNotNull()
    joined = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    error = F.when(~F.coalesce(complete, F.lit(False)), "segments").when(joined != F.col("total"), "length")
    # one concatenation, through hex: binary arrays can't be joined
    block = F.unhex(F.array_join(F.transform(F.col("s.block"), lambda b: F.hex(b)), ""))
    return parts.select(F.col("origin").alias("record_id"), "h.page", "h.uri", "h.digest",
                        F.when(error.isNull(), block).alias("block"), error.alias("error"))


def payloads(blocks: DataFrame) -> DataFrame:
    """``blocks`` opened: (record_id, page, uri, digest, payload, error); see ``opened``."""

    @F.arrow_udf(_PAYLOAD)
    def each(blocks: pa.Array, digests: pa.Array) -> pa.Array:
        both = [(None, None) if not b.is_valid else opened(b.as_py(), d.as_py()) for b, d in zip(blocks, digests)]
        return pa.array([{"payload": p, "error": e} for p, e in both],
                        pa.struct([("payload", pa.binary()), ("error", pa.string())]))

    return (blocks.withColumn("p", each("block", "digest"))
            .select("record_id", "page", "uri", "digest", "p.payload", F.coalesce("error", "p.error").alias("error")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page, kind, uri, digest, refers_to, payload, error) of all responses and revisits in ``path``.

    A revisit has no payload of its own; ``refers_to`` is the record id of its response.
    """
    whole = _read(spark, path, _whole, _WHOLE)
    joined = payloads(reassemble(_read(spark, path, _segment, _SEGMENT)))
    return whole.unionByName(joined.select("record_id", "page", F.lit("response").alias("kind"), "uri", "digest",
                                           F.lit(None).cast("string").alias("refers_to"), "payload", "error"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # sizes and digests are measured on what was read; a response that came back broken has none
    found = written(read_archives(spark, path).select(
        "record_id", F.col("page").cast("bigint").alias("page_id"), "kind", "refers_to",
        F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d")), "read")
    own = found.filter("kind = 'response'")
    again = (found.filter("kind = 'revisit'").select("page_id", "refers_to")
             .join(own.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), "n", "d"), "refers_to"))
    cols = lambda kind, ref: ["page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"),
                              F.lit(kind).alias("record_type"), ref.alias("refers_to")]
    return own.select(*cols("response", F.lit(None).cast("long"))).union(again.select(*cols("revisit", F.col("to"))))


ORACLE = {"op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT sha256(html) AS d, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = sha256(html)
"""}
QUERIES = {"op8_warc": op8_warc}
