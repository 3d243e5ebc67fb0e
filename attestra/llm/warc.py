"""op1 -- WARC archives: write, read back, resolve revisits by payload digest, write deduplicated.

Writing uses Spark's text sink: a record is one string of header, block and no end, and the sink's
line separator ``CRLF CRLF`` is exactly WARC's record end.  So archives are written by the JVM
under Spark's commit protocol, one gzip file a task.  Gzip files are not split, so the reader sees
each archive's pieces in order, and joins them again by ``Content-Length``: a payload that holds
``CRLF CRLF``, or a whole WARC record, is not misread.

Revisits are resolved on headers alone: (digest, length, page) rows are pre-aggregated to each
digest's first page, so a hot digest is one row.  Payloads move, by their unique record id, only
where revisits are too many to broadcast.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path, table

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Payloads below this many bytes are not worth a revisit record.
MIN_REVISIT_BYTES = 100
#: Revisits (about 150 bytes each) that may be broadcast.
BROADCAST_REVISITS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; control characters cannot break out of it."""
    safe = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def _record(kind: str, record_id: Column, page: Column, url: Column, digest: Column, length: Column, payload: Column | None, refers_to: Column | None) -> Column:
    block = _http(length) if payload is None else F.concat(_http(length), payload)
    size = F.octet_length(_http(length)) + (length if payload is not None else F.lit(0))
    lines = [
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.lit(kind)),
        _line("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("X-Page-ID", page),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
    ]
    if refers_to is not None:
        lines += [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<"), refers_to, F.lit(">")))]
    lines += [F.lit("Content-Type: application/http;msgtype=response\r\n"), _line("Content-Length", size), F.lit("\r\n")]
    return F.concat(*lines, block)


def _write(records: DataFrame, path: str) -> None:
    # The fast gzip level: archives are read back at once, and half the time goes into packing.
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One response record per row of ``pages``; a null payload is empty, a null URL is left out.

    Record ids name the row's place, so equal rows get records of their own.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), body.alias("body"), F.monotonically_increasing_id().alias("at"))
    record_id = F.concat(F.lit("urn:attestra:record:"), F.sha1(F.concat_ws("/", F.col("at").cast("string"), F.col("page").cast("string"))))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    made = _record("response", record_id, F.col("page"), F.col("url"), digest, F.octet_length("body").cast("long"), F.col("body"), None)
    _write(rows.select(made.alias("value")), path)


def _parse(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if lines[0] != VERSION.encode():
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}


def _reader(payloads: bool):
    """Joins an archive's pieces, in order, to records.  Holds one record at a time, plus a batch."""

    def read(batches):
        names = RECORD.names if payloads else RECORD.names[:-1]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        end = END.encode()
        rows: list[tuple] = []
        held, want, last = 0, 0, None
        fields: dict[str, str] | None = None
        stream = bytearray()

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

        def ended():
            if fields is not None or stream.strip(b"\r\n"):
                raise ValueError(f"{last} ends inside a record")
            stream.clear()

        for batch in batches:
            files = batch.column(1).to_pylist()
            for i, piece in enumerate(batch.column(0)):
                if files[i] != last:
                    ended()
                    last = files[i]
                stream += piece.as_py()
                stream += end
                while True:
                    if fields is None:
                        at = stream.find(end)
                        if at <= 0:
                            break
                        fields = _parse(bytes(stream[:at]))
                        want = int(fields["content-length"])
                        del stream[: at + len(end)]
                    if len(stream) < want + len(end):
                        break
                    if stream[want : want + len(end)] != end:
                        raise ValueError(f"a record of {last} does not end where its Content-Length says")
                    http, _, payload = bytes(stream[:want]).partition(end)
                    del stream[: want + len(end)]
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
                    page, refers_to = fields.get("x-page-id"), fields.get("warc-refers-to", "<>")[1:-1] or None
                    size = len(payload) if kind == "response" else None
                    row = (fields["warc-record-id"][1:-1], kind, None if page is None else int(page), fields.get("warc-target-uri"), size, digest, refers_to)
                    rows.append((*row, payload) if payloads else row)
                    held += len(payload) * payloads
                    fields = None
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield flush()
                        rows, held = [], 0
        ended()
        yield flush()

    return read


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``path``; every response's payload is checked against its digest."""
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    return pieces.mapInArrow(_reader(payloads), schema)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """``(record_id, refers_to_id)`` of records whose payload an earlier page holds.

    The original of a digest is the record with the smallest page id, then record id; null page ids
    come last.  Payloads under ``MIN_REVISIT_BYTES`` stay as they are.
    """
    worth = headers.drop("refers_to_id").filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    first = F.min(F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id"), F.col("record_id")))
    originals = worth.groupBy("payload_digest").agg(first.alias("o"), F.count("*").alias("n")).filter("n > 1")
    originals = originals.select("payload_digest", F.col("o.record_id").alias("refers_to_id"))
    return worth.join(originals, "payload_digest").filter(F.col("record_id") != F.col("refers_to_id")).select("record_id", "refers_to_id")


def write_deduplicated(records: DataFrame, revisits: DataFrame, path: str) -> None:
    """Write ``records`` again with fresh headers; revisits keep the HTTP head and lose the payload.

    ``revisits`` has a row per revisit, of two short ids.  Up to ``BROADCAST_REVISITS`` of them are
    broadcast, and payloads stay where they are read; more meet the payloads by record id.
    """
    revisits = materialize(revisits, "warc-revisits")
    r = revisits.select(F.col("record_id").alias("_r"), F.col("refers_to_id").alias("_to"))
    r = F.broadcast(r) if revisits.count() <= BROADCAST_REVISITS else r
    rows = records.join(r, F.col("record_id") == F.col("_r"), "left")
    body = F.col("payload").cast("string")
    args = (F.col("record_id"), F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("payload_bytes"))
    made = F.when(F.col("_to").isNull(), _record("response", *args, body, None)).otherwise(_record("revisit", *args, None, F.col("_to")))
    _write(rows.select(made.alias("value")), path)


def deduplicate_archives(spark: SparkSession, source: str, target: str) -> None:
    """Archives in ``source`` to deduplicated ones in ``target``."""
    headers = materialize(read_archives(spark, source, payloads=False), "warc-headers")
    revisits = resolve_revisits(headers)
    write_deduplicated(read_archives(spark, source), revisits, target)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """Every record of deduplicated archives, revisits joined to the response they refer to."""
    records = materialize(read_archives(spark, path, payloads=False), "warc-resolved")
    responses = records.filter("warc_type = 'response'")
    wanted = records.filter("warc_type = 'revisit'")
    # One row a referenced response meets its revisits; a hot original is a row against many.
    o = responses.select(F.col("record_id").alias("_o"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    found = wanted.join(o, F.col("refers_to_id") == F.col("_o"))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"]
    a = responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns)
    b = found.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest"), "refers_to": F.col("_page")}).select(columns)
    return a.unionByName(b)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, clean = scratch_path(spark, "warc"), scratch_path(spark, "warc-dedup")
    write_archives(table(spark, sf_dir, "pages"), raw)
    deduplicate_archives(spark, raw, clean)
    return resolved(spark, clean)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM o
"""
