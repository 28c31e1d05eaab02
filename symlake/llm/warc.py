"""WARC writing, reading and transaction assembly.

Writing: every page gives a request, a response (or revisit) and a metadata record. Spark's text writer
puts them into gzipped WARC files: a record is a line that ends with CR LF CR LF, as the format wants.
Reading: whole files are parsed by their Content-Length fields. Assembly: request and metadata records
name their response in WARC-Concurrent-To; all records of a capture are joined on that identifier, in one
grouped pass, into one nested row.

Payload equality is that of SHA-256. Of equal payloads of at least ``least`` bytes the smallest page id is the
response, the others revisit it.

Edge cases: null html is an empty payload, a null url an empty target; rows that repeat id, url and html are
captures of their own, told apart by an ordinal in the record id; rows that share the first visit's id are responses
like it; line breaks in urls are percent-encoded; a null id comes last among equals; an empty table gives no rows; very long payloads get archives
of few records; a truncated or malformed archive raises an error and is never skipped.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import materialize, new_path, project, table

LEAST = 100
#: Longest payload and records in one archive file: bounds what a reading task holds.
SIZES = [(1 << 16, 6000), (1 << 20, 375), (1 << 62, 3)]
#: Copies of a repeated row that one task writes.
COPIES = 1000
CRLF = "\r\n"


def _uuid(of: Column) -> Column:
    h = F.md5(of.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last CR LF CR LF, which the writer adds."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    return F.concat(*lines, F.lit(CRLF), block)


def records(pages: DataFrame, key: str, url: str, html: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The records of all pages, three to a row, as an array."""
    rows = project(pages, key=key, url=url, html=html).select("key", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    name = F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("digest"), F.md5(F.col("url").cast("binary")))
    rows = rows.withColumn("name", name)
    heads = materialize(rows.select("key", "digest", "n", "name"), "heads")
    # The first of equal payloads, found without their bytes; only groups of two or more are joined.
    least_of = F.min(F.when(F.col("n") >= least, F.struct(F.col("key").isNull().alias("nul"), "key", "name")))
    firsts = heads.groupBy("digest").agg(least_of.alias("first"), F.count("*").alias("size")).where("size > 1")
    firsts = materialize(firsts.select("digest", F.col("first.key").alias("first_key"), F.col("first.name").alias("first_name")), "firsts")
    rows = _numbered(rows, heads, firsts).join(firsts, "digest", "left").withColumn("rid", _uuid(F.col("name")))
    first_rid = F.when(F.col("first_name").isNotNull(), _uuid(F.col("first_name")))
    rows = rows.withColumn("first_rid", first_rid)
    name = F.col("name")
    again = F.col("first_rid").isNotNull() & ~F.col("first_key").eqNullSafe(F.col("key"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    when = F.lit(date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    own = lambda suffix: _uuid(F.concat(name, F.lit(suffix)))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", own("|request")), ("WARC-Target-URI", uri), ("WARC-Date", when), ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}Accept: */*{CRLF}{CRLF}")))
    response = _record([("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", F.col("rid")), ("WARC-Target-URI", uri), ("WARC-Date", when), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", F.when(again, F.col("first_rid"))), ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html"))))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own("|metadata")), ("WARC-Target-URI", uri), ("WARC-Date", when), ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/warc-fields"))], fields)
    out = rows.select("n", F.array(request, response, metadata).alias("records"))
    out._longest = heads.agg(F.max("n")).first()[0] or 0
    return out


def _numbered(rows: DataFrame, heads: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows; of those that repeat each other, the second and later ones have an ordinal in their name.

    Copies are counted and made anew, so that no task meets all copies of a row.
    """
    copies = heads.join(firsts.select("digest"), "digest", "left_semi").groupBy("name").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = materialize(copies, "copies")
    if copies.isEmpty():
        return rows
    columns = ["key", "url", "html", "digest", "n", "name"]
    single = rows.join(copies, "name", "left_anti").select(*columns)
    one = rows.join(copies, "name").groupBy("name", "copies").agg(F.first(F.struct(*columns[:5])).alias("row"))
    many = one.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("start")).repartition("name", "start")
    many = many.select("name", "row", F.explode(F.sequence("start", F.least(F.col("start") + COPIES, F.col("copies")) - 1)).alias("k"))
    numbered = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("name", F.lit("|"), F.col("k").cast("string")))
    return single.unionByName(many.select("row.*", numbered.alias("name")))


def write(recs: DataFrame, path: str, sizes: list[tuple[int, int]] = SIZES) -> None:
    """Gzipped archives below a path, those of long payloads with few records each."""
    low = -1
    for high, per_file in sizes:
        if low < recs._longest or low < 0:
            flat = recs.where((F.col("n") > low) & (F.col("n") <= high)).select(F.explode("records").alias("value"))
            flat.write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        low = high


RECORD_SCHEMA = "type string, rid string, concurrent string, uri string, date string, refers string, digest string, page_id long, payload_bytes long, payload_sha256 string, payload binary"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
        start, size = end + 4, int(head["content-length"])
        block = data[start : start + size]
        if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"truncated WARC record at byte {at}")
        yield head, block
        at = start + size + 4


def _row(head: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    kind, page_id, size, sha, payload = head.get("warc-type"), None, None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size, sha = len(payload), hashlib.sha256(payload).hexdigest()
        if kind == "revisit":  # the headers of the first visit tell the full payload's length
            size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            sha = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    elif kind == "metadata":
        text = block.decode().partition("page-id:")[2].strip()
        page_id = int(text) if text else None
    return kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), head.get("warc-payload-digest"), page_id, size, sha, payload if keep_payload else None


def _parse_files(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            data = content.as_buffer().to_pybytes()
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            rows = []
            for head, block in parse(data):
                rows.append(_row(head, block, keep_payload))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives below a path, with digests computed from the payloads that are read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: _parse_files(batches, keep_payload), RECORD_SCHEMA)


def assemble(recs: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, response, request and metadata as nested records.

    Records without a response are captures whose response is null.
    """
    whole = F.struct(*[F.col(x.split()[0]) for x in RECORD_SCHEMA.split(", ")])
    kinds = {"response": F.col("type").isin("response", "revisit"), "request": F.col("type") == "request", "metadata": F.col("type") == "metadata"}
    return recs.groupBy(F.coalesce("concurrent", "rid").alias("capture_id")).agg(*[F.max(F.when(is_kind, whole)).alias(k) for k, is_kind in kinds.items()])


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    captures = assemble(read(spark, path, keep_payload=False)).where("response IS NOT NULL")
    captures = materialize(captures, "captures")
    flat = captures.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha256").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers").alias("refers"))
    visits = flat.where("record_type = 'revisit'")
    firsts = captures.where("response.type = 'response'").select(F.col("capture_id").alias("refers"), F.col("metadata.page_id").alias("refers_to"))
    linked = visits.join(firsts, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return flat.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(linked)


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM w
"""
