"""Weighted rendezvous sharding, in built-in functions alone.

Every (key, shard) pair gets a hash u in (0, 1); a record goes to the shard with the smallest
-ln(u) / weight. That is a race of exponential clocks: shard j wins with probability
weight_j / sum(weights), and a further shard takes only the records whose race it wins, so no record
moves between old shards. Equal values go to the smaller shard number.

Rows that repeat each other are counted before the shuffle, take a range of slots and become rows again in chunks, so
that no task meets all rows of a hot key.

Edge cases: a null key hashes as the empty string; a null text counts as no bytes; rows that repeat a
key land in one shard and get slots of their own; very long texts count by their bytes and are read once; empty input
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.common import materialize, project, table

SHARDS = 24
#: Sub-ranges of a shard that are numbered independently, at least, and the rows that one should have: a task sorts
#: them to give out slots.
BUCKETS, BUCKET_ROWS = 64, 1_000_000
#: Copies of a repeated row that one task makes.
COPIES = 100_000
ROW_OVERHEAD = 8


def _hex_number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def race(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The time at which a shard's clock rings for a key."""
    n = _hex_number(F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary")), 1, 13)
    return -F.log((n.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard among 0 .. len(weights) - 1 that wins a key's race. Weights of 0 or less are refused."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive and at least one")
    times = F.array(*[F.struct(race(key, j, w).alias("t"), F.lit(j).alias("shard")) for j, w in enumerate(weights)])
    return F.array_min(times)["shard"]


def assign(df: DataFrame, key: str, text: str, weights: Sequence[float], grown_by: float = 1.0, buckets: int | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row.

    grown_shard is the shard after one more shard of weight grown_by joins. Slots are gapless: rows are
    numbered within (shard, bucket of the key's hash), then shifted by the sizes of the earlier buckets. Buckets
    follow from the number of rows; their sizes, a row for each million rows or at most BUCKETS a shard, are broadcast.
    """
    buckets = buckets or max(BUCKETS, df.count() // (len(weights) * BUCKET_ROWS))
    rows = project(df, key=key, text=text)
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    times = F.array(*[F.struct(race(name, j, w).alias("t"), F.lit(j).alias("shard")) for j, w in enumerate(weights)])
    last = race(name, len(weights), grown_by)
    place = ["key", "size", "text_crc32", "shard", "grown_shard", "bucket"]
    keyed = rows.select("key", (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.array_min(times).alias("best"), last.alias("last"), F.pmod(_hex_number(F.md5(name.cast("binary")), 1, 8), F.lit(buckets)).alias("bucket"))
    keyed = keyed.select("key", "size", "text_crc32", F.col("best.shard").alias("shard"), F.when(F.col("last") < F.col("best.t"), F.lit(len(weights))).otherwise(F.col("best.shard")).alias("grown_shard"), "bucket")
    counted = materialize(keyed.groupBy(*place).agg(F.count("*").alias("n")), "counted")
    sizes = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("nth", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(shifts), ["shard", "bucket"])
    chunks = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("chunk")).repartition("key", "chunk")
    copies = chunks.select("*", F.explode(F.sequence("chunk", F.least(F.col("chunk") + COPIES, F.col("n")) - 1)).alias("copy"))
    return copies.select("key", "size", "text_crc32", "shard", (F.col("nth") + F.col("shift") + F.col("copy")).cast("bigint").alias("slot"), "grown_shard")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 (polynomial EDB88320) of a list of bytes, eight shift steps a byte.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def crc_sql(of: str) -> str:
    """DuckDB SQL for the CRC-32 of a BLOB expression, through a table of 256 values that SQL computes."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length({of})), lambda i: ('0x' || substr(hex({of}), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, crc_t[(xor(a, b) & 255) + 1])), 4294967295)"


CRC_TABLE_SQL = (
    "WITH RECURSIVE crc_steps AS (SELECT range::BIGINT AS b, range::BIGINT AS v, 0 AS k FROM range(256)"
    f" UNION ALL SELECT b, {_STEP.format('v')}, k + 1 FROM crc_steps WHERE k < 8),"
    " crc_table AS (SELECT list(v ORDER BY b) AS crc_t FROM crc_steps WHERE k = 8)"
)

SQL = f"""
{CRC_TABLE_SQL},
races AS (
  SELECT doc_id, s.range::INTEGER AS shard, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || s.range::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0) AS t
  FROM documents, range({SHARDS + 1}) s),
won AS (
  SELECT doc_id, arg_min(shard, (t, shard)) FILTER (shard < {SHARDS}) AS shard, arg_min(shard, (t, shard)) AS grown_shard FROM races GROUP BY doc_id),
docs AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents)
SELECT doc_id, octet_length(body)::BIGINT + {ROW_OVERHEAD} AS size, {crc_sql('body')} AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {BUCKETS}, doc_id) - 1 AS slot, grown_shard
FROM docs JOIN won USING (doc_id), crc_table
"""
