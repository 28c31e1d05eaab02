"""The artifact index as a sorted table: looked up by partitions and row groups, never shuffled.

Rows lie in a partition for each of the 256 first bytes of their digest, sorted by digest, with Bloom filters on it. A look-up of few
digests asks for these as literals, so that partitions, row groups and filters prune; one of many prunes by the partitions that
occur and reads the rest sequentially, joined by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.tables import exists

#: Digests that a look-up asks for as literals, at most.
LITERALS = 1000
#: Rows that a file holds, at most.
ROWS = 5_000_000


def write(index: DataFrame, path: str) -> None:
    """Write an index (sha1, group_id, artifact_id, version, ...), digests in lower case."""
    rows = index.where("sha1 IS NOT NULL").withColumn("sha1", F.lower("sha1")).withColumn("head", F.substring("sha1", 1, 2))
    sorted_ = rows.repartition("head").sortWithinPartitions("head", "sha1")
    options = {"parquet.bloom.filter.enabled#sha1": "true", "parquet.bloom.filter.adaptive.enabled": "true", "maxRecordsPerFile": str(ROWS)}
    sorted_.write.partitionBy("head").options(**options).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def lookup(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """The rows of the index that have one of the digests (sha1)."""
    rows = spark.read.parquet(path)
    asked = digests.select(F.lower("sha1").alias("sha1")).where("sha1 IS NOT NULL").distinct()
    few = [r["sha1"] for r in asked.limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        return rows.where(F.col("head").isin(sorted({d[:2] for d in few})) & F.col("sha1").isin(sorted(few))).drop("head")
    # As many heads as there are partitions, at most 256 where digests are hexadecimal.
    heads = [r["head"] for r in asked.select(F.substring("sha1", 1, 2).alias("head")).where("head rlike '^[0-9a-f]{2}$'").distinct().collect()]
    return rows.where(F.col("head").isin(sorted(heads))).drop("head").join(asked, "sha1", "left_semi")
