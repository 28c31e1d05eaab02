"""A feed of changed files that keeps a symbol table current.

Beyond what a batch scan needs: each micro-batch of (file_uri, text, saved) replaces the rows of the files in it. Within a
batch the last change of a file counts. Rows live in one directory for each bucket of files, so that a batch rewrites
the buckets that it touches and no others; a manifest names the directories that count.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symlake.model import SYMBOLS
from symlake.sources import scan
from symlake.tables import delete, discard, file_system, materialize

BUCKETS = 64


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file_uri"), F.lit(buckets)).cast("int"))


def _manifests(spark: SparkSession, table: str) -> list[int]:
    path, system = file_system(spark, f"{table}/_state")
    if not system.exists(path):
        return []
    return sorted(int(m[1]) for f in system.listStatus(path) if (m := re.fullmatch(r"([0-9]+)[.]json", f.getPath().getName())))


def _state(spark: SparkSession, table: str, number: int) -> dict[int, str]:
    """The directory of each bucket that has rows, as a manifest tells it."""
    path, system = file_system(spark, f"{table}/_state/{number}.json")
    stream = system.open(path)
    try:
        return {int(b): v for b, v in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items()}
    finally:
        stream.close()


def _commit(spark: SparkSession, table: str, number: int, state: dict[int, str]) -> None:
    """Write a manifest under another name and rename it, which readers see at once or not at all."""
    draft, system = file_system(spark, f"{table}/_state/.{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(json.dumps(state).encode())
    out.close()
    if not system.rename(draft, file_system(spark, f"{table}/_state/{number}.json")[0]):
        raise OSError(f"the state {number} of {table} was written by another")


def _rows(spark: SparkSession, places: list[str]) -> DataFrame:
    """The rows of bucket directories, which may be of several versions."""
    return spark.read.option("recursiveFileLookup", "true").schema(SYMBOLS).parquet(*places)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table's symbols as of its newest manifest; before the first there are none."""
    known = _manifests(spark, table)
    state = _state(spark, table, known[-1]) if known else {}
    if not state:
        return spark.createDataFrame([], SYMBOLS)
    return _rows(spark, [f"{table}/{place}" for place in state.values()])


def apply(batch: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Replace the symbols of a batch's files. A null text deletes a file.

    Nothing that readers use is overwritten: touched buckets are written to a new directory, then a new manifest names
    it. A lost executor or driver leaves the old state whole. Directories that the last two manifests don't name are deleted.
    """
    spark = batch.sparkSession
    last = materialize(batch.groupBy("file_uri").agg(F.max_by("text", "saved").alias("text")), "changes")
    touched = [r[0] for r in bucketed(last, buckets).select("bucket").distinct().collect()]  # at most BUCKETS numbers
    if not touched:
        discard(last)
        return
    known = _manifests(spark, table)
    state = _state(spark, table, known[-1]) if known else {}
    merged = scan.symbols(last.where("text IS NOT NULL"))
    old = [f"{table}/{state[b]}" for b in touched if b in state]
    if old:
        merged = _rows(spark, old).join(last.select("file_uri"), "file_uri", "left_anti").select(*merged.columns).unionByName(merged)
    number = known[-1] + 1 if known else 1
    version = f"v{number}-{uuid.uuid4().hex[:8]}"
    bucketed(merged, buckets).write.partitionBy("bucket").parquet(f"{table}/{version}")
    path, system = file_system(spark, f"{table}/{version}")
    done = {int(f.getPath().getName().partition("=")[2]) for f in system.listStatus(path) if f.isDirectory()}
    new = {b: v for b, v in state.items() if b not in touched} | {b: f"{version}/bucket={b}" for b in done}
    _commit(spark, table, number, new)
    discard(last)
    _clean(spark, table, number)


def _clean(spark: SparkSession, table: str, number: int) -> None:
    """Keep what the last two manifests name."""
    held = {place.partition("/")[0] for n in (number - 1, number) if n in _manifests(spark, table) for place in _state(spark, table, n).values()}
    path, system = file_system(spark, table)
    for f in system.listStatus(path):
        name = f.getPath().getName()
        if f.isDirectory() and re.match(r"v([0-9]+)-", name) and int(name[1:].partition("-")[0]) < number and name not in held:
            delete(spark, f"{table}/{name}")
    for n in _manifests(spark, table):
        if n < number - 1:
            delete(spark, f"{table}/_state/{n}.json")


def follow(changes: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start to apply a stream of changes."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply(df, table, buckets)).start()
