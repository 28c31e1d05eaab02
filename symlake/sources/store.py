"""A content-addressed symbol store: a file is parsed once for each content that it ever had.

Symbols are kept under the SHA-256 of their file's text, one directory for each update. An update parses only texts whose digest
is new (once each, however many files share it); the symbols of a state of the sources are a join of its files' digests with the
store. Directories are written whole before they count, so an update that fails leaves what was there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.model import SYMBOLS
from symlake.sources import scan
from symlake.tables import exists, names_in

#: What of a symbol depends on its text alone.
KEPT = [f for f in SYMBOLS if f.name not in ("file_uri", "is_dependency")]
SYMBOL_ROWS, DIGESTS = ", ".join(["digest string", *[f"{f.name} {f.dataType.simpleString()}" for f in KEPT]]), "digest string"


class SymbolStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[str]:
        """Updates whose digests are written; these come last."""
        return [f"{self.path}/{n}" for n in sorted(names_in(self.spark, self.path)) if n.startswith("batch-") and exists(self.spark, f"{self.path}/{n}/digests/_SUCCESS")]

    def _read(self, part: str, ddl: str) -> DataFrame:
        paths = [f"{b}/{part}" for b in self._batches()]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def digests(self) -> DataFrame:
        return self._read("digests", DIGESTS)

    @staticmethod
    def keyed(files: DataFrame) -> DataFrame:
        """files (file_uri, text) with the digest of their text; a null text is like an empty one."""
        return files.select("file_uri", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))

    def update(self, files: DataFrame) -> int:
        """Parse the texts that are new; how many there were."""
        fresh = self.keyed(files).join(self.digests(), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
        fresh = fresh.select(F.col("digest").alias("file_uri"), "text").persist()
        n = fresh.count()
        if n:
            path = f"{self.path}/batch-{uuid.uuid4().hex[:12]}"
            rows = scan.symbols(fresh).withColumnRenamed("file_uri", "digest").select("digest", *[f.name for f in KEPT])
            rows.repartition("digest").sortWithinPartitions("digest").write.parquet(f"{path}/symbols")
            fresh.select(F.col("file_uri").alias("digest")).write.parquet(f"{path}/digests")
        fresh.unpersist()
        return n

    def symbols(self, files: DataFrame, is_dependency: bool = False) -> DataFrame:
        """``model.SYMBOLS`` rows of files, those that are new parsed first."""
        self.update(files)
        rows = self.keyed(files).select("file_uri", "digest").join(self._read("symbols", SYMBOL_ROWS), "digest")
        return rows.withColumn("is_dependency", F.lit(is_dependency)).select(*[f.name for f in SYMBOLS])
