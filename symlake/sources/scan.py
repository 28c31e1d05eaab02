"""Source trees as symbol rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from symlake.model import PARSE_ERRORS, SYMBOLS
from symlake.sources.java_extract import extract

#: Directories that an application scan passes over, at any depth (fixed values).
SKIPPED = [".mvn", ".git", ".gradle", ".settings", ".idea", ".vscode", "node_modules", "target", "build", "dist", ".venv", "venv", "vendor"]
#: Emitted rows in an Arrow batch.
ROWS = 2000


def file_uri(path: Column) -> Column:
    """file:/x as file:///x; other schemes stay."""
    return F.regexp_replace(path, "^file:/(?!/)", "file:///")


def read_files(spark: SparkSession, root: str, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """(file_uri, text) of all files below a root that match a name pattern."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select(file_uri(F.col("path")).alias("file_uri"), F.decode("content", encoding).alias("text"))


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path) of all files below a root that match a name pattern; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select(file_uri(F.col("path")).alias("path"))


def relative(uri: Column, root: str) -> Column:
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    at = F.locate(base, uri)
    return F.when(at > 0, F.substring(uri, at + len(base), F.lit(1 << 20))).otherwise(uri)


def app_files(spark: SparkSession, root: str, included: Iterable[str] = (), encoding: str = "UTF-8") -> DataFrame:
    """Java files of an application: not below skipped directories, and ending in an included path if any is given."""
    path = relative(F.col("file_uri"), root)
    files = read_files(spark, root, "*.java", encoding).where(~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(s) for s in SKIPPED])))
    wanted = list(included)
    return files.where(reduce(lambda a, b: a | b, [path.endswith(w) for w in wanted])) if wanted else files


def dependency_files(spark: SparkSession, root: str) -> DataFrame:
    return read_files(spark, root, "*.java")


def _extracted(batches: Iterator[pa.RecordBatch], is_dependency: bool, errors: bool) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(PARSE_ERRORS if errors else SYMBOLS)
    for batch in batches:
        out: list[tuple] = []
        for uri, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows, trouble = extract(text or "")
            except Exception as e:  # a file never stops a scan; it is listed
                rows, trouble = [], [f"{type(e).__name__}: {e}"]
            out += [(uri, t) for t in trouble] if errors else [(*r[:4], uri, *r[4:9], _maps(r.annotations), is_dependency, k) for k, r in enumerate(rows)]
            if len(out) >= ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)


def _maps(annotations: list[dict]) -> list[dict]:
    """Annotations whose elements are lists of pairs, which Arrow takes for maps."""
    return [{**a, "elements": list(a["elements"].items())} for a in annotations] if annotations else []


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt over all cores where they come in fewer parts: parsing takes far longer than moving them."""
    n = files.sparkSession.sparkContext.defaultParallelism
    return files if files.rdd.getNumPartitions() >= n else files.repartition(n, "file_uri")


def symbols(files: DataFrame, is_dependency: bool = False) -> DataFrame:
    """``model.SYMBOLS`` rows of files (file_uri, text)."""
    return spread(files.select("file_uri", "text")).mapInArrow(lambda b: _extracted(b, is_dependency, False), SYMBOLS)


def parse_errors(files: DataFrame) -> DataFrame:
    """(file_uri, error) for the parts of files that couldn't be read."""
    return files.select("file_uri", "text").mapInArrow(lambda b: _extracted(b, False, True), PARSE_ERRORS)


def write_symbols(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table partitioned by location, so that a condition reads its buckets only."""
    rows.repartition("location", "file_uri").sortWithinPartitions("qualified_name").write.partitionBy("location").mode(mode).parquet(path)
