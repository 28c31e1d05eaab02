"""Helpers that the operators share: intermediate tables, column projection, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.tables import discard, materialize, new_path

__all__ = ["components", "discard", "materialize", "new_path", "project", "release", "table"]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose DataFrames are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def project(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under internal names; extra columns can't clash with an operator's own."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(alias) for alias, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", on_round: Callable[[int], None] | None = None) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node.

    Alternating large-star and small-star steps: each step only re-hangs edges on smaller neighbours,
    so a component of n nodes converges in O(log n) rounds and no task ever holds one. Every round is a
    grouped minimum (combined before the shuffle) and a join of tables, which Spark splits at hot nodes. No step
    adds edges, so their first number sizes all tables. Self loops are ignored; an empty edge list gives no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size, round_ = e.count(), 0
    while size and not _are_stars(e):
        # Large star: hang every larger neighbour of u on the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", 2 * size)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large", size)
        # Small star: hang u and its smaller neighbours on the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low", size)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = materialize(small.where("u <> v").distinct(), "stars", 2 * size)
        discard(e, low, large, least)
        e = stars
        round_ += 1
        if on_round:
            on_round(round_)
    release(edges.sparkSession)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = materialize(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", 2 * size)
    discard(e)
    return out


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: each edge then leads to its component's smallest node."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    # Counted in one job: a look for a first row would take several where there is none.
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").count() == 0
