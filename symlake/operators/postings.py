"""Infix globs by postings of names: three-letter pieces of every name beside the symbol table.

The index holds the symbols by location and shard of their name, and for each distinct name its pieces, sorted by piece, so that
a look-up reads the row groups of some pieces instead of a bucket. What a glob says literally between its wildcards must be in a
match: names that have all these pieces are candidates, the glob's own predicate verifies them, and the symbols of the names that are left
are read from their shards alone. A choice is taken apart into globs of its own first. A glob that says nothing of three letters is
answered from the bucket.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.functions.patterns import Items, _has_choice, _parse
from symlake.model import Location
from symlake.operators.symbols import predicate, query

GRAM, SHARDS = 3, 16
#: Globs that a choice is taken apart into, at most, and pieces asked for of each.
ALTERNATIVES, ASKED = 64, 8


class Index(NamedTuple):
    symbols: DataFrame
    postings: DataFrame


def _shard() -> Column:
    return F.pmod(F.xxhash64("qualified_name"), F.lit(SHARDS)).cast("int")


def build(symbols: DataFrame, path: str) -> Index:
    """Write the symbols and the postings of their names below a path."""
    rows = symbols.withColumn("shard", _shard())
    rows.repartition("location", "shard").write.partitionBy("location", "shard").parquet(f"{path}/symbols")
    names = symbols.select("location", "qualified_name", "name").distinct().withColumn("shard", _shard())
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - GRAM + 1), lambda i: F.substring(c, i, F.lit(GRAM))))
    of = lambda c, kind: F.when(F.char_length(c) >= GRAM, F.transform(pieces(c), lambda g: F.struct(g.alias("gram"), F.lit(kind).alias("kind"))))
    both = F.flatten(F.array_compact(F.array(of(F.col("qualified_name"), "q"), of(F.col("name"), "n"))))
    posted = names.select("location", "shard", "qualified_name", "name", F.explode(both).alias("p")).select("location", "shard", "qualified_name", "name", "p.*")
    # Of one location and piece the rows lie together, in files of ranges of pieces.
    posted.repartitionByRange("location", "gram", "qualified_name").sortWithinPartitions("location", "gram").write.partitionBy("location").parquet(f"{path}/postings")
    return read(symbols.sparkSession, path)


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/symbols"), spark.read.parquet(f"{path}/postings"))


def _choices(items: Items) -> list[str]:
    """The ways to read a choice's inside; inner groups are text."""

    def text(x: str | Items) -> str:
        return x if isinstance(x, str) else "(" + "".join(map(text, x)) + ")"

    out = [""]
    for x in items:
        if isinstance(x, str) and x == "|":
            out.append("")
        elif not isinstance(x, str) and _has_choice(x):
            out[-1] += "?"  # the pipe parts inner groups too; nothing is said of them
        else:
            out[-1] += text(x)
    return out


def literals(glob: str) -> list[list[str]] | None:
    """What must be in a match, for each alternative of a glob; None if there are too many alternatives."""
    parts: list[list[str]] = []
    for x in _parse(glob):
        if isinstance(x, str):
            parts.append([x])
        elif _has_choice(x):
            # With a group inside that a pipe parts, alternatives are no longer told apart by the outer pipes alone.
            parts.append(["*"] if any(not isinstance(y, str) and _has_choice(y) for y in x) else _choices(x))
        else:
            parts.append(["(" + "".join(_choices(x)) + ")"])
    many = reduce(lambda n, p: n * len(p), parts, 1)
    if many > ALTERNATIVES:
        return None
    return [[run for run in "".join(way).replace("?", "*").split("*") if len(run) >= GRAM] for way in product(*parts)]


def pieces_of(glob: str) -> list[list[str]] | None:
    """The pieces that a match has, for each alternative; None where one says nothing."""
    ways = literals(glob)
    if ways is None:
        return None
    out = [list(dict.fromkeys(run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)))[:ASKED] for runs in ways]
    return out if all(out) else None


def candidates(postings: DataFrame, pattern: str, location: Location) -> DataFrame | None:
    """(shard, qualified_name, name) that have the pieces of a glob and match it; None if it says too little, or of several buckets."""
    wanted = pieces_of(pattern.partition("<")[0] if location != Location.PACKAGE else pattern)
    if wanted is None or location in (Location.DEFAULT, Location.TYPE, Location.TYPE_KEYWORD, Location.PACKAGE) or " " in pattern:
        return None
    every = sorted({g for way in wanted for g in way})
    found = postings.where((F.col("location") == location.value) & F.col("gram").isin(every))
    per = found.groupBy("location", "shard", "qualified_name", "name", "kind").agg(F.collect_set("gram").alias("grams"))
    has = lambda way: reduce(lambda a, b: a & b, [F.array_contains("grams", g) for g in way])
    some = per.where(reduce(lambda a, b: a | b, [has(way) for way in wanted]))
    return some.where(predicate(pattern, location)).select("shard", "qualified_name", "name").distinct()


def search(index: Index, pattern: str, location: Location) -> DataFrame:
    """Like ``symbols.query``, by postings where the glob allows it."""
    names = candidates(index.postings, pattern, location)
    rows = index.symbols
    if names is None:
        return query(rows, pattern, location).drop("shard")
    known = names.toDF("name_shard", "wanted", "wanted_name")
    same = (F.col("shard") == F.col("name_shard")) & (F.col("qualified_name") == F.col("wanted")) & F.col("name").eqNullSafe(F.col("wanted_name"))
    # The shards of the few names prune the symbols' partitions when the join runs.
    return rows.where(F.col("location") == location.value).join(known, same, "left_semi").drop("shard")
