"""Many dependency conditions against one relation: interval stabbing on version keys.

All bounds together cut the order of versions into elementary pieces (each bound, and what lies between two). A condition covers a
run of pieces, which a segment tree over them writes as a few nodes; a dependency finds its piece by binary search and offers
the nodes above it. So conditions and dependencies meet in one hash join on (name, node), whose rows are matches only: a condition
has at most two nodes a level, a dependency one.

Names: exact ones are part of the key; regular expressions are literal predicates, some dozens a pass, that add their number to
the names a dependency offers; a condition without a name is offered to all. A dependency without a version is in all bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.patterns import full_match
from symlake.functions.versions import version_key
from symlake.operators.deps import dependency_name

#: Keys that are broadcast, at most; a longer list is joined by hash.
BROADCAST = 100_000
#: The node that unknown versions offer.
ANYWHERE = 0


class Condition(NamedTuple):
    cond_id: str
    name: str | None = None
    name_regex: str | None = None
    lower: str | None = None
    upper: str | None = None


def nodes(first: int, last: int, size: int) -> list[int]:
    """The segment tree nodes (1 is the root, leaves start at size) that cover leaves first to last, if there are any."""
    out = []
    a, e = first + size, last + size + 1
    while a < e:
        if a & 1:
            out.append(a)
            a += 1
        if e & 1:
            e -= 1
            out.append(e)
        a, e = a // 2, e // 2
    return out


def _below(keys: Column, key: Column, n: int) -> Column:
    """How many of n ascending keys are less than a key, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = (s["lo"] < s["hi"]) & (F.element_at(keys, F.least(mid + 1, F.lit(n))) < key)
        return F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n).bit_length())), start, halve, lambda s: s["lo"])


def _kept(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once, however often later expressions use it."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _offered(versions: DataFrame, bounds: list[str], size: int) -> DataFrame:
    """(version, nodes) of distinct versions: the nodes above each one's piece; piece 2i lies before bound i, piece 2i + 1 is bound i."""
    unknown = F.col("version").isNull() | (F.col("version") == "")
    if not bounds:
        return versions.select("version", F.when(unknown, F.array(F.lit(ANYWHERE))).otherwise(F.array(F.lit(1))).alias("nodes"))
    keys, n = F.array(*[F.lit(b) for b in bounds]), len(bounds)
    rows = _kept(versions, "key", F.coalesce(version_key(F.col("version")), F.lit("")))
    rows = _kept(rows, "at", _below(keys, F.col("key"), n))
    rows = _kept(rows, "leaf", size + 2 * F.col("at") + F.when((F.col("at") < n) & (F.element_at(keys, F.least(F.col("at") + 1, F.lit(n))) == F.col("key")), 1).otherwise(0))
    above = F.transform(F.sequence(F.lit(0), F.lit(size.bit_length() - 1)), lambda k: F.floor(F.col("leaf") / F.pow(F.lit(2.0), k)).cast("int"))
    return rows.select("version", F.when(unknown, F.array(F.lit(ANYWHERE))).otherwise(above).alias("nodes"))


def match(deps: DataFrame, conditions: Sequence[Condition], chunk: int = 128) -> DataFrame:
    """(cond_id, all columns of deps) for each dependency (group_id, artifact_id, version, ...) and condition that match."""
    spark = deps.sparkSession
    names = deps.columns
    given = sorted({b for c in conditions for b in (c.lower, c.upper) if b is not None})
    # The conditions' own bounds, as many as they are.
    keyed = {r["b"]: r["k"] for r in spark.createDataFrame([(b,) for b in given], "b string").select("b", version_key(F.col("b")).alias("k")).collect()} if given else {}
    bounds = sorted(set(keyed.values()))
    place = {k: 2 * i + 1 for i, k in enumerate(bounds)}
    size = 1 << (2 * len(bounds)).bit_length()
    regexes = sorted({c.name_regex for c in conditions if c.name is None and c.name_regex is not None})
    number = {r: f"r{i}" for i, r in enumerate(regexes)}
    rows = []
    for c in conditions:
        key = f"n{c.name}" if c.name is not None else number[c.name_regex] if c.name_regex is not None else "*"
        first = place[keyed[c.lower]] if c.lower is not None else 0
        last = place[keyed[c.upper]] if c.upper is not None else 2 * len(bounds)
        # Without bounds the root says all; unknown versions match whatever the bounds.
        rows += [(c.cond_id, key, n) for n in {ANYWHERE, *(nodes(first, last, size) if bounds else [1])}]
    if not rows:
        return deps.limit(0).select(F.lit("").alias("cond_id"), *names)
    table = spark.createDataFrame(rows, "cond_id string, name_key string, node int")
    table = F.broadcast(table) if len(rows) <= BROADCAST else table
    own = [F.array(F.concat(F.lit("n"), dependency_name()))]
    if any(c.name is None and c.name_regex is None for c in conditions):
        own.append(F.array(F.lit("*")))
    for at in range(0, len(regexes), chunk):
        own.append(F.array_compact(F.array(*[F.when(full_match(dependency_name(), r), F.lit(number[r])) for r in regexes[at : at + chunk]])))
    known = _offered(deps.select("version").distinct(), bounds, size).withColumnRenamed("version", "its_version")
    asked = deps.withColumn("name_key", F.explode(F.flatten(F.array(*own)))).where("name_key IS NOT NULL")
    # Only names that some condition has go on to versions.
    wanted = table.select("name_key").distinct()
    asked = asked.join(F.broadcast(wanted) if len(rows) <= BROADCAST else wanted, "name_key", "left_semi")
    asked = asked.join(known, F.col("version").eqNullSafe(F.col("its_version"))).withColumn("node", F.explode("nodes"))
    return asked.join(table, ["name_key", "node"]).select("cond_id", *names)
