"""Many rules against one symbol table.

Globs are sorted on the driver. Those without special characters, and those whose only one is a star at the end, become
keys: a symbol offers its own name and its prefixes of the lengths that occur, and one hash join finds the rules.
The others become literal predicates, some dozens in a pass over the bucket they search, whose regexes the JVM
compiles once. Symbols are never paired with rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.patterns import erase, erased, glob_match
from symlake.model import DEFAULT_LOCATIONS, ERASED, Location
from symlake.operators.symbols import bucket_predicate, package_rows, without_dependencies

CHUNK = 128
#: Keys that are broadcast, at most; a longer list is joined by hash.
BROADCAST = 100_000
_BY_SUFFIX = (Location.METHOD, Location.METHOD_CALL)
#: What stands behind a whole name, so that it differs from a prefix.
_END = "\u0000"
#: Characters that a star doesn't match.
_LINE_ENDS = "[\\n\\r\\u0085\\u2028\\u2029]"


class Rule(NamedTuple):
    rule_id: str
    pattern: str
    location: Location = Location.DEFAULT


def buckets(location: Location) -> tuple[Location, ...]:
    """The buckets of the symbol table that a rule searches."""
    if location == Location.DEFAULT:
        return DEFAULT_LOCATIONS
    if location in (Location.TYPE, Location.TYPE_KEYWORD):
        return (Location.TYPE, Location.IMPORT)
    return (location,)


def _pattern(rule: Rule, bucket: Location) -> str:
    wide = rule.location == Location.DEFAULT
    return erase(rule.pattern) if wide or bucket in ERASED else rule.pattern


def _key(pattern: str) -> str | None:
    """The key of a pattern that is a name or a prefix."""
    head = pattern.removesuffix("*")
    if set(head) & set("*?(|) "):
        return None
    return head if head != pattern else pattern + _END


def _keys(lengths: Sequence[int]) -> Column:
    """What a symbol may be found by: names in full, and prefixes of the given lengths."""
    qualified, parts = F.col("qualified_name"), F.split("qualified_name", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = F.when(F.col("location").isin([x.value for x in _BY_SUFFIX]), F.array_append(suffixes, F.col("name"))).when(F.col("location").isin([x.value for x in ERASED]), F.array(erased(qualified))).otherwise(F.array(qualified))
    cuts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    def of(name: Column) -> Column:
        fits = F.filter(cuts, lambda n: (n <= F.char_length(name)) & ~F.substring(name, n + 1, 1 << 30).rlike(_LINE_ENDS))
        return F.array_append(F.transform(fits, lambda n: F.substring(name, F.lit(1), n)), F.concat(name, F.lit(_END)))

    return F.array_distinct(F.flatten(F.transform(F.filter(names, lambda n: n.isNotNull()), of)))


def match_rules(symbols: DataFrame, rules: Sequence[Rule], chunk: int = CHUNK) -> DataFrame:
    """(rule_id, all symbol columns) for each rule and symbol that match; names are rewritten for PACKAGE rules as in packages()."""
    rows = without_dependencies(symbols)
    names = rows.columns
    keyed: list[tuple[str, str, str]] = []
    other: dict[Location, list[tuple[str, str]]] = defaultdict(list)
    of_packages = [r for r in rules if r.location == Location.PACKAGE]
    for rule in rules:
        for bucket in buckets(rule.location) if rule.location != Location.PACKAGE else ():
            pattern = _pattern(rule, bucket)
            key = _key(pattern)
            if key is None:
                other[bucket].append((rule.rule_id, pattern))
            else:
                keyed.append((rule.rule_id, key, bucket.value))
    parts: list[DataFrame] = []
    if keyed:
        table = symbols.sparkSession.createDataFrame(keyed, "rule_id string, rule_key string, rule_location string")
        table = F.broadcast(table) if len(keyed) <= BROADCAST else table
        lengths = sorted({len(k) for _, k, _ in keyed if not k.endswith(_END)})
        asked = rows.where(F.col("location").isin(sorted({b for _, _, b in keyed}))).select("*", F.explode(_keys(lengths)).alias("symbol_key"))
        parts.append(asked.join(table, (F.col("symbol_key") == F.col("rule_key")) & (F.col("location") == F.col("rule_location"))).select("rule_id", *names))
    for bucket, own in other.items():
        for some in _chunks(own, chunk):
            hits = F.array_compact(F.array(*[F.when(bucket_predicate(p, bucket), F.lit(i)) for i, p in some]))
            parts.append(rows.where(F.col("location") == bucket.value).select(F.explode(hits).alias("rule_id"), *names))
    for some in _chunks([(r.rule_id, r.pattern) for r in of_packages], chunk):
        named, package = package_rows(rows)
        hits = F.array_compact(F.array(*[F.when(glob_match(package, p), F.lit(i)) for i, p in some]))
        parts.append(named.select(F.explode(hits).alias("rule_id"), *names))
    if not parts:
        return rows.limit(0).select(F.lit("").alias("rule_id"), *names)
    return reduce(DataFrame.unionByName, parts)


def _chunks(rules: list[tuple[str, str]], size: int) -> Iterable[list[tuple[str, str]]]:
    return (rules[i : i + size] for i in range(0, len(rules), size))
