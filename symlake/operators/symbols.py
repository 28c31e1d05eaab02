"""Queries on the symbol table (columns of ``model.SYMBOLS``). Results are bags: rows are never made distinct."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.patterns import anchored, erase, erased, full_match, glob_match, glob_to_regex, suffix_match
from symlake.model import DEFAULT_LOCATIONS, ERASED, Location


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _at(location: Location) -> Column:
    return F.col("location") == location.value


def bucket_predicate(pattern: str, location: Location) -> Column:
    """The predicate of one location bucket; pattern is already erased where that applies."""
    if location in (Location.FIELD, Location.METHOD) and " " in pattern:
        name, _, kind = pattern.partition(" ")
        return glob_match(F.col("name"), name.strip()) & glob_match(erased(F.col("qualified_name")), erase(kind.strip()))
    qualified = F.col("qualified_name")
    if location in (Location.METHOD, Location.METHOD_CALL):
        return suffix_match(qualified, pattern) | full_match(F.col("name"), glob_to_regex(pattern))
    return glob_match(erased(qualified) if location in ERASED else qualified, pattern)


def predicate(pattern: str, location: Location) -> Column:
    """One filter for all locations but PACKAGE: the bucket's own rule, and matching imports for types."""
    if location == Location.DEFAULT:
        bare = erase(pattern)
        return _any(_at(x) & bucket_predicate(bare, x) for x in DEFAULT_LOCATIONS)
    bucket = Location.TYPE if location == Location.TYPE_KEYWORD else location
    own = erase(pattern) if bucket in ERASED else pattern
    found = _at(bucket) & bucket_predicate(own, bucket)
    return found | (_at(Location.IMPORT) & bucket_predicate(own, Location.IMPORT)) if bucket == Location.TYPE else found


def package_rows(symbols: DataFrame) -> tuple[DataFrame, Column]:
    """Package declarations, and imports as uses of the package that they name (in name); and the package's column."""
    imported = F.regexp_replace("qualified_name", r"(\.\*|\.[^.]*)\z", "")
    package = F.when(_at(Location.IMPORT), imported).otherwise(F.col("qualified_name"))
    rows = symbols.where(F.col("location").isin(Location.PACKAGE.value, Location.IMPORT.value))
    return rows.withColumn("name", F.when(_at(Location.IMPORT), imported).otherwise(F.col("name"))), package


def packages(symbols: DataFrame, pattern: str) -> DataFrame:
    """The package rows whose package matches a glob."""
    rows, package = package_rows(symbols)
    return rows.where(glob_match(package, pattern))


def query(symbols: DataFrame, pattern: str, location: Location = Location.DEFAULT) -> DataFrame:
    """All symbols that match a glob at a location."""
    return packages(symbols, pattern) if location == Location.PACKAGE else symbols.where(predicate(pattern, location))


def returning(symbols: DataFrame, pattern: str) -> DataFrame:
    """Methods by 'nameGlob returnTypeGlob'."""
    name, _, kind = pattern.partition(" ")
    return symbols.where(_at(Location.RETURN_TYPE) & glob_match(F.col("name"), name.strip()) & glob_match(erased(F.col("qualified_name")), erase(kind.strip())))


def annotated(symbols: DataFrame, pattern: str | None, elements: Mapping[str, str] | None = None) -> DataFrame:
    """Symbols with an annotation that matches the glob, if any, and has all elements, each matching its regex in full."""

    def fits(a: Column) -> Column:
        ok = glob_match(a["qualified_name"], pattern) if pattern else F.lit(True)
        for key, regex in (elements or {}).items():
            ok &= F.coalesce(F.element_at(a["elements"], key).rlike(anchored(regex)), F.lit(False))
        return ok

    return symbols.where(F.coalesce(F.exists("annotations", fits), F.lit(False)))


def in_files(symbols: DataFrame, files: DataFrame | Iterable[str]) -> DataFrame:
    """Symbols in the files: a DataFrame (file_uri) is semi-joined, a list of names or URIs becomes a filter."""
    if isinstance(files, DataFrame):
        return symbols.join(files.select("file_uri"), "file_uri", "left_semi")
    wanted = [f if f.startswith("file:") else "file://" + f for f in files]
    return symbols.where(F.col("file_uri").isin(wanted))


def without_dependencies(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.coalesce("is_dependency", F.lit(False)))


def incidents(matches: DataFrame) -> DataFrame:
    """The answer's rows: line numbers from 1, spans from 0 (none where all four coordinates are 0)."""
    span = (F.col("line") != 0) | (F.col("start_char") != 0) | (F.col("end_line") != 0) | (F.col("end_char") != 0)
    place = lambda line, char: F.when(span, F.struct(F.col(line).alias("line"), F.col(char).alias("character")))
    return matches.select("file_uri", (F.col("line") + 1).cast("bigint").alias("line_number"), "kind", "name", F.col("file_uri").alias("file"), F.col("package_name").alias("package"), place("line", "start_char").alias("start"), place("end_line", "end_char").alias("end"), F.lit(False).alias("is_dependency_incident"))


def referenced(symbols: DataFrame, pattern: str, location: Location = Location.DEFAULT, annotation: str | None = None, elements: Mapping[str, str] | None = None, files: DataFrame | Iterable[str] | None = None, annotate_return_types: bool = False, dependency_rows: bool = False) -> DataFrame:
    """A whole condition: matches, filters, incidents.

    METHOD patterns with a space search return types and ignore annotations unless annotate_return_types is set.
    """
    by_return = location == Location.METHOD and " " in pattern
    found = returning(symbols, pattern) if by_return else query(symbols, pattern, location)
    if (annotation or elements) and (annotate_return_types or not by_return):
        found = annotated(found, annotation, elements)
    if location == Location.IMPORT:
        found = found.where("kind = 'Module'")
    if files is not None:
        found = in_files(found, files)
    return incidents(found if dependency_rows else without_dependencies(found))
