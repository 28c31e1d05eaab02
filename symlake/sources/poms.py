"""Poms as relations, read with built-in functions: no parser of its own, no Python worker.

A pom row has what matters of one file; properties, managed entries and dependencies are exploded from it. Document types are
refused (such a file, and one that is no XML, reads as an empty pom).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.model import DECLARED

_ENTRY = "struct<groupId:string,artifactId:string,version:string,classifier:string,scope:string,type:string,optional:string,exclusions:struct<exclusion:array<struct<groupId:string,artifactId:string>>>>"
_ENTRIES = f"struct<dependency:array<{_ENTRY}>>"
SCHEMA = (
    "groupId string, artifactId string, version string, parent struct<groupId:string,artifactId:string,version:string>, properties map<string,string>,"
    f" modules struct<module:array<string>>, dependencyManagement struct<dependencies:{_ENTRIES}>, dependencies {_ENTRIES}"
)
#: Substitutions in one value, as values may hold further keys.
ROUNDS = 5


def interpolate_all(value: Column, properties: Column) -> Column:
    """Every known ${key} is replaced, in up to ``ROUNDS`` rounds; unknown keys stay as they are."""

    def once(text: Column, _: Column) -> Column:
        keys = F.regexp_extract_all(text, F.lit(r"\$\{([^}]*)\}"), F.lit(1))
        plain = F.split(text, r"\$\{[^}]*\}", -1)
        known = F.transform(keys, lambda k: F.coalesce(F.try_element_at(properties, k), F.concat(F.lit("${"), k, F.lit("}"))))
        return F.array_join(F.flatten(F.zip_with(plain, known, lambda p, k: F.array(p, F.coalesce(k, F.lit(""))))), "")

    return F.when(F.contains(value, F.lit("${")), F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), value, once)).otherwise(value)


def interpolate_first(value: Column, properties: Column) -> Column:
    """The leftmost ${key} is replaced, up to ``ROUNDS`` times, until one is unknown or has no end."""

    def once(text: Column, _: Column) -> Column:
        # A key ends at the first brace behind its start, so an inner start belongs to the key's name.
        key = F.regexp_extract(text, r"(?s)^.*?\$\{([^}]*)\}", 1)
        start = F.locate("${", text)
        known = F.when(F.locate("}", F.substring(text, start, F.lit(1 << 30))) > 0, F.try_element_at(properties, key))
        return F.when((start > 0) & known.isNotNull(), F.concat(F.substring(text, F.lit(1), start - 1), known, F.substring(text, start + F.char_length(key) + 3, F.lit(1 << 30)))).otherwise(text)

    return F.when(F.contains(value, F.lit("${")), F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), value, once)).otherwise(value)


def read(files: DataFrame) -> DataFrame:
    """files (file_uri, text, ...) with a struct pom of ``SCHEMA``."""
    text = F.when(~F.col("text").rlike("(?i)<!DOCTYPE"), F.col("text"))
    return files.withColumn("pom", F.from_xml(text, SCHEMA, {"ignoreNamespace": "true", "rowTag": "project"}))


def entries(of: str) -> Column:
    """The entries of pom.dependencies or pom.dependencyManagement.dependencies; an empty array if there are none."""
    return F.coalesce(F.col(f"{of}.dependency"), F.from_json(F.lit("[]"), f"array<{_ENTRY}>"))


def own_properties() -> Column:
    """A pom's properties with its own (or its parent's) group and version, as a static reader sees them."""
    # Its coordinates win over properties of the same names.
    named = F.map_filter(F.create_map(F.lit("project.groupId"), F.coalesce("pom.groupId", "pom.parent.groupId"), F.lit("project.version"), F.coalesce("pom.version", "pom.parent.version")), lambda _, v: v.isNotNull())
    listed = F.coalesce(F.col("pom.properties"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(listed, lambda k, _: ~F.array_contains(F.map_keys(named), k)), named)


def declared(files: DataFrame) -> DataFrame:
    """``model.DECLARED`` rows of poms (file_uri, text): /project/dependencies, interpolated with the file's own properties.

    The line is that of the first groupId line that has the group's text, 0 if there is none.
    """
    rows = read(files.select("file_uri", "text")).withColumn("properties", own_properties())
    tagged = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.contains(s["x"], F.lit("<groupId>")))
    groups = F.array_distinct(F.filter(F.transform(entries("pom.dependencies"), lambda d: interpolate_all(d["groupId"], F.col("properties"))), lambda g: g.isNotNull()))
    rows = rows.select("properties", "file_uri", tagged.alias("tagged"), groups.alias("groups"), entries("pom.dependencies").alias("entries"))
    first = F.transform("groups", lambda g: F.coalesce(F.try_element_at(F.filter("tagged", lambda s: F.contains(s["x"], g)), F.lit(1))["i"], F.lit(0)))
    # Each dependency carries its group's line and not the file's lines.
    each = rows.select("file_uri", "properties", F.map_from_arrays("groups", first).alias("first"), F.posexplode("entries").alias("ordinal", "d"))
    value = lambda name: interpolate_all(F.col(f"d.{name}"), F.col("properties"))
    found = each.select(*[value(c).alias(a) for c, a in (("groupId", "g"), ("artifactId", "a"), ("version", "v"), ("classifier", "classifier"), ("scope", "scope"))], "first", "file_uri", "ordinal")
    line = F.coalesce(F.try_element_at("first", F.col("g")), F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = found.select(blank("g").alias("group_id"), blank("a").alias("artifact_id"), blank("v").alias("version"), "classifier", "scope", line.alias("line"), "file_uri", "ordinal")
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECLARED])
