"""Build files and coordinates: declared dependencies, coordinates, indexes and labels."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.sources import gradle, poms

class Coordinates(NamedTuple):
    group_id: str
    artifact_id: str
    version: str
    packaging: str
    classifier: str | None


def parse_coordinates(text: str) -> Coordinates | None:
    """g:a:packaging[:classifier]:version; three parts have no version, four no classifier."""
    parts = text.strip().split(":")
    if len(parts) < 3:
        return None
    classifier = parts[3] or None if len(parts) > 4 else None
    version = parts[4] if len(parts) > 4 else parts[3] if len(parts) > 3 else ""
    return Coordinates(parts[0], parts[1], version, parts[2], classifier)


class MavenUri(NamedTuple):
    group_id: str
    artifact_id: str
    version: str
    classifier: str | None
    directory: str | None


def parse_maven_uri(uri: str) -> MavenUri:
    """mvn://group:artifact:version[:classifier][@directory]."""
    if not uri.startswith("mvn://"):
        raise ValueError(f"not a Maven URI: {uri}")
    body, _, directory = uri.removeprefix("mvn://").partition("@")
    parts = body.split(":")
    if len(parts) < 3:
        raise ValueError(f"a Maven URI has group, artifact and version: {uri}")
    return MavenUri(parts[0], parts[1], parts[2], parts[3] if len(parts) > 3 else None, directory or None)


def jar_path(repository: str, group: str, artifact: str, version: str, classifier: str | None = None, extension: str = "jar") -> str:
    """Where a local repository keeps an artifact."""
    tail = f"-{classifier}" if classifier else ""
    return f"{repository.rstrip('/')}/{group.replace('.', '/')}/{artifact}/{version}/{artifact}-{version}{tail}.{extension}"


def declared(files: DataFrame) -> DataFrame:
    """``model.DECLARED`` rows of files (file_uri, text): poms and Gradle scripts at any depth; unreadable poms give none."""
    name = F.regexp_extract("file_uri", r"([^/]*)$", 1)
    return poms.declared(files.where(name == "pom.xml")).unionByName(gradle.declared(files.where(name == "build.gradle")))


def gradle_version(wrapper_properties: str) -> str | None:
    m = re.search(r"distributionUrl=.*gradle-([0-9][0-9.]*)-", wrapper_properties)
    return m[1] if m else None


def read_properties(text: str) -> dict[str, str]:
    """A Java properties file's plain keys."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = re.sub(r"\s*[=:]\s*", "=", line, count=1).partition("=")
            out[key] = value
    return out


def artifact_index(spark: SparkSession, path: str) -> DataFrame:
    """(sha1, group_id, artifact_id, version, packaging, classifier) of an index with lines 'sha1 g:a:p:v'."""
    line = spark.read.text(path).where(r"value rlike '^[0-9a-fA-F]{40} '")
    part = F.split(F.element_at(F.split("value", " "), 2), ":")
    five = F.size(part) > 4
    out = line.select(F.lower(F.substring("value", 1, 40)).alias("sha1"), part.alias("p"), five.alias("five")).where(F.size("p") >= 3)
    at = lambda n: F.try_element_at("p", F.lit(n))
    return out.select("sha1", at(1).alias("group_id"), at(2).alias("artifact_id"), F.coalesce(F.when(F.col("five"), at(5)).otherwise(at(4)), F.lit("")).alias("version"), at(3).alias("packaging"), F.when(F.col("five"), F.nullif(at(4), F.lit(""))).alias("classifier"))


def label_patterns(text: str) -> list[str]:
    """One regex a line; comments and blank lines are passed over."""
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]


def detect_build_tool(names: set[str], location: str) -> str:
    """gradle, maven or binary, from the file names at a location."""
    if names & {"build.gradle", "build.gradle.kts"}:
        return "gradle"
    if "pom.xml" in names:
        return "maven"
    return "binary" if location.lower().endswith((".jar", ".war", ".ear")) else "maven"


def synthetic_pom(deps: list[tuple[str, str, str]]) -> str:
    """A pom that declares the dependencies of an exploded archive."""
    from xml.sax.saxutils import escape

    one = "".join(f"    <dependency>\n      <groupId>{escape(g)}</groupId>\n      <artifactId>{escape(a)}</artifactId>\n      <version>{escape(v)}</version>\n    </dependency>\n" for g, a, v in deps)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<project xmlns="http://maven.apache.org/POM/4.0.0">\n  <modelVersion>4.0.0</modelVersion>\n  <groupId>exploded</groupId>\n  <artifactId>archive</artifactId>\n  <version>1</version>\n  <dependencies>\n'
    return head + one + "  </dependencies>\n</project>\n"
