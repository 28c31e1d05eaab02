"""Source lines around a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 10


def lines_of(text: Column) -> Column:
    """A text's lines; a line end at the end begins no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "\n\\z", ""), "\n", -1)


def snippet(lines: Column, line: Column, context: int = CONTEXT) -> Column:
    """Lines around a 0-based line, each behind a line end, its right-aligned number and two spaces."""
    first = F.greatest(F.lit(0), line - context)
    last = F.least(F.size(lines), line + context + 1)
    width = F.char_length(last.cast("string"))
    picked = F.when(last > first, F.slice(lines, first + 1, last - first)).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(picked, lambda text, i: F.concat(F.lit("\n"), F.lpad((first + i + 1).cast("string"), width, " "), F.lit("  "), text))
    return F.array_join(numbered, "")


def snippets(incidents: DataFrame, sources: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Incidents with a code_snip; sources are (file_uri, text). Unknown files get null."""
    texts = sources.select("file_uri", lines_of(F.col("text")).alias("source_lines"))
    joined = incidents.join(texts, "file_uri", "left")
    return joined.withColumn("code_snip", snippet(F.col("source_lines"), (F.col("line_number") - 1).cast("int"), context)).drop("source_lines")
