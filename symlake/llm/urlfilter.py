"""Temporal list join: dated list entries, and an as-of decision for every capture.

A list is a log of dated actions on patterns: (pattern, effective, action 'add' or 'remove', category). A
pattern is a host ("a.example.org", which covers its subdomains) or a host with a path prefix that ends at
a segment ("a.example.org/en"). An action holds until the pattern's next one, so the log becomes validity
intervals [valid_from, valid_to); a capture is judged by the entries whose interval holds its fetch time.
The most specific pattern wins: more host labels, then a longer path.

Plan: captures are exploded into their own patterns (host suffixes times path prefixes, as deep as the deepest
that the list has, so that every entry can match) and joined by hash with one row for each pattern, which holds that pattern's
intervals in an array; the interval that holds the fetch time is picked from the array. The join so makes
one row at most for each capture and pattern, also for a hot host, whose captures Spark can split over
tasks. No cross join, no Python.

Edge cases: a null or host-less url matches nothing and is allowed; a null fetch time matches nothing;
patterns are normalised like urls (case, scheme, port, trailing dots and slashes, empty segments), and those
without a host or date are ignored; of several actions of one pattern at one instant, 'remove'
is applied last; repeated entries don't change a result; repeated captures are judged one by one. An action
without a next one holds for ever (valid_to is null). Hosts and paths may be as deep and urls as long as they like. An
empty list allows all; an empty table of captures gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.common import materialize, project, table


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; the empty string if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def normalised(pattern: Column) -> Column:
    """A list's pattern as urls are: in lower case, without scheme, user, port, query, trailing dots of the host and empty segments; null without a host."""
    bare = F.regexp_replace(F.lower(F.trim(pattern)), r"^[a-z][a-z0-9+.\-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)[?#].*$", ""), r"^[^/@]*@", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/:]*)", 1), r"\.+$", "")
    path = F.filter(F.split(F.regexp_replace(bare, r"^[^/]*", ""), "/"), lambda s: s != "")
    return F.when(host != "", F.array_join(F.concat(F.array(host), path), "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) of a log (pattern, effective, action, category); a null valid_to is open."""
    log = project(entries, pattern=normalised(entries["pattern"]), effective="effective", action="action", category="category").where("pattern IS NOT NULL AND effective IS NOT NULL")
    # One state for each pattern and instant: a removal wins, else the smallest category.
    log = log.groupBy("pattern", "effective").agg(F.max(F.col("action") == "remove").alias("removed"), F.min("category").alias("category"))
    order = Window.partitionBy("pattern").orderBy("effective")
    spans = log.withColumn("valid_to", F.lead("effective").over(order))
    return spans.where("NOT coalesce(removed, false)").select("pattern", "category", F.col("effective").alias("valid_from"), "valid_to")


def depths(listed: DataFrame) -> tuple[int, int]:
    """The most host labels and the most path segments of a pattern."""
    parts = F.split("pattern", "/")
    most = listed.agg(F.max(F.size(F.split(parts[0], r"\."))), F.max(F.size(parts) - 1)).first()
    return most[0] or 1, most[1] or 0


def patterns_of(url: Column, n_labels: int, n_segments: int) -> Column:
    """All patterns of at most so many host labels and path segments that can match a url, as (pattern, specificity)."""
    labels = F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(n_labels))), lambda n: F.struct(F.array_join(F.slice(labels, -n, n), ".").alias("h"), n.alias("n")))
    ways = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(n_segments))), lambda k: F.struct(F.array_join(F.slice(segments, F.lit(1), k), "/").alias("p"), k.alias("k")))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(ways, lambda w: F.struct(F.when(w["k"] == 0, h["h"]).otherwise(F.concat(h["h"], F.lit("/"), F.lower(w["p"]))).alias("pattern"), (h["n"] * F.lit(n_segments + 1) + w["k"]).alias("rank")))))
    return F.when(host_of(url) == "", F.array().cast("array<struct<pattern:string,rank:int>>")).otherwise(both)


def histories(entries: DataFrame) -> DataFrame:
    """(pattern, spans): one row for each pattern with its intervals."""
    span = F.struct("valid_from", "valid_to", "category")
    return materialize(intervals(entries).groupBy("pattern").agg(F.collect_list(span).alias("spans")), "histories")


def judge(captures: DataFrame, entries: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """(key, url, fetched, host, n_active, pattern, category, blocked) for every capture."""
    rows = project(captures, key=key, url=url, fetched=fetched)
    listed = histories(entries)
    # Repeated captures ask once. The captures are few columns wide here, their patterns many rows.
    asked = rows.distinct().select("key", "url", "fetched", F.explode(patterns_of(F.col("url"), *depths(listed))).alias("m")).select("key", "url", "fetched", "m.pattern", "m.rank")
    holds = lambda s: (F.col("fetched") >= s["valid_from"]) & (s["valid_to"].isNull() | (F.col("fetched") < s["valid_to"]))
    active = asked.join(listed, "pattern").withColumn("now", F.filter("spans", holds)).where("size(now) > 0")
    active = active.select("key", "url", "fetched", "rank", "pattern", F.array_min(F.transform("now", lambda s: s["category"])).alias("category"))
    best = active.groupBy(F.col("key").alias("k"), F.col("url").alias("u"), F.col("fetched").alias("f")).agg(F.count("*").alias("n_active"), F.max_by(F.struct("pattern", "category"), "rank").alias("best"))
    out = rows.join(best, F.col("key").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")) & F.col("fetched").eqNullSafe(F.col("f")), "left")
    return out.select("key", "url", "fetched", host_of(F.col("url")).alias("host"), F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.col("best.pattern").alias("pattern"), F.col("best.category").alias("category"), F.col("best").isNotNull().alias("blocked"))


# The test tables hold no fetch times and no dated list. The query derives both from page ids and hosts by a
# fixed rule, so that lists grow with the hosts of the input.
EPOCH = "2024-01-01 00:00:00"


def _draw(text: Column, start: int, below: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), start, 6), 16, 10).cast("bigint"), F.lit(below))


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: an hour within three years that the page id decides."""
    hours = _draw(pages["page_id"].cast("string"), 1, 3 * 365 * 24)
    return pages.select("page_id", "url", F.timestamp_add("HOUR", hours, F.lit(EPOCH).cast("timestamp")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A log for three in four hosts (blocked, later cleared, some blocked anew) and for a path of one in two."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    start = F.lit(EPOCH).cast("timestamp")
    day = lambda n: F.timestamp_add("DAY", n, start)
    h = F.col("host")
    first, stay, gap = _draw(h, 1, 500), _draw(h, 7, 300) + 1, _draw(h, 13, 400) + 1
    kind = F.when(_draw(h, 19, 3) == 0, "spam").when(_draw(h, 19, 3) == 1, "malware").otherwise("adult")
    entry = lambda p, at, what, c: F.struct(p.alias("pattern"), at.alias("effective"), F.lit(what).alias("action"), c.alias("category"))
    logs = F.array(entry(h, day(first), "add", kind), entry(h, day(first + stay), "remove", kind), entry(h, day(first + stay + gap), "add", F.lit("again")))
    paths = F.array(entry(F.concat(h, F.lit("/en")), day(gap), "add", F.lit("section")))
    chosen = F.when(_draw(h, 25, 4) > 0, logs).otherwise(F.array_except(logs, logs))
    extra = F.when(_draw(h, 22, 2) == 0, paths).otherwise(F.array_except(paths, paths))
    return hosts.select(F.explode(F.concat(chosen, extra)).alias("e")).select("e.*")


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = judge(derived_captures(pages), derived_entries(pages), "page_id", "url", "fetched")
    return out.select(F.col("key").alias("page_id"), "host", "fetched", "n_active", "pattern", "category", "blocked")


def _draw_sql(text: str, start: int, below: int) -> str:
    return f"(('0x' || substr(md5({text}), {start}, 6))::BIGINT % {below})"


SQL = f"""
WITH caps AS (
  SELECT page_id, url, TIMESTAMP '{EPOCH}' + to_hours({_draw_sql('page_id::VARCHAR', 1, 3 * 365 * 24)}) AS fetched,
    regexp_replace(split_part(split_part(split_part(split_part(lower(url), '://', 2), '/', 1), '?', 1), '#', 1), ':[0-9]*$', '') AS host,
    split_part(split_part('/' || split_part(split_part(url, '://', 2), '/', 2), '?', 1), '#', 1) AS first_segment
  FROM pages),
hosts AS (SELECT DISTINCT host, {_draw_sql('host', 1, 500)} AS f, {_draw_sql('host', 7, 300)} + 1 AS s, {_draw_sql('host', 13, 400)} + 1 AS g,
    CASE {_draw_sql('host', 19, 3)} WHEN 0 THEN 'spam' WHEN 1 THEN 'malware' ELSE 'adult' END AS kind FROM caps WHERE host <> ''),
spans AS (
  SELECT host AS pattern, kind AS category, 0 AS deep, TIMESTAMP '{EPOCH}' + to_days(f::INTEGER) AS a, TIMESTAMP '{EPOCH}' + to_days((f + s)::INTEGER) AS b FROM hosts WHERE {_draw_sql('host', 25, 4)} > 0
  UNION ALL SELECT host, 'again', 0, TIMESTAMP '{EPOCH}' + to_days((f + s + g)::INTEGER), 'infinity'::TIMESTAMP FROM hosts WHERE {_draw_sql('host', 25, 4)} > 0
  UNION ALL SELECT host || '/en', 'section', 1, TIMESTAMP '{EPOCH}' + to_days(g::INTEGER), 'infinity'::TIMESTAMP FROM hosts WHERE {_draw_sql('host', 22, 2)} = 0),
hits AS (
  SELECT c.page_id, s.pattern, s.category, s.deep
  FROM caps c JOIN spans s ON c.fetched >= s.a AND c.fetched < s.b
   AND ((s.deep = 0 AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)))
     OR (s.deep = 1 AND lower(c.first_segment) = '/en' AND (c.host || '/en' = s.pattern OR ends_with(c.host || '/en', '.' || s.pattern))))),
ranked AS (
  SELECT page_id, count(*) AS n_active, arg_max(pattern, 10 * len(string_split(split_part(pattern, '/', 1), '.')) + deep) AS pattern, arg_max(category, 10 * len(string_split(split_part(pattern, '/', 1), '.')) + deep) AS category FROM hits GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched, coalesce(r.n_active, 0) AS n_active, r.pattern, r.category, r.page_id IS NOT NULL AS blocked
FROM caps c LEFT JOIN ranked r USING (page_id)
"""
