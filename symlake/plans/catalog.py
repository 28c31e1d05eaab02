"""All queries of the engine over the test tables, with SQL that says the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.functions.patterns import erased
from symlake.functions.versions import version_key
from symlake.model import Location as L
from symlake.operators import conditions, deps, forest, maven, postings, rules, snippets, symbols
from symlake.plans import analogs as A
from symlake.sources import builds, gradle, scan, sha_index
from symlake.tables import large, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHOWN = ["sym_id", "qualified_name", "name", "location", "line"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _parts(where: str, cols: str = ", ".join(SHOWN)) -> str:
    return f"WITH {A.SYM_PARTS} SELECT {cols} FROM sym_parts WHERE {where}"


@query(_parts("location = 'RETURN_TYPE' AND qualified_name LIKE 'com.brand%'"))
def loc_bucket(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "com.brand*", L.RETURN_TYPE).select(*SHOWN)


#: A class that the tables have.
EXACT = "com.brand7.small.hot_bolt"


@query(_parts(f"location = 'CLASS' AND string_split(qualified_name, '<')[1] = '{EXACT}'"))
def loc_exact(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), EXACT, L.CLASS).select(*SHOWN)


@query(_parts("location = 'IMPORT' AND qualified_name LIKE 'com.brand1%'"))
def glob_prefix(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "com.brand1*", L.IMPORT).select(*SHOWN)


@query(_parts("location = 'CLASS' AND regexp_full_match(split_part(qualified_name, '<', 1), 'com[.]brand..[.].*e.*')"))
def glob_infix(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "com.brand??.*e*", L.CLASS).select(*SHOWN)


@query(_parts("location = 'ANNOTATION' AND (qualified_name LIKE '%.economy.%' OR qualified_name LIKE '%.promo.%')"))
def glob_alternation(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "com.*.(economy|promo).*", L.ANNOTATION).select(*SHOWN)


@query(f"WITH {A.SYM_PARTS} SELECT split_part(qualified_name, '<', 1) AS bare, count(*) AS n FROM sym_parts WHERE location = 'INHERITANCE' GROUP BY 1")
def erasure(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols.query(A.sym_parts(spark, d), "*<anything>", L.INHERITANCE)
    return rows.groupBy(erased(F.col("qualified_name")).alias("bare")).agg(F.count("*").alias("n"))


@query(f"WITH {A.SYM_PAGES} SELECT page_id, qualified_name, kind FROM sym_pages WHERE location = 'TYPE' AND qualified_name LIKE '%.example.%.p%' UNION ALL SELECT page_id, qualified_name, kind FROM sym_pages WHERE location = 'IMPORT' AND qualified_name LIKE '%.example.%.p%'")
def type_with_imports(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_pages(spark, d), "*.example.*.p*", L.TYPE).select("page_id", "qualified_name", "kind")


@query(
    f"WITH {A.SYM_PARTS} "
    + " UNION ALL ".join(f"SELECT {', '.join(SHOWN)} FROM sym_parts WHERE location = '{x}' AND split_part(qualified_name, '<', 1) LIKE 'com.brand2%'" for x in ("TYPE", "CONSTRUCTOR_CALL", "ANNOTATION", "IMPORT"))
    + f" UNION ALL SELECT {', '.join(SHOWN)} FROM sym_parts WHERE location = 'METHOD_CALL' AND (qualified_name LIKE 'com.brand2%' OR name LIKE 'com.brand2%')"
)
def default_union(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "com.brand2*").select(*SHOWN)


@query(f"WITH {A.SYM_PAGES} SELECT page_id, qualified_name, array_to_string(list_slice(string_split(qualified_name, '.'), 1, -2), '.') AS name FROM sym_pages WHERE location = 'IMPORT' AND ends_with(array_to_string(list_slice(string_split(qualified_name, '.'), 1, -2), '.'), '.org')")
def package_from_import(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_pages(spark, d), "*.org", L.PACKAGE).select("page_id", "qualified_name", "name")


@query(
    f"WITH {A.SYM_PARTS}, s AS (SELECT sym_id, unnest(list_transform(range(1, len(string_split(qualified_name, '.')) + 1), lambda i: array_to_string(list_slice(string_split(qualified_name, '.'), i, -1), '.'))) AS suffix FROM sym_parts WHERE location IN ('METHOD', 'METHOD_CALL'))"
    f" SELECT {', '.join(SHOWN)} FROM sym_parts p WHERE location = 'METHOD_CALL' AND (name LIKE 'st%e_%' OR EXISTS (SELECT 1 FROM s WHERE s.sym_id = p.sym_id AND (suffix LIKE 'standard.%' OR suffix LIKE 'promo.%')))"
)
def method_suffix(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "(standard|promo).*", L.METHOD_CALL).select(*SHOWN)


def _posted(spark: SparkSession, d: str) -> postings.Index:
    return postings.build(A.sym_parts(spark, d), new_path(spark, "postings"))


@query(ORACLES["glob_infix"])
def glob_infix_postings(spark: SparkSession, d: str) -> DataFrame:
    """By the pieces of names instead of the bucket."""
    return postings.search(_posted(spark, d), "com.brand??.*e*", L.CLASS).select(*SHOWN)


@query(ORACLES["method_suffix"])
def method_suffix_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings.search(_posted(spark, d), "(standard|promo).*", L.METHOD_CALL).select(*SHOWN)


@query(_parts("location = 'FIELD' AND name LIKE '%e%' AND split_part(qualified_name, '<', 1) LIKE 'com.brand%.economy.%'"))
def field_name_and_type(spark: SparkSession, d: str) -> DataFrame:
    return symbols.query(A.sym_parts(spark, d), "*e* com.brand*.economy.*", L.FIELD).select(*SHOWN)


@query(_parts("location = 'RETURN_TYPE' AND name LIKE '%g%' AND split_part(qualified_name, '<', 1) LIKE 'com.brand1%'"))
def method_return_type(spark: SparkSession, d: str) -> DataFrame:
    return symbols.returning(A.sym_parts(spark, d), "*g* com.brand1*").select(*SHOWN)


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'clock') AND props->>'$.k' = '7'")
def annotated_any(spark: SparkSession, d: str) -> DataFrame:
    return symbols.annotated(A.sym_annotated(spark, d), "cl?ck.7").select("user_id").distinct()


@query("SELECT event_id, user_id FROM events WHERE event_type LIKE '%r%' AND (props->>'$.k')::INTEGER BETWEEN 40 AND 59")
def annotated_elements(spark: SparkSession, d: str) -> DataFrame:
    return symbols.annotated(A.sym_annotated(spark, d), "*r*", {"k": "[45][0-9]"}).select("event_id", "user_id")


@query(f"WITH {A.SYM_PAGES} SELECT page_id, qualified_name FROM sym_pages WHERE file_uri IN (SELECT url FROM pages WHERE url LIKE '%.html')")
def filepaths_semi(spark: SparkSession, d: str) -> DataFrame:
    files = A.read(spark, d, "pages").where("url LIKE '%.html'").select(F.col("url").alias("file_uri"))
    return symbols.in_files(A.sym_pages(spark, d), files).select("page_id", "qualified_name")


@query(f"WITH {A.SYM_PARTS} SELECT {', '.join(SHOWN)} FROM sym_parts a WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = sym_id AND p_brand LIKE '%5')")
def drop_dependency_anti(spark: SparkSession, d: str) -> DataFrame:
    return symbols.without_dependencies(A.sym_parts(spark, d)).select(*SHOWN)


FLAT = ["file_uri", "line_number", "kind", "name", "package", "start_line", "start_character", "end_line", "end_character"]


@query(
    f"WITH {A.SYM_PARTS} SELECT file_uri, line::BIGINT + 1 AS line_number, kind, name, package_name AS package, line AS start_line, start_char AS start_character, end_line, end_char AS end_character"
    " FROM sym_parts WHERE NOT is_dependency AND location IN ('TYPE', 'IMPORT') AND split_part(qualified_name, '<', 1) LIKE 'com.brand%.%o%'"
)
def incidents(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.referenced(A.sym_parts(spark, d), "com.brand*.*o*", L.TYPE)
    return found.select("file_uri", "line_number", "kind", "name", "package", F.col("start.line").alias("start_line"), F.col("start.character").alias("start_character"), F.col("end.line").alias("end_line"), F.col("end.character").alias("end_character"))


_LINES = r"l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents)"


@query(
    f"WITH {_LINES}, t AS (SELECT doc_id, ls, doc_id % 5 AS n FROM l WHERE doc_id % 5 < len(ls)), x AS (SELECT doc_id, n, unnest(range(greatest(0, n - 3), least(len(ls), n + 4))) AS i, ls, least(len(ls), n + 4) AS e FROM t)"
    " SELECT doc_id, md5(string_agg(chr(10) || lpad((i + 1)::VARCHAR, len(e::VARCHAR)::INTEGER, ' ') || '  ' || ls[i + 1], '' ORDER BY i)) AS snippet_md5 FROM x GROUP BY doc_id"
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents").select("doc_id", snippets.lines_of(F.col("text")).alias("lines"), (F.col("doc_id") % 5).cast("int").alias("at")).where("at < size(lines)")
    return docs.select("doc_id", F.md5(snippets.snippet(F.col("lines"), F.col("at"), 3)).alias("snippet_md5"))


RULES = [rules.Rule(f"r{i}", p, loc) for i, (p, loc) in enumerate([*[(f"com.brand{a}{b}.*", L.IMPORT) for a in range(1, 6) for b in range(1, 6)], *[(f"com.*.{t}.{w}*", L.CLASS) for t in ("economy", "promo", "standard", "small", "large", "medium") for w in "abcdefghij"], *[(f"com.brand{a}1.economy.red_widget", L.INHERITANCE) for a in range(1, 6)], *[(f"*{c}*", L.METHOD) for c in "aeiou"], ("com.brand1?.*", L.DEFAULT)])]


def _many_rules(n: int) -> list[rules.Rule]:
    """As many rules as a usual rule set has: mostly prefixes, some names in full, some with stars inside."""
    kinds = ["economy", "promo", "standard", "small", "large", "medium"]
    places = [L.IMPORT, L.TYPE, L.DEFAULT, L.METHOD_CALL, L.ANNOTATION, L.INHERITANCE, L.CONSTRUCTOR_CALL, L.METHOD, L.FIELD]
    shapes = ["com.brand{a}{b}.{t}.*", "com.brand{a}{b}.{t}.{c}*", "com.brand{a}{b}.{t}.red_widget", "*.{t}.{c}*{a}", "com.brand{a}?.{t}*{c}*"]
    out = []
    for i in range(n):
        pattern = shapes[i % 5].format(a=i % 5 + 1, b=i // 5 % 5 + 1, t=kinds[i // 7 % 6], c="abcdefghijklmnop"[i // 3 % 16])
        out.append(rules.Rule(f"m{i}", pattern, places[i // 2 % 9]))
    return out


#: The size of the published rule set.
MANY = _many_rules(1075)


def _rule_sql(some: list[rules.Rule]) -> str:
    values = ", ".join(f"('{r.rule_id}', '{'^' + r.pattern.replace('.', '[.]').replace('*', '.*').replace('?', '.') + '$'}', '{r.location.value}')" for r in some)
    return (
        f"WITH {A.SYM_PARTS}, r(rule_id, re, loc) AS (VALUES {values}) SELECT rule_id, count(*) AS n FROM sym_parts s JOIN r ON NOT s.is_dependency AND"
        " CASE WHEN s.location <> loc AND NOT (loc = 'TYPE' AND s.location = 'IMPORT') AND NOT (loc = 'DEFAULT' AND s.location IN ('TYPE', 'METHOD_CALL', 'CONSTRUCTOR_CALL', 'ANNOTATION', 'IMPORT')) THEN false"
        " WHEN s.location IN ('METHOD', 'METHOD_CALL') THEN regexp_matches(qualified_name, re) OR regexp_matches(name, re) OR len(list_filter(range(2, 9), lambda i: regexp_matches(coalesce(nullif(array_to_string(list_slice(string_split(qualified_name, '.'), i, -1), '.'), ''), chr(10)), re))) > 0"
        " ELSE regexp_matches(split_part(qualified_name, '<', 1), re) END GROUP BY rule_id"
    )


@query(_rule_sql(RULES))
def rule_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_rules(A.sym_parts(spark, d), RULES).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_rule_sql(MANY))
def rule_batch_full(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_rules(A.sym_parts(spark, d), MANY).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {A.DEP_VERSIONS} SELECT dep_id, version FROM dep_versions WHERE regexp_full_match(group_id || '.' || artifact_id, 'org[.]brand[12].*[.].*-(widget|gear)') ")
def dep_name_regex(spark: SparkSession, d: str) -> DataFrame:
    return deps.select(A.dep_versions(spark, d), name_regex="org[.]brand[12].*[.].*-(widget|gear)").select("dep_id", "version")


@query(f"WITH {A.DEP_VERSIONS}, v AS (SELECT *, split_part(version, '.', 1)::INTEGER * 1000000 + split_part(version, '.', 2)::INTEGER * 1000 + split_part(version, '.', 3)::INTEGER AS k FROM dep_versions) SELECT dep_id, version FROM v WHERE k BETWEEN 9010000 AND 30002005")
def dep_version_bounds(spark: SparkSession, d: str) -> DataFrame:
    return deps.select(A.dep_versions(spark, d), lower="9.10", upper="30.2.5").select("dep_id", "version")


def _conditions(n: int) -> list[conditions.Condition]:
    """As many conditions: names in full, by regular expression and without, with both bounds, one or none."""
    out = []
    for i in range(n):
        name = f"org.brand{i % 5 + 1}{i // 5 % 5 + 1}.{_WORDS[i % len(_WORDS)]}-{_WORDS[i // 3 % len(_WORDS)]}" if i % 3 == 0 else None
        regex = f"org[.]brand{i % 5 + 1}.*-{_WORDS[i % len(_WORDS)]}" if i % 3 == 1 else None
        lower, upper = f"{i % 40}.{i % 7}", f"{i % 40 + i % 11}.{i % 19}.{i % 3}"
        out.append(conditions.Condition(f"c{i}", name, regex, lower if i % 4 != 1 else None, upper if i % 5 != 2 else None))
    return out


#: Words that part names are made of.
_WORDS = ["widget", "gear", "bolt", "red", "small", "hot"]
MANY_CONDITIONS = _conditions(1000)


def _conditions_sql(some: list[conditions.Condition]) -> str:
    number = lambda v: "NULL" if v is None else str(sum(int(x) * m for x, m in zip(v.split("."), (1_000_000, 1000, 1), strict=False)))
    text = lambda v: "NULL" if v is None else f"'{v}'"
    values = ", ".join(f"('{c.cond_id}', {text(c.name)}, {text(c.name_regex)}, {number(c.lower)}, {number(c.upper)})" for c in some)
    return (
        f"WITH {A.DEP_VERSIONS}, v AS (SELECT group_id || '.' || artifact_id AS full_name, split_part(version, '.', 1)::INTEGER * 1000000 + split_part(version, '.', 2)::INTEGER * 1000 + split_part(version, '.', 3)::INTEGER AS k FROM dep_versions),"
        f" c(cond_id, name, re, lo, hi) AS (VALUES {values}) SELECT cond_id, count(*) AS n FROM v JOIN c ON (lo IS NULL OR k >= lo) AND (hi IS NULL OR k <= hi) AND CASE WHEN name IS NOT NULL THEN full_name = name WHEN re IS NOT NULL THEN regexp_full_match(full_name, re) ELSE true END GROUP BY cond_id"
    )


@query(_conditions_sql(MANY_CONDITIONS))
def dep_conditions_many(spark: SparkSession, d: str) -> DataFrame:
    return conditions.match(A.dep_versions(spark, d), MANY_CONDITIONS).groupBy("cond_id").agg(F.count("*").alias("n"))


@query(
    f"WITH {A.DEP_VERSIONS}, v AS (SELECT dep_id, version, list_transform(string_split(version, '.'), lambda x: x::INTEGER) AS k FROM dep_versions)"
    " SELECT a.dep_id, CASE WHEN a.k < b.k THEN -1 WHEN a.k > b.k THEN 1 ELSE 0 END AS order_to_next FROM v a JOIN v b ON b.dep_id = a.dep_id + 1"
)
def dep_version_order(spark: SparkSession, d: str) -> DataFrame:
    keys = A.dep_versions(spark, d).select("dep_id", version_key(F.col("version")).alias("key"))
    after = keys.select((F.col("dep_id") - 1).alias("dep_id"), F.col("key").alias("next"))
    return keys.join(after, "dep_id").select("dep_id", F.when(F.col("key") < F.col("next"), -1).when(F.col("key") > F.col("next"), 1).otherwise(0).alias("order_to_next"))


#: What every third key of a table that is looked up ends in, so that it is missed.
_OTHER = "CASE WHEN dep_id % 3 = 0 THEN '-other' ELSE '' END"


def _joined(rows: DataFrame, by: str, key: str, text: Column, separator: str) -> DataFrame:
    """(by, text): each group's texts in the order of the key; those of ``deps.CHUNK`` keys first, so that a group is put together of few strings."""
    part = F.floor(F.col(key) / deps.CHUNK).alias("part")
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["x"]), separator)
    chunks = rows.select(by, key, text.alias("x")).where("x IS NOT NULL").groupBy(by, part).agg(lines(F.struct(key, "x")).alias("x"))
    return chunks.groupBy(by).agg(lines(F.struct("part", "x")).alias("text"))


def _poms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A pom for each brand with its parts as dependencies, and the dependencies to look for."""
    v = A.dep_versions(spark, d)
    one = F.concat(F.lit("<dependency>\n<groupId>"), "group_id", F.lit("</groupId>\n<artifactId>"), "artifact_id", F.lit("</artifactId>\n</dependency>"))
    uri = F.concat(F.lit("file:///"), F.col("group_id"), F.lit("/pom.xml"))
    parts = _joined(v.withColumn("artifact_id", F.concat("artifact_id", F.expr(_OTHER))), "group_id", "dep_id", one, "\n")
    sources = parts.select(uri.alias("file_uri"), F.concat(F.lit("<project>\n<dependencies>\n"), "text", F.lit("\n</dependencies>\n</project>")).alias("text"))
    return sources, v.select("dep_id", uri.alias("file_uri"), "group_id", "artifact_id")


_POM_SQL = f"""WITH {A.DEP_VERSIONS},
placed AS (SELECT group_id, artifact_id || {_OTHER} AS artifact_id, row_number() OVER (PARTITION BY group_id ORDER BY dep_id) AS k FROM dep_versions),
found AS (SELECT group_id, artifact_id, min(4 * k) AS line FROM placed GROUP BY ALL)
SELECT dep_id, coalesce(line, 0)::INTEGER AS line FROM dep_versions LEFT JOIN found USING (group_id, artifact_id)"""


@query(_POM_SQL)
def dep_line_lookup(spark: SparkSession, d: str) -> DataFrame:
    sources, wanted = _poms(spark, d)
    return deps.locate_in_pom(wanted, sources).select("dep_id", "line")


@query(
    f"""WITH {A.DEP_VERSIONS},
placed AS (SELECT artifact_id || {_OTHER} AS artifact_id, row_number() OVER (ORDER BY dep_id) AS k FROM dep_versions WHERE group_id = 'org.brand11'),
found AS (SELECT artifact_id, min(4 * k) AS line FROM placed GROUP BY ALL)
SELECT a.artifact_id, a.version, coalesce(f.line, b.line, 0)::BIGINT AS line_number FROM dep_versions a
LEFT JOIN found f ON a.group_id = 'org.brand11' AND f.artifact_id = a.artifact_id LEFT JOIN found b ON b.artifact_id = a.artifact_id"""
)
def dep_line_fallback(spark: SparkSession, d: str) -> DataFrame:
    sources, _ = _poms(spark, d)
    none = F.lit(None).cast("string")
    base = F.struct(F.lit("org.brand11").alias("group_id"), F.col("artifact_id"), none.alias("version"), none.alias("pom_path"))
    rows = A.dep_versions(spark, d).withColumn("base_dep", base)
    return deps.incidents(rows, "file:///org.brand11/pom.xml", sources.where("file_uri = 'file:///org.brand11/pom.xml'")).select("artifact_id", "version", "line_number")


@query("SELECT doc_id, coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'the:'))), 0)::INTEGER AS line FROM (SELECT doc_id, string_split(replace(text, ' the ', ' the:x '), chr(10)) AS ls FROM documents)")
def gradle_line_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents").select("doc_id", F.concat(F.lit("file:///"), F.col("doc_id").cast("string"), F.lit("/build.gradle")).alias("file_uri"), F.regexp_replace("text", " the ", " the:x ").alias("text"))
    wanted = docs.select("doc_id", "file_uri", F.lit("the").alias("group_id"), F.lit("").alias("artifact_id"))
    return deps.locate_in_gradle(wanted, docs).select("doc_id", "line")


_DAG = """WITH d AS (
  SELECT 'r' || r_regionkey AS node_id, 'r' || r_regionkey AS root_id, 0 AS depth FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(_DAG + " SELECT node_id, depth, root_id FROM d")
def dag_flatten(spark: SparkSession, d: str) -> DataFrame:
    return deps.flatten(A.dep_dag(spark, d)).select("node_id", "depth", "root_id")


_TREE = """WITH d AS (
  SELECT 'r' || r_regionkey AS node_id, 'r' || r_regionkey AS root_id, 0 AS depth, -1 AS n, -1 AS s FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_nationkey, -1 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY n, s) - 1 AS pre FROM d)"""


@query(_TREE + " SELECT node_id, root_id, pre, CASE depth WHEN 0 THEN count(*) OVER (PARTITION BY root_id) WHEN 1 THEN count(*) OVER (PARTITION BY n, depth = 0) ELSE 1 END AS size, depth::INTEGER AS depth FROM p")
def dag_preorder(spark: SparkSession, d: str) -> DataFrame:
    return forest.preorder(A.dep_dag(spark, d)).select("node_id", "root_id", "pre", "size", "depth")


def _node_sql(kind: str, name: str, version: int, inner: str) -> str:
    return f"""'{{"group_id":"{kind}","artifact_id":"' || {name} || '","version":"{version}","children":[' || {inner} || ']}}'"""


@query(
    f"""WITH s AS (SELECT s_nationkey AS n, string_agg({_node_sql('supplier', 's_name', 3, "''")}, ',' ORDER BY s_suppkey) AS x FROM supplier GROUP BY 1),
n AS (SELECT n_regionkey AS r, string_agg({_node_sql('nation', 'n_name', 2, "coalesce(x, '')")}, ',' ORDER BY n_nationkey) AS x FROM nation LEFT JOIN s ON n = n_nationkey GROUP BY 1)
SELECT 'r' || r_regionkey AS root_id, md5({_node_sql('region', 'r_name', 1, "coalesce(x, '')")}) AS tree_md5 FROM region LEFT JOIN n ON r = r_regionkey"""
)
def dag_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested response, written along the tour."""
    return deps.nested(A.dep_dag(spark, d)).select("root_id", F.md5("json").alias("tree_md5"))


@query(
    "SELECT 'region' AS group_id, r_name AS artifact_id, false AS indirect, NULL AS base_artifact FROM region UNION ALL SELECT 'nation', n_name, true, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
    " UNION ALL SELECT 'supplier', s_name, true, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def dag_base_dep(spark: SparkSession, d: str) -> DataFrame:
    return deps.resolved(A.dep_dag(spark, d)).select("group_id", "artifact_id", "indirect", F.col("base_dep.artifact_id").alias("base_artifact"))


@query("SELECT source AS file_uri, count(*) AS n, md5(string_agg(doc_id || lang, ',' ORDER BY doc_id)) AS listed FROM documents GROUP BY source")
def deps_grouped_by_file(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("source").alias("file_uri"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("group_id"), F.col("lang").alias("artifact_id"), none.alias("version"), none.alias("classifier"), none.alias("scope"))
    # A file's list is in rows of bounded size; only what is told of it is put together.
    listed = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    chunks = deps.by_file(rows).select("file_uri", "chunk", "n", listed(F.transform("dependencies", lambda x: F.concat(x["ordinal"].cast("string"), x["group_id"]))).alias("x"))
    whole = chunks.groupBy("file_uri").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "x"))).alias("xs"))
    return whole.select("file_uri", "n", F.md5(listed(F.transform("xs", lambda x: x["x"]))).alias("listed"))


@query("SELECT doc_id, 'dependency/language=java' || CASE WHEN lang LIKE 'e%' THEN ' dependency/exclude=true' ELSE '' END || ' dependency/dep-source=' || CASE WHEN source LIKE 'src1%' THEN 'open-source' ELSE 'internal' END AS labels FROM documents")
def dep_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "documents").select("doc_id", F.col("lang").alias("group_id"), F.col("source").alias("artifact_id"))
    return deps.labels(rows, ["[a-z]+:src1.*"], ["e"]).select("doc_id", F.array_join("labels", " ").alias("labels"))


# Two in three texts are indexed under another digest, so that they are missed.
_INDEX = "i AS (SELECT sha1(text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '#other' END) AS sha1, min(lang || ':' || source) AS c FROM documents GROUP BY 1)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents")
    body = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise("#other"))
    return docs.select(F.sha1(body.cast("binary")).alias("sha1"), F.col("lang").alias("group_id"), F.col("source").alias("artifact_id"), F.lit("1").alias("version"))


@query(f"WITH {_INDEX} SELECT doc_id, split_part(c, ':', 1) AS group_id, split_part(c, ':', 2) AS artifact_id FROM documents JOIN i ON sha1(text) = i.sha1")
def sha_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents").select("doc_id", F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".jar")).alias("path"), F.sha1(F.col("text").cast("binary")).alias("sha1"), F.lit(None).cast("struct<group_id:string,artifact_id:string,version:string>").alias("properties"))
    found = deps.identify(docs, _index(spark, d)).where("identified_by = 'sha1'")
    return found.select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("doc_id"), "group_id", "artifact_id")


@query(ORACLES["sha_lookup"])
def sha_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By the sorted index."""
    docs = A.read(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    path = new_path(spark, "sha-index")
    least = _index(spark, d).groupBy("sha1").agg(F.min(F.struct("group_id", "artifact_id")).alias("c"))
    sha_index.write(least.select("sha1", "c.*", F.lit("1").alias("version")), path)
    return docs.join(sha_index.lookup(spark, path, docs), "sha1").select("doc_id", "group_id", "artifact_id")


@query(f"WITH {_INDEX} SELECT doc_id, CASE WHEN c IS NOT NULL THEN split_part(c, ':', 1) WHEN doc_id % 2 = 0 THEN 'own' ELSE '{deps.UNKNOWN_GROUP}' END AS group_id, CASE WHEN c IS NOT NULL THEN 'sha1' WHEN doc_id % 2 = 0 THEN 'properties' ELSE 'name' END AS identified_by FROM documents LEFT JOIN i ON sha1(text) = i.sha1")
def identify_coalesce(spark: SparkSession, d: str) -> DataFrame:
    own = F.struct(F.lit("own").alias("group_id"), F.lit("a").alias("artifact_id"), F.lit("0").alias("version"))
    docs = A.read(spark, d, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".jar")).alias("path"), F.sha1(F.col("text").cast("binary")).alias("sha1"), F.when(F.col("doc_id") % 2 == 0, own).alias("properties"))
    return deps.identify(docs, _index(spark, d)).select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("doc_id"), "group_id", "identified_by")


_PACKAGE_RULES = [rules.Rule("p1", "*.org", L.PACKAGE), rules.Rule("p2", "*.example.*", L.PACKAGE), rules.Rule("p3", "none", L.PACKAGE), rules.Rule("t1", "*.page", L.TYPE)]
_PACKAGE = "array_to_string(list_slice(string_split(qualified_name, '.'), 1, -2), '.')"


@query(
    f"WITH {A.SYM_PAGES} SELECT 'p1' AS rule_id, page_id, {_PACKAGE} AS name FROM sym_pages WHERE location = 'IMPORT' AND ends_with({_PACKAGE}, '.org')"
    f" UNION ALL SELECT 'p2', page_id, {_PACKAGE} FROM sym_pages WHERE location = 'IMPORT' AND {_PACKAGE} LIKE '%.example.%' UNION ALL SELECT 't1', page_id, name FROM sym_pages WHERE location IN ('TYPE', 'IMPORT') AND ends_with(qualified_name, '.page')"
)
def rule_batch_packages(spark: SparkSession, d: str) -> DataFrame:
    """Package rules among others in one batch."""
    rows = A.sym_pages(spark, d).withColumn("is_dependency", F.lit(False))
    return rules.match_rules(rows, _PACKAGE_RULES).select("rule_id", "page_id", "name")


@query(f"WITH {A.DEP_VERSIONS}, m AS (SELECT group_id, artifact_id || {_OTHER} AS artifact_id, arg_min(version, dep_id) AS version FROM dep_versions GROUP BY ALL) SELECT d.dep_id, m.version FROM dep_versions d LEFT JOIN m USING (group_id, artifact_id)")
def managed_version(spark: SparkSession, d: str) -> DataFrame:
    v = A.dep_versions(spark, d)
    return deps.managed_versions(v.select("dep_id", "group_id", "artifact_id"), v.withColumn("artifact_id", F.concat("artifact_id", F.expr(_OTHER))).withColumnRenamed("dep_id", "ordinal")).select("dep_id", "version")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1)) AS link FROM pages")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return A.sym_pages(spark, d).where("location = 'IMPORT'").select("page_id", F.col("name").alias("link"))


@query("SELECT location, count(*) AS n FROM (" + A.SYM_PARTS.partition("(")[2].rpartition(")")[0] + ") GROUP BY location")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    return A.sym_parts(spark, d).groupBy("location").agg(F.count("*").alias("n"))


def _java(spark: SparkSession, d: str) -> DataFrame:
    """A small Java source for each part: a class in a package of its brand, with a field and a call."""
    p = A.read(spark, d, "part")
    brand, cls = F.lower(F.regexp_replace("p_brand", "#", "")), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("package com."), brand, F.lit(";\nimport java.util.List;\nimport org.kind."), F.lower("p_type"), F.lit(".*;\n@Deprecated\npublic class "), cls, F.lit(" extends Base {\n  private List<String> names; // "), F.col("p_name"), F.lit("\n  int size(Item item) { return item.count() + names.size(); }\n}\n"))
    return p.select(F.concat(F.lit("file:///"), brand, F.lit("/"), cls, F.lit(".java")).alias("file_uri"), text.alias("text"))


@query(
    "WITH s AS (SELECT 'com.' || lower(replace(p_brand, '#', '')) AS pkg, 'org.kind.' || lower(p_type) AS star, 'P' || p_partkey AS cls, 'file:///' || lower(replace(p_brand, '#', '')) || '/P' || p_partkey || '.java' AS file_uri FROM part)"
    + " UNION ALL ".join(
        f" SELECT file_uri, '{loc}' AS location, {q} AS qualified_name, {n} AS name, {line} AS line FROM s"
        for loc, q, n, line in [
            ("PACKAGE", "pkg", "pkg", 0), ("IMPORT", "'java.util.List'", "'java.util.List'", 1), ("IMPORT", "star || '.*'", "star || '.*'", 2), ("ANNOTATION", "star || '.Deprecated'", "'Deprecated'", 3),
            ("CLASS", "pkg || '.' || cls", "cls", 4), ("TYPE", "pkg || '.' || cls", "cls", 4), ("INHERITANCE", "star || '.Base'", "cls", 4), ("FIELD", "'java.util.List'", "'names'", 5), ("TYPE", "'java.util.List'", "'names'", 5),
            ("METHOD", "pkg || '.' || cls || '.size'", "'size'", 6), ("METHOD", "pkg || '.' || cls || '.size(Item)'", "'size'", 6), ("RETURN_TYPE", "star || '.int'", "'size'", 6), ("TYPE", "star || '.Item'", "'size'", 6),
            ("METHOD_CALL", "star || '.Item.count'", "'size'", 6), ("METHOD_CALL", "'java.util.List.size'", "'size'", 6),
        ]
    )
)
def java_symbols(spark: SparkSession, d: str) -> DataFrame:
    return scan.symbols(_java(spark, d)).select("file_uri", "location", "qualified_name", "name", "line")


@query("SELECT 'file:///' || lower(replace(p_brand, '#', '')) || '/pom.xml' AS file_uri, p_name AS artifact_id, p_size::VARCHAR AS version FROM part")
def declared_dependencies(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part")
    one = F.concat(F.lit("<dependency><groupId>${g}</groupId><artifactId>"), F.col("p_name"), F.lit("</artifactId><version>"), F.col("p_size").cast("string"), F.lit("</version></dependency>"))
    brand = F.concat(F.lit("file:///"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/pom.xml"))
    listed = _joined(p.withColumn("file_uri", brand), "file_uri", "p_partkey", one, "")
    poms = listed.select("file_uri", F.concat(F.lit("<project><properties><g>org.x</g></properties><dependencies>"), "text", F.lit("</dependencies></project>")).alias("text"))
    return builds.declared(poms).where("group_id = 'org.x'").select("file_uri", "artifact_id", "version")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lines of small files: fifty keys a file, in the order of the keys."""
    p = A.read(spark, d, "part")
    name = F.regexp_replace("p_name", " ", "-")
    return p.select((F.col("p_partkey") / 50).cast("long").alias("file"), F.col("p_partkey").alias("k"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("g"), name.alias("a"), F.col("p_size").cast("string").alias("v"))


_LISTED = "listed AS (SELECT p_partkey // 50 AS file, p_partkey AS k, lower(replace(p_brand, '#', '')) AS g, replace(p_name, ' ', '-') AS a, p_size::VARCHAR AS v, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS line FROM part)"


def _files(rows: DataFrame, line: Column, name: str, before: str = "", after: str = "") -> DataFrame:
    """(file_uri, text): each file's lines between two others."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("x")))), lambda x: x["x"]), "\n")
    return rows.groupBy("file").agg(F.concat(F.lit(before), lines, F.lit(after)).alias("text")).select(F.concat(F.lit("file:///"), F.col("file").cast("string"), F.lit("/" + name)).alias("file_uri"), "text")


@query(f"WITH {_LISTED} SELECT 'file:///' || file || '/build.gradle' AS file_uri, g AS group_id, a AS artifact_id, v AS version, line::INTEGER AS line FROM listed WHERE k % 5 <> 0")
def gradle_declared(spark: SparkSession, d: str) -> DataFrame:
    """Declarations with and without parentheses; every fifth part is in a comment."""
    text = F.concat_ws(":", "g", "a", "v")
    line = F.when(F.col("k") % 5 == 0, F.concat(F.lit("  // api '"), text, F.lit("'"))).when(F.col("k") % 2 == 0, F.concat(F.lit("  testImplementation(\""), text, F.lit("\")"))).otherwise(F.concat(F.lit("  implementation '"), text, F.lit("' // {")))
    files = _files(_listed(spark, d), line, "build.gradle", "dependencies {\n", "\n}\napi 'no:no:0'\n")
    return builds.declared(files).select("file_uri", "group_id", "artifact_id", "version", "line")


@query(
    f"""WITH {_LISTED}, r AS (SELECT *, k % 3 = 0 OR k % 50 < 2 AS root FROM listed), t AS (SELECT *, sum(root::INTEGER) OVER (PARTITION BY file ORDER BY k) AS tree FROM r)
SELECT 'file:///' || file || '/tree.txt' AS pom_path, g AS group_id, a AS artifact_id, v AS version, NOT root AS below,
  (CASE WHEN root THEN tree ELSE row_number() OVER (PARTITION BY file, tree ORDER BY k) - 1 END - 1)::INTEGER AS ordinal FROM t"""
)
def gradle_tree(spark: SparkSession, d: str) -> DataFrame:
    root = (F.col("k") % 3 == 0) | (F.col("k") % 50 < 2)
    line = F.concat(F.when(root, "+--- ").otherwise("|    +--- "), F.concat_ws(":", "g", "a", "v"))
    edges = gradle.edges(_files(_listed(spark, d), line, "tree.txt", "compileClasspath - compile\n"))
    return edges.select("pom_path", "group_id", "artifact_id", "version", F.col("parent_id").isNotNull().alias("below"), "ordinal")


@query(
    f"""WITH {_LISTED} SELECT 'file:///' || file || '/pom.xml' AS project, g AS group_id, a AS artifact_id,
  CASE WHEN k % 4 = 0 THEN '7.1' WHEN k % 2 = 0 THEN v WHEN k % 3 = 0 THEN first(v) OVER (PARTITION BY file, g, a, k % 3 = 0, k % 2 ORDER BY k) END AS version FROM listed"""
)
def maven_direct(spark: SparkSession, d: str) -> DataFrame:
    """Versions of properties, own ones, and managed ones; dependencies without any stay with null."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    own = F.when(F.col("k") % 4 == 0, "<version>${v}</version>").when(F.col("k") % 2 == 0, tag("version", F.col("v"))).otherwise("")
    both = F.concat(tag("groupId", F.col("g")), tag("artifactId", F.col("a")))
    line = F.concat(F.lit("<dependency>"), both, own, F.lit("</dependency>"))
    rows = _listed(spark, d).withColumn("a", F.when(F.col("k") % 2 == 0, F.col("a")).otherwise(F.concat("a", F.lit("-"), (F.col("k") % 3 == 0).cast("string"))))
    managed = F.when((F.col("k") % 2 == 1) & (F.col("k") % 3 == 0), F.concat(F.lit("<dependency>"), both, tag("version", F.col("v")), F.lit("</dependency>"))).otherwise("")
    direct = _files(rows, line, "pom.xml", "<dependencies>", "</dependencies></project>")
    known = _files(rows, managed, "pom.xml", "<project><properties><v>7.1</v></properties><dependencyManagement><dependencies>", "</dependencies></dependencyManagement>").withColumnRenamed("text", "known")
    poms = direct.join(large(known), "file_uri").select(F.col("file_uri").alias("project"), "file_uri", F.concat("known", "text").alias("text"))
    return maven.effective(poms, inherit=False).select("project", "group_id", F.regexp_replace("artifact_id", "-(true|false)$", "").alias("artifact_id"), "version")


@query(
    f"""WITH {_LISTED}, hit AS (SELECT a.file, a.g, a.a, min(b.line) + 1 AS line FROM listed a JOIN listed b ON a.file = b.file AND contains(b.g || ':' || b.a || ':' || b.v, a.g || ':' || a.a) GROUP BY ALL),
cand AS (SELECT file, g, a, 4 * line - 1 AS i, 1 AS own, 4 * line AS place FROM listed UNION ALL SELECT file, g, lag(a) OVER (PARTITION BY file ORDER BY k), 4 * line - 1, 0, 4 * line - 3 FROM listed),
first AS (SELECT file, g, a, arg_min(place, 2 * i + own) AS place FROM cand GROUP BY ALL)
SELECT k, CASE k % 3 WHEN 0 THEN f.place WHEN 1 THEN h.line ELSE 0 END::INTEGER AS line FROM listed LEFT JOIN hit h USING (file, g, a) LEFT JOIN first f USING (file, g, a)"""
)
def dependency_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places in poms (where an artifactId up to three lines above a groupId counts too) and Gradle scripts; other files have none."""
    rows = _listed(spark, d)
    tags = F.concat(F.lit("<dependency>\n<groupId>"), "g", F.lit("</groupId>\n<artifactId>"), "a", F.lit("</artifactId>\n</dependency>"))
    poms = _files(rows, tags, "pom.xml", "<project>\n<dependencies>\n", "\n</dependencies>\n</project>")
    scripts = _files(rows, F.concat(F.lit("implementation '"), F.concat_ws(":", "g", "a", "v"), F.lit("'")), "build.gradle", "dependencies {\n", "\n}")
    name = F.element_at(F.array(F.lit("pom.xml"), F.lit("build.gradle"), F.lit("notes.txt")), (F.col("k") % 3 + 1).cast("int"))
    wanted = rows.select("k", F.concat(F.lit("file:///"), F.col("file").cast("string"), F.lit("/"), name).alias("file_uri"), F.col("g").alias("group_id"), F.col("a").alias("artifact_id"))
    return deps.locate(wanted, poms.unionByName(scripts)).select("k", F.col("line").cast("int").alias("line"))


#: Braces of the text itself are doubled.
_JAVA_MORE = """package com.{b};
import org.kind.Base;
enum E{k} implements Runnable, java.io.Closeable {{ A, B }}
interface I{k} extends Shape {{ }}
@Named(value = "n{v}", tags = {{"a", "b"}}) class P{k} implements Comparable<P{k}>, I{k} {{
  void run(Object o) {{
    Item item = new Item(1);
    if (o instanceof Base) {{ item.go(); }}
  }}
}}
"""
_MORE_ROWS = [
    ("PACKAGE", "Module", "pkg", "pkg", 0), ("IMPORT", "Module", "'org.kind.Base'", "'org.kind.Base'", 1),
    ("CLASS", "Enum", "pkg || '.E' || k", "'E' || k", 2), ("IMPLEMENTS_TYPE", "Class", "pkg || '.Runnable'", "'Runnable'", 2), ("IMPLEMENTS_TYPE", "Class", "'java.io.Closeable'", "'java.io.Closeable'", 2),
    ("CLASS", "Class", "pkg || '.I' || k", "'I' || k", 3), ("TYPE", "Class", "pkg || '.I' || k", "'I' || k", 3), ("INHERITANCE", "Class", "pkg || '.Shape'", "'I' || k", 3),
    ("ANNOTATION", "Property", "pkg || '.Named'", "'Named'", 4), ("CLASS", "Class", "pkg || '.P' || k", "'P' || k", 4), ("TYPE", "Class", "pkg || '.P' || k", "'P' || k", 4),
    ("IMPLEMENTS_TYPE", "Class", "pkg || '.Comparable'", "'P' || k", 4), ("IMPLEMENTS_TYPE", "Class", "pkg || '.I' || k", "'P' || k", 4),
    ("METHOD", "Method", "pkg || '.P' || k || '.run'", "'run'", 5), ("METHOD", "Method", "pkg || '.P' || k || '.run(Object)'", "'run'", 5), ("RETURN_TYPE", "Method", "pkg || '.void'", "'run'", 5), ("TYPE", "Method", "pkg || '.Object'", "'run'", 5),
    ("VARIABLE_DECLARATION", "Variable", "pkg || '.Item'", "'item'", 6), ("TYPE", "Method", "pkg || '.Item'", "'run'", 6), ("CONSTRUCTOR_CALL", "Class", "pkg || '.Item'", "'Item'", 6), ("TYPE", "Method", "pkg || '.Item'", "'run'", 6),
    ("TYPE", "Method", "'org.kind.Base'", "'run'", 7), ("METHOD_CALL", "Method", "pkg || '.Item.go'", "'run'", 7),
]
_MARKED, _MARK = ("ANNOTATION", "CLASS", "TYPE"), "pkg || '.Named tags=a value=n' || v"


@query(
    f"WITH {_LISTED}, s AS (SELECT *, 'com.' || g AS pkg, 'file:///' || file || '/P' || k || '.java' AS uri FROM listed)"
    + " UNION ALL ".join(f" SELECT uri AS file_uri, '{loc}' AS location, '{kind}' AS kind, {q} AS qualified_name, {n} AS name, {line} AS line, {_MARK if line == 4 and loc in _MARKED else 'NULL'} AS marks FROM s" for loc, kind, q, n, line in _MORE_ROWS)
)
def java_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Enums, interfaces, annotations with elements, local variables, constructor calls and instanceof."""
    text = F.lit(_JAVA_MORE.replace("{{", "{").replace("}}", "}"))
    for key, value in (("{b}", F.col("g")), ("{k}", F.col("k").cast("string")), ("{v}", F.col("v"))):
        text = F.replace(text, F.lit(key), value)
    files = _listed(spark, d).select(F.concat(F.lit("file:///"), F.col("file").cast("string"), F.lit("/P"), F.col("k").cast("string"), F.lit(".java")).alias("file_uri"), text.alias("text"))
    mark = F.try_element_at("annotations", F.lit(1))
    pairs = F.array_sort(F.transform(F.map_entries(mark["elements"]), lambda e: F.concat_ws("=", e["key"], e["value"])))
    marks = F.when(mark.isNotNull(), F.concat_ws(" ", mark["qualified_name"], pairs))
    return scan.symbols(files).select("file_uri", "location", "kind", "qualified_name", "name", "line", marks.alias("marks"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d)

