"""Symbol- and dependency-shaped views of relational test tables, so that SQL can check the operators.

Each view exists twice: as a DataFrame, and as the SQL of a common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATIONS = ["TYPE", "IMPORT", "METHOD", "METHOD_CALL", "FIELD", "ANNOTATION", "CONSTRUCTOR_CALL", "PACKAGE", "RETURN_TYPE", "CLASS", "INHERITANCE", "VARIABLE_DECLARATION"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sym_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    brand = F.lower(F.regexp_replace("p_brand", "#", ""))
    name = F.regexp_replace("p_name", " ", "_")
    package = F.concat(F.lit("com."), brand, F.lit("."), F.lower("p_type"))
    location = F.element_at(F.array(*[F.lit(x) for x in LOCATIONS]), (F.col("p_size") % len(LOCATIONS) + 1).cast("int"))
    full = F.concat(package, F.lit("."), F.when(F.col("p_partkey") % 4 == 0, F.regexp_replace(name, "_", ".")).otherwise(name), F.when(F.col("p_partkey") % 3 == 0, "<T>").otherwise(""))
    line = (F.col("p_partkey") % 400).cast("int")
    return p.select(F.col("p_partkey").alias("sym_id"), full.alias("qualified_name"), F.substring_index("p_name", " ", -1).alias("name"), F.when(location.isin("IMPORT", "PACKAGE"), "Module").otherwise("Class").alias("kind"), location.alias("location"), F.concat(F.lit("file:///src/"), brand, F.lit("/F"), (F.col("p_partkey") % 17).cast("string"), F.lit(".java")).alias("file_uri"), package.alias("package_name"), line.alias("line"), (line % 7).alias("start_char"), line.alias("end_line"), (line % 7 + 5).alias("end_char"), F.col("p_brand").endswith("5").alias("is_dependency"))


_IN = ", ".join(f"'{x}'" for x in LOCATIONS)
SYM_PARTS = f"""sym_parts AS (
  SELECT p_partkey AS sym_id, pkg || '.' || CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '.') ELSE replace(p_name, ' ', '_') END || CASE WHEN p_partkey % 3 = 0 THEN '<T>' ELSE '' END AS qualified_name,
    string_split(p_name, ' ')[-1] AS name, CASE WHEN loc IN ('IMPORT', 'PACKAGE') THEN 'Module' ELSE 'Class' END AS kind, loc AS location, 'file:///src/' || brand || '/F' || (p_partkey % 17) || '.java' AS file_uri, pkg AS package_name,
    (p_partkey % 400)::INTEGER AS line, ((p_partkey % 400) % 7)::INTEGER AS start_char, (p_partkey % 400)::INTEGER AS end_line, ((p_partkey % 400) % 7 + 5)::INTEGER AS end_char, ends_with(p_brand, '5') AS is_dependency
  FROM (SELECT *, lower(replace(p_brand, '#', '')) AS brand, 'com.' || lower(replace(p_brand, '#', '')) || '.' || lower(p_type) AS pkg, [{_IN}][p_size % {len(LOCATIONS)} + 1] AS loc FROM part))"""


def sym_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link is an import of host.path, a heading a class; the url is the file."""
    p = read(spark, sf_dir, "pages")
    links = p.select("page_id", F.col("url").alias("file_uri"), F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("link"))
    host = lambda c: F.regexp_extract(c, "://([^/]+)", 1)
    imports = links.select("page_id", F.concat(host("file_uri"), F.lit("."), "link").alias("qualified_name"), F.col("link").alias("name"), F.lit("Module").alias("kind"), F.lit("IMPORT").alias("location"), "file_uri")
    heads = p.select("page_id", F.concat(host("url"), F.lit(".page")).alias("qualified_name"), F.lit("page").alias("name"), F.lit("Class").alias("kind"), F.lit("TYPE").alias("location"), F.col("url").alias("file_uri"))
    return imports.unionByName(heads)


SYM_PAGES = """sym_pages AS (
  SELECT page_id, regexp_extract(url, '://([^/]+)', 1) || '.' || link AS qualified_name, link AS name, 'Module' AS kind, 'IMPORT' AS location, url AS file_uri
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS link FROM pages)
  UNION ALL SELECT page_id, regexp_extract(url, '://([^/]+)', 1) || '.page', 'page', 'Class', 'TYPE', url FROM pages)"""


def sym_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a class of its user, with the event type and the property k as its annotation's name and element."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    mark = F.struct(F.concat_ws(".", "event_type", k).alias("qualified_name"), F.create_map(F.lit("k"), k).alias("elements"))
    return e.select("event_id", "user_id", F.array(mark).alias("annotations"))


def dep_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions above nations above suppliers, as ``model.EDGES``."""
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    none = F.lit(None).cast("string")
    tail = [none.alias("classifier"), F.lit("compile").alias("scope"), F.lit("pom.xml").alias("pom_path")]
    r, n, s = (read(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    regions = r.select(node("r", "r_regionkey").alias("node_id"), none.alias("parent_id"), F.col("r_regionkey").cast("int").alias("ordinal"), F.lit("region").alias("group_id"), F.col("r_name").alias("artifact_id"), F.lit("1").alias("version"), *tail)
    nations = n.select(node("n", "n_nationkey").alias("node_id"), node("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("int").alias("ordinal"), F.lit("nation").alias("group_id"), F.col("n_name").alias("artifact_id"), F.lit("2").alias("version"), *tail)
    suppliers = s.select(node("s", "s_suppkey").alias("node_id"), node("n", "s_nationkey").alias("parent_id"), F.col("s_suppkey").cast("int").alias("ordinal"), F.lit("supplier").alias("group_id"), F.col("s_name").alias("artifact_id"), F.lit("3").alias("version"), *tail)
    return regions.unionByName(nations).unionByName(suppliers)


def dep_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return p.select(F.col("p_partkey").alias("dep_id"), F.concat(F.lit("org."), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("group_id"), F.regexp_replace("p_name", " ", "-").alias("artifact_id"), version.alias("version"))


DEP_VERSIONS = """dep_versions AS (
  SELECT p_partkey AS dep_id, 'org.' || lower(replace(p_brand, '#', '')) AS group_id, replace(p_name, ' ', '-') AS artifact_id, p_size || '.' || (p_partkey % 20) || '.' || (p_partkey % 7) AS version FROM part)"""
