"""Queries over build files that are derived from the part table: fifty parts make a small project with its repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import maven
from symlake.plans import analogs as A
from symlake.plans.catalog import query
from symlake.sources import poms
from symlake.tables import large

#: Keys of a block, artifacts of a block, and how far a part's two dependencies lie behind it.
BLOCK, ARTIFACTS, STEPS = 50, 20, (7, 11)
LEVELS = BLOCK // STEPS[0] + 1


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / BLOCK).cast("long").alias("block"), (F.col("p_partkey") % BLOCK).cast("int").alias("i"), F.col("p_size").cast("string").alias("v"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


_LISTED = f"listed AS (SELECT p_partkey AS k, p_partkey // {BLOCK} AS block, (p_partkey % {BLOCK})::INTEGER AS i, p_size::VARCHAR AS v FROM part)"


@query(
    f"""WITH {_LISTED}, p AS (SELECT a.k, a.v, b.v AS v1, c.v AS v2 FROM listed a LEFT JOIN listed b ON b.k = a.k - 1 AND b.block = a.block LEFT JOIN listed c ON c.k = a.k - 2 AND c.block = a.block),
x AS (SELECT *, CASE k % 4 WHEN 0 THEN 'v' || v WHEN 1 THEN coalesce('v' || v1, '${{p' || (k - 1) || '}}') || '.1' WHEN 2 THEN coalesce(coalesce('v' || v2, '${{p' || (k - 2) || '}}') || '.1', '') || '-${{none}}' END AS filled, '${{p' || k || '}}' AS me FROM p),
y AS (SELECT *, CASE WHEN k % 4 = 2 AND v1 IS NULL THEN '${{p' || (k - 1) || '}}-${{none}}' ELSE filled END AS whole FROM x)
SELECT k, CASE k % 4 WHEN 3 THEN 'a' || me || 'zzzzzb' || me || 'zzzzz' ELSE 'a' || whole || 'b' || whole END AS every,
  CASE WHEN k % 4 = 3 THEN 'a' || me || 'zzzzzb' || me WHEN k % 4 = 2 OR (k % 4 = 1 AND v1 IS NULL) THEN 'a' || whole || 'b' || me ELSE 'a' || whole || 'b' || whole END AS leftmost FROM y"""
)
def maven_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Both ways to replace keys, over values that hold further keys, unknown ones and themselves; a block's values are one scope."""
    p = _parts(spark, d)
    key = lambda k: _text("${p", k, "}")
    value = F.when(F.col("k") % 4 == 0, _text("v", F.col("v"))).when(F.col("k") % 4 == 1, _text(key(F.col("k") - 1), ".1")).when(F.col("k") % 4 == 2, _text(key(F.col("k") - 1), "-${none}")).otherwise(_text(key(F.col("k")), "z"))
    scope = p.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct(_text("p", F.col("k")), value))).alias("properties"))
    text = _text("a", key(F.col("k")), "b", key(F.col("k")))
    rows = p.join(large(scope), "block").select("k", text.alias("text"), "properties")
    return rows.select("k", poms.interpolate_all(F.col("text"), F.col("properties")).alias("every"), poms.interpolate_first(F.col("text"), F.col("properties")).alias("leftmost"))


_PROPERTIES = "<properties><v0>0</v0><v1>${inner}</v1><v2>2</v2><inner>1</inner></properties>"
_BOM = "<project><groupId>g{b}</groupId><artifactId>bom</artifactId><version>1</version><properties><zero>0</zero></properties><dependencyManagement><dependencies>{e}</dependencies></dependencyManagement></project>"
_PARENT = "<project><groupId>g{b}</groupId><artifactId>parent</artifactId><version>1</version><packaging>pom</packaging>" + _PROPERTIES + "<dependencyManagement><dependencies>{e}</dependencies></dependencyManagement></project>"
_TOP = "<project><parent><groupId>g{b}</groupId><artifactId>parent</artifactId><version>1</version></parent><artifactId>app</artifactId><dependencies>{e}</dependencies></project>"


def _entry(artifact: int | str, version: str | None = None, more: str = "") -> str:
    return f"<dependency><groupId>g{{b}}</groupId><artifactId>a{artifact}</artifactId>{f'<version>{version}</version>' if version else ''}{more}</dependency>"


#: The parent manages every third artifact and imports a bill of materials for others, which loses to entries before it and wins over those behind.
_IMPORT = "<dependency><groupId>g{b}</groupId><artifactId>bom</artifactId><version>1</version><type>pom</type><scope>import</scope></dependency>"
_OWN = "".join(_entry(j, "${v1}") for j in range(0, ARTIFACTS, 3))
_TEXTS = {
    "parent.pom": _PARENT.replace("{e}", _OWN + _IMPORT + _entry(1, "2")),
    "bom.pom": _BOM.replace("{e}", _entry(0, "9") + "".join(_entry(j, "${zero}") for j in range(1, ARTIFACTS, 3))),
}
_DIRECT = _entry(0, "${v0}") + _entry(1) + _entry(2) + _entry(5, "0", "<scope>runtime</scope>")


def _repository(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(projects, repository): a part is an artifact of twenty in its block, in one of three versions, and depends on two parts behind it."""
    p = _parts(spark, d)
    i = F.col("i")

    def entry(step: int, more: Column) -> Column:
        t = i + step
        version = F.when(i % 2 == 0, _text("<version>${v", F.floor(t / ARTIFACTS), "}</version>")).otherwise("")
        return F.when(t < BLOCK, _text("<dependency><groupId>${project.groupId}</groupId><artifactId>a", t % ARTIFACTS, "</artifactId>", version, more, "</dependency>")).otherwise("")

    group = _text("g", F.col("block"))
    cut = F.when(i % 3 == 0, _text("<exclusions><exclusion><groupId>", group, "</groupId><artifactId>a", (i + 18) % ARTIFACTS, "</artifactId></exclusion></exclusions>")).otherwise("")
    second = _text(F.when(i % 5 == 4, "<optional>true</optional>").otherwise(""), F.when(i % 13 == 12, "<scope>test</scope>").when(i % 4 == 1, "<scope>runtime</scope>").otherwise(""))
    head = _text("<project><parent><groupId>", group, "</groupId><artifactId>parent</artifactId><version>1</version></parent><artifactId>a", i % ARTIFACTS, "</artifactId><version>", F.floor(i / ARTIFACTS), "</version><dependencies>")
    nodes = p.select(_text("repo/", F.col("k"), ".pom").alias("file_uri"), _text(head, entry(STEPS[0], cut), entry(STEPS[1], second), "</dependencies></project>").alias("text"))
    blocks = p.select("block").distinct()
    known = nodes
    for name, text in _TEXTS.items():
        known = known.unionByName(blocks.select(_text("repo/", F.col("block"), "/", name).alias("file_uri"), F.replace(F.lit(text), F.lit("{b}"), F.col("block").cast("string")).alias("text")))
    tops = blocks.select(_text("b", F.col("block")).alias("project"), _text("b", F.col("block"), "/pom.xml").alias("file_uri"), F.replace(F.lit(_TOP.replace("{e}", _DIRECT)), F.lit("{b}"), F.col("block").cast("string")).alias("text"))
    return tops, known


_MANAGED = f"CASE (t % {ARTIFACTS}) % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END"
_EDGES = f"""{_LISTED}, steps AS (SELECT k, block, i, i + {STEPS[0]} AS t, 0 AS step FROM listed UNION ALL SELECT k, block, i, i + {STEPS[1]}, 1 FROM listed),
edges AS (SELECT k, block, i, step, t % {ARTIFACTS} AS a, CASE WHEN i % 2 = 0 THEN (t // {ARTIFACTS})::VARCHAR ELSE {_MANAGED} END AS version,
  CASE WHEN step = 0 THEN 'compile' WHEN i % 13 = 12 THEN 'test' WHEN i % 4 = 1 THEN 'runtime' ELSE 'compile' END AS scope, step = 1 AND i % 5 = 4 AS optional,
  CASE WHEN step = 0 AND i % 3 = 0 THEN [(i + 18) % {ARTIFACTS}] ELSE []::INTEGER[] END AS cut FROM steps WHERE t < {BLOCK})"""
_TOPS = "tops AS (SELECT DISTINCT block, unnest([{'at': 0, 'a': 0, 'version': '0', 'scope': 'compile'}, {'at': 1, 'a': 1, 'version': '0', 'scope': 'compile'}, {'at': 2, 'a': 2, 'version': NULL, 'scope': 'compile'}, {'at': 3, 'a': 5, 'version': '0', 'scope': 'runtime'}]) AS x FROM (SELECT DISTINCT block FROM listed))"


@query(
    f"""WITH {_EDGES}, {_TOPS}
SELECT 'repo/' || k || '.pom' AS file_uri, 'a' || a AS artifact_id, version, step::INTEGER AS ordinal, optional FROM edges
UNION ALL SELECT 'b' || block || '/pom.xml', 'a' || x.a, x.version, x.at::INTEGER, false FROM tops"""
)
def maven_managed(spark: SparkSession, d: str) -> DataFrame:
    """Versions of own entries, of properties and entries of a parent outside the project, and of a bill of materials it imports; null where there is none."""
    tops, known = _repository(spark, d)
    rows = maven.effective(tops.unionByName(known.select(F.lit(None).cast("string").alias("project"), "file_uri", "text")), inherit=False)
    return rows.select("file_uri", "artifact_id", "version", F.col("place")[1].alias("ordinal"), "optional")


def _resolved_sql() -> str:
    """Breadth first, a level a common table expression: the least place among the shallowest wins."""
    node = f"a + {ARTIFACTS} * version::INTEGER"
    out = [f"WITH {_EDGES}, {_TOPS}, w0 AS (SELECT block, x.a AS a, x.version AS version, x.scope AS scope, [0, 0, x.at] AS place, []::INTEGER[] AS cut, NULL::VARCHAR AS parent FROM tops)"]
    seen = "SELECT block, a FROM w0"
    for n in range(1, LEVELS + 1):
        out.append(
            f""", c{n} AS (SELECT w.block, e.a, e.version, CASE WHEN w.scope = 'runtime' OR e.scope = 'runtime' THEN 'runtime' ELSE 'compile' END AS scope, list_concat(w.place, [0, e.step]) AS place, list_concat(w.cut, e.cut) AS cut, 'a' || w.a AS parent
  FROM w{n - 1} w JOIN edges e ON e.block = w.block AND e.i = w.{node.replace('version', 'w.version')} WHERE NOT e.optional AND e.scope <> 'test' AND e.version IS NOT NULL AND NOT list_contains(w.cut, e.a)),
w{n} AS (SELECT * FROM c{n} WHERE (block, a) NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY block, a ORDER BY place) = 1)"""
        )
        seen += f" UNION ALL SELECT block, a FROM w{n}"
    rows = " UNION ALL ".join(f"SELECT 'b' || block AS project, 'a' || a AS artifact_id, version, scope, parent, {n} AS depth FROM w{n}" for n in range(LEVELS + 1))
    return "".join(out) + " " + rows


@query(_resolved_sql())
def maven_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Whole trees from a repository of poms: nearest wins, exclusions, optional and test dependencies, scopes, versions by parents and imports."""
    tops, known = _repository(spark, d)
    out = maven.resolve(tops, known, tops.select("project", "file_uri", F.lit("pom.xml").alias("pom_path"), F.lit(0).alias("ordinal")))
    parent = F.regexp_extract(F.element_at(F.split("parent_id", "#"), -1), "^[^:]*:([^:]*)", 1)
    return out.select("project", "artifact_id", "version", "scope", F.when(F.col("parent_id").isNotNull(), parent).alias("parent"), "depth")
