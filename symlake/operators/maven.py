"""Maven models as joins: parent chains, property scopes, managed versions with imports, and offline resolution.

All takes a relation of poms (project, file_uri, pom): project is null for those of a repository, which any pom may name by its
coordinates, and says whose checkout a file belongs to otherwise. Every step is a join on coordinates or a grouped minimum; a
fixpoint writes one table a round, and rounds are as many as the longest chain, import nesting or dependency depth.

Rules: the nearest value of a property wins, and a pom's own coordinates win over properties of their names. Managed
entries are ordered by (distance, place), a BOM's entries taking the place of its import; the first that names the dependency and has a
version gives it. A dependency without any version stays, with null.

Resolution keeps one artifact for each group, artifact, type and classifier of a project: that of least depth, and among these the one
declared first along its path. Children of what lost are never looked at. Optional dependencies, test and provided ones of
dependencies, those that any ancestor excludes and those without a version aren't followed. Version ranges aren't solved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.sources.poms import entries, interpolate_first, read
from symlake.tables import discard, large, materialize

_INHERITED = 1 << 20
GAV = ["group_id", "artifact_id", "version"]


def poms(files: DataFrame) -> DataFrame:
    """(pom_id, project, file_uri, root_id, pom, own coordinates) of files (file_uri, text[, project, root_uri]), as a written table.

    root_uri names the file of the same project that is a pom's parent where it names none that is known.
    """
    rows = files
    for name in ("project", "root_uri"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    raw = read(rows.select("project", "file_uri", "root_uri", "text")).drop("text")
    own = lambda c: F.coalesce(f"pom.{c}", f"pom.parent.{c}")
    ident = lambda uri: F.concat(F.coalesce("project", F.lit("")), F.lit("#"), uri)
    return materialize(raw.select(ident("file_uri").alias("pom_id"), "project", "file_uri", F.when(F.col("root_uri") != F.col("file_uri"), ident("root_uri")).alias("root_id"), "pom", own("groupId").alias("group_id"), F.col("pom.artifactId").alias("artifact_id"), own("version").alias("version")), "poms")


def _held(models: DataFrame) -> DataFrame:
    """(project, coordinates, target): the pom that coordinates stand for; of several the one with the least id."""
    return models.where("group_id IS NOT NULL AND artifact_id IS NOT NULL AND version IS NOT NULL").groupBy("project", *GAV).agg(F.min("pom_id").alias("target"))


def _find(asked: DataFrame, held: DataFrame, prefix: str = "") -> DataFrame:
    """asked with target: the pom of its coordinates in its own project, else in the repository; null if there is none."""
    at = lambda rows, name: rows.select(F.col("project").alias("hp"), *[F.col(c).alias(f"h_{c}") for c in GAV], F.col("target").alias(name))
    same = lambda: [F.col(f"{prefix}{c}") == F.col(f"h_{c}") for c in GAV]
    on = lambda *more: [*same(), *more]
    extra = ["hp", *[f"h_{c}" for c in GAV]]
    near = asked.join(large(at(held.where("project IS NOT NULL"), "near")), on(F.col("project") == F.col("hp")), "left").drop(*extra)
    far = near.join(large(at(held.where("project IS NULL"), "far")), on(), "left").drop(*extra)
    return far.withColumn("target", F.coalesce("near", "far")).drop("near", "far")


def chains(models: DataFrame) -> DataFrame:
    """(pom_id, ancestor, distance) of every pom: itself at 0, its parent at 1, and so on; a chain ends where it would repeat."""
    held = materialize(_held(models), "held")
    links = models.where("pom.parent IS NOT NULL OR root_id IS NOT NULL").select("pom_id", "project", "root_id", *[F.col(f"pom.parent.{x}").alias(f"parent_{c}") for x, c in zip(("groupId", "artifactId", "version"), GAV, strict=True)])
    found = _find(links, held, "parent_").select(F.col("pom_id").alias("child"), F.coalesce("target", "root_id").alias("parent"))
    links = materialize(found.where("parent IS NOT NULL"), "links")
    levels = [materialize(models.select("pom_id", F.col("pom_id").alias("ancestor"), F.lit(0).alias("distance"), F.array("pom_id").alias("above")), "chain")]
    while not levels[-1].isEmpty():
        step = levels[-1].join(large(links), F.col("ancestor") == F.col("child")).where(~F.array_contains("above", F.col("parent")))
        levels.append(materialize(step.select("pom_id", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance"), F.concat("above", F.array("parent")).alias("above")), "chain"))
    out = levels[0]
    for one in levels[1:-1]:
        out = out.unionByName(one)
    out = materialize(out.drop("above"), "chains")
    discard(held, links, *levels)
    return out


def scopes(models: DataFrame, chain: DataFrame) -> DataFrame:
    """(pom_id, properties): the merged property scope of every pom, nearest values first."""
    facts = models.select(F.col("pom_id").alias("ancestor"), "pom", "group_id", "artifact_id", "version")
    rows = chain.join(large(facts), "ancestor")
    d = F.col("distance")
    listed = rows.where("pom.properties IS NOT NULL").select("pom_id", d.alias("rank"), F.explode("pom.properties").alias("key", "value"))
    one = lambda key, value, rank: F.struct(F.lit(key).alias("key"), value.alias("value"), rank.alias("rank"))
    own, up = d == 0, d == 1
    named = F.array(
        # An own version beats the property of its name; one that is inherited gives way to it.
        one("project.version", F.when(own, F.col("pom.version")), F.lit(-1)),
        one("project.groupId", F.when(own, F.col("pom.groupId")), F.lit(-1)),
        one("project.artifactId", F.when(own, F.col("artifact_id")), F.lit(-1)),
        one("project.version", F.coalesce("version", "pom.parent.version"), _INHERITED + d),
        one("project.groupId", F.coalesce("group_id", "pom.parent.groupId"), _INHERITED + d),
        one("project.parent.version", F.when(own, F.col("pom.parent.version")).when(up, F.col("version")), _INHERITED + d),
        one("project.parent.groupId", F.when(own, F.col("pom.parent.groupId")).when(up, F.col("group_id")), _INHERITED + d),
    )
    given = rows.select("pom_id", F.explode(named).alias("x")).select("pom_id", "x.rank", "x.key", "x.value")
    nearest = listed.unionByName(given).where("value IS NOT NULL").groupBy("pom_id", "key").agg(F.min_by("value", "rank").alias("value"))
    found = nearest.groupBy("pom_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
    every = models.select("pom_id").join(large(found), "pom_id", "left")
    return materialize(every.select("pom_id", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")), "scopes")


def _in_scope(rows: DataFrame, entry: str, *more: str) -> DataFrame:
    """rows (properties, an entry struct, ...) with the entry's parts interpolated."""
    value = lambda name: interpolate_first(F.col(f"{entry}.{name}"), F.col("properties"))
    cut = F.transform(F.coalesce(F.col(f"{entry}.exclusions.exclusion"), F.array().cast("array<struct<groupId:string,artifactId:string>>")), lambda x: F.concat_ws(":", x["groupId"], x["artifactId"]))
    return rows.select(*more, value("groupId").alias("group_id"), value("artifactId").alias("artifact_id"), value("version").alias("version"), value("classifier").alias("classifier"), F.col(f"{entry}.scope").alias("scope"), F.coalesce(F.col(f"{entry}.type"), F.lit("jar")).alias("type"), F.coalesce(F.lower(F.col(f"{entry}.optional")) == "true", F.lit(False)).alias("optional"), cut.alias("exclusions"))


def managed(models: DataFrame, chain: DataFrame, scope: DataFrame) -> DataFrame:
    """(pom_id, place array<int>, group_id, artifact_id, version): each pom's managed versions in their order.

    An import is replaced by the managed entries of its BOM, whose own parents and imports count, until none is left; a
    BOM that is being replaced already is passed over.
    """
    held = materialize(_held(models), "held")
    listed = models.select(F.col("pom_id").alias("ancestor"), F.posexplode(entries("pom.dependencyManagement.dependencies")).alias("at", "entry"))
    rows = chain.join(large(listed), "ancestor").join(large(scope), "pom_id").join(large(models.select("pom_id", "project")), "pom_id")
    every = _in_scope(rows.withColumn("place", F.array("distance", "at")), "entry", "pom_id", "project", "place")
    is_bom = F.col("type").eqNullSafe("pom") & F.col("scope").eqNullSafe("import")
    every = materialize(every.withColumn("is_bom", is_bom), "entries")
    imports = _find(every.where("is_bom AND version IS NOT NULL").select("pom_id", "project", "place", *GAV), held).where("target IS NOT NULL")
    imports = materialize(imports.select(F.col("pom_id").alias("importer"), "place", F.col("target").alias("bom")), "imports")
    found = [every.where("NOT is_bom AND version IS NOT NULL").select("pom_id", "place", *GAV)]
    entry = found[0].select(F.col("pom_id").alias("bom"), F.col("place").alias("inner"), *GAV)
    open_ = [materialize(imports.select(F.col("importer").alias("pom_id"), "place", "bom", F.array("importer", "bom").alias("above")), "open")]
    while not open_[-1].isEmpty():
        found.append(open_[-1].join(large(entry), "bom").select("pom_id", F.concat("place", "inner").alias("place"), *GAV))
        deeper = open_[-1].join(large(imports.select(F.col("importer").alias("bom"), F.col("place").alias("inner"), F.col("bom").alias("next"))), "bom").where(~F.array_contains("above", F.col("next")))
        open_.append(materialize(deeper.select("pom_id", F.concat("place", "inner").alias("place"), F.col("next").alias("bom"), F.concat("above", F.array("next")).alias("above")), "open"))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    first = out.groupBy("pom_id", "group_id", "artifact_id").agg(F.min(F.struct("place", "version")).alias("m"))
    out = materialize(first.select("pom_id", "m.place", "group_id", "artifact_id", "m.version"), "managed")
    discard(held, every, imports, *open_)
    return out


DIRECT = ["pom_id", "place", *GAV, "classifier", "scope", "type", "optional", "exclusions"]


def effective(files: DataFrame, inherit: bool = True) -> DataFrame:
    """(pom_id, project, file_uri, own_*, ``DIRECT``): the dependencies of every pom with managed versions, as a written table.

    With inherit, those of parents count, unless a nearer pom declares the same artifact; place is (distance, ordinal).
    """
    models = poms(files)
    chain = chains(models)
    scope = scopes(models, chain)
    versions = managed(models, chain, scope)
    listed = models.select(F.col("pom_id").alias("ancestor"), F.posexplode(entries("pom.dependencies")).alias("at", "entry"))
    rows = chain.where("true" if inherit else "distance = 0").join(large(listed), "ancestor").join(large(scope), "pom_id")
    each = _in_scope(rows.withColumn("place", F.array("distance", "at")), "entry", "pom_id", "properties", "place")
    if inherit:
        key = ["pom_id", "group_id", "artifact_id", "type", F.coalesce("classifier", F.lit("")).alias("c")]
        nearest = each.groupBy(*key).agg(F.min(F.col("place")[0]).alias("nearest"))
        each = each.withColumn("c", F.coalesce("classifier", F.lit(""))).join(large(nearest), ["pom_id", "group_id", "artifact_id", "type", "c"]).where("place[0] = nearest")
    known = versions.select("pom_id", "group_id", "artifact_id", F.col("version").alias("managed"))
    joined = each.join(large(known), ["pom_id", "group_id", "artifact_id"], "left").withColumn("version", interpolate_first(F.coalesce("version", "managed"), F.col("properties")))
    own = models.select("pom_id", "project", "file_uri", *[F.col(c).alias(f"own_{c}") for c in GAV])
    out = materialize(joined.select(*DIRECT).join(large(own), "pom_id"), "effective")
    discard(models, chain, scope, versions)
    return out


def _scope_below(above: Column, own: Column) -> Column:
    """The scope that a dependency of a dependency has."""
    return F.when(above.isin("test", "provided"), above).when((above == "runtime") | (own == "runtime"), F.lit("runtime")).otherwise(F.lit("compile"))


def resolve(projects: DataFrame, repository: DataFrame, roots: DataFrame) -> DataFrame:
    """``model.EDGES`` (and project, depth) of resolved trees, one for each project.

    projects and repository are poms (project, file_uri, text) and (file_uri, text); roots (project, file_uri, pom_path, ordinal) are the poms
    of a project whose dependencies are its direct ones, in order. Their modules' trees are apart, as they resolve apart.
    """
    known = repository.select(F.lit(None).cast("string").alias("project"), "file_uri", "text")
    rows = effective(projects.drop("ordinal", "pom_path").unionByName(known, allowMissingColumns=True))
    ga = [F.col("group_id"), F.col("artifact_id"), F.col("type"), F.coalesce("classifier", F.lit(""))]
    root = roots.select("project", "file_uri", "pom_path", F.col("ordinal").alias("root"))
    # Direct ones are the pom's own; those of a repository's poms are joined by coordinates.
    direct = rows.where("project IS NOT NULL AND place[0] = 0").drop("pom_id").join(large(root), ["project", "file_uri"])
    tree = F.concat_ws("#", "project", "file_uri")
    node = F.concat_ws("#", "tree", F.concat_ws(":", *ga))
    fields = ["tree", "project", "node_id", "parent_id", "place", *GAV, "classifier", "type", "scope", "pom_path", "exclusions", "depth"]
    start = direct.withColumn("tree", tree).select("tree", "project", node.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.array("root"), "place").alias("place"), *GAV, "classifier", "type", F.coalesce("scope", F.lit("compile")).alias("scope"), "pom_path", "exclusions", F.lit(0).alias("depth"))
    repo = rows.where("project IS NULL AND NOT optional AND version IS NOT NULL AND coalesce(scope, 'compile') NOT IN ('test', 'provided', 'system')")
    # A pom's dependencies count once for its coordinates, whatever files hold them.
    first = repo.groupBy(*[f"own_{c}" for c in GAV]).agg(F.min("pom_id").alias("pom_id"))
    child = materialize(repo.join(large(first.select("pom_id")), "pom_id", "left_semi").select(*[F.col(f"own_{c}").alias(f"up_{c}") for c in GAV], F.col("place").alias("at"), *[F.col(c).alias(f"c_{c}") for c in (*GAV, "classifier", "scope", "type", "exclusions")]), "children")
    best = lambda df: materialize(df.groupBy("tree", "node_id").agg(F.min_by(F.struct(*fields), "place").alias("x")).select("x.*"), "level")
    levels = [best(start)]
    chosen = levels[0].select("tree", "node_id")
    while not levels[-1].isEmpty():
        up = levels[-1]
        step = up.join(large(child), [up[c] == F.col(f"up_{c}") for c in GAV])
        out = F.exists("exclusions", lambda x: x.isin("*:*", "*") | (x == F.concat_ws(":", "c_group_id", "c_artifact_id")) | (x == F.concat_ws(":", F.lit("*"), "c_artifact_id")) | (x == F.concat_ws(":", "c_group_id", F.lit("*"))))
        step = step.where(~out).select("tree", "project", F.col("node_id").alias("parent_id"), F.concat("place", "at").alias("place"), *[F.col(f"c_{c}").alias(c) for c in GAV], F.col("c_classifier").alias("classifier"), F.col("c_type").alias("type"), _scope_below(F.col("scope"), F.coalesce("c_scope", F.lit("compile"))).alias("scope"), "pom_path", F.array_union("exclusions", "c_exclusions").alias("exclusions"), (F.col("depth") + 1).alias("depth"))
        fresh = step.withColumn("node_id", node).join(large(chosen), ["tree", "node_id"], "left_anti")
        levels.append(best(fresh))
        chosen = chosen.unionByName(levels[-1].select("tree", "node_id"))
    every = levels[0]
    for one in levels[1:-1]:
        every = every.unionByName(one)
    order = Window.partitionBy("tree", F.coalesce("parent_id", F.lit(""))).orderBy("place")
    ordinal = F.when(F.col("parent_id").isNull(), F.col("place")[0] * (1 << 20)).otherwise(0) + F.row_number().over(order) - 1
    out = materialize(every.select("project", "node_id", "parent_id", ordinal.cast("int").alias("ordinal"), *GAV, "classifier", "scope", "pom_path", "depth"), "resolved")
    discard(rows, child, *levels)
    return out
