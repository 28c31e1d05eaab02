"""The dependency relation: filters, version bounds, line lookup, graph flattening, labels, identification."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.functions.patterns import full_match
from symlake.functions.versions import within
from symlake.operators import forest
from symlake.operators.snippets import lines_of
from symlake.tables import discard, large, materialize

#: Lines that a groupId and its artifactId may lie apart.
NEAR = 3
#: Wanted dependencies of equal lengths in a file that lines are held against as they are cut.
FEW = 64
#: Group given to an archive that nothing identifies; the version marks it as made up.
UNKNOWN_GROUP, UNKNOWN_VERSION = "unidentified.archive", "0.0.0-SNAPSHOT"


def dependency_name() -> Column:
    return F.concat(F.col("group_id"), F.lit("."), F.col("artifact_id"))


def select(deps: DataFrame, name: str | None = None, name_regex: str | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Dependencies by name (an exact one beats a regex, which must match in full) and inclusive version bounds."""
    if name is not None:
        deps = deps.where(dependency_name() == name)
    elif name_regex is not None:
        deps = deps.where(full_match(dependency_name(), name_regex))
    return deps.where(within(F.col("version"), lower, upper))


def pom_lines(sources: DataFrame) -> DataFrame:
    """(file_uri, i, group_text, j, artifact_text) of groupId lines below the first dependencies tag and the artifactId lines near them.

    Those are at most NEAR lines off, and not the same line. Lines meet by file and number, so that a file of any length is dealt over tasks.
    """
    lines = sources.select("file_uri", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    tag = lambda name: F.when(F.col("line").rlike(f"<{name}>.*?</{name}>"), F.trim(F.regexp_extract("line", f"<{name}>(.*?)</{name}>", 1)))
    begun = lines.where(F.contains("line", F.lit("<dependencies"))).groupBy("file_uri").agg(F.min("i").alias("begun"))
    tagged = lines.select("file_uri", "i", tag("groupId").alias("group_text"), tag("artifactId").alias("artifact_text"))
    groups = tagged.where("group_text IS NOT NULL").select("file_uri", "i", "group_text").join(large(begun), "file_uri").where("i >= begun").drop("begun")
    offsets = F.explode(F.array(*[F.lit(n) for n in range(-NEAR, NEAR + 1) if n])).alias("off")
    artifacts = tagged.where("artifact_text IS NOT NULL").select("file_uri", F.col("i").alias("j"), "artifact_text", offsets)
    return groups.join(large(artifacts.withColumn("i", F.col("j") + F.col("off")).drop("off")), ["file_uri", "i"])


def locate_in_pom(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """wanted (file_uri, group_id, artifact_id, ...) with a 1-based line, 0 if none: the first groupId line's nearest hit."""
    keys = ["file_uri", "group_id", "artifact_id"]
    asked = wanted.select(*keys).distinct()
    lines = pom_lines(sources).select("file_uri", F.col("group_text").alias("group_id"), F.col("artifact_text").alias("artifact_id"), "i", "j")
    places = lines.groupBy(*keys).agg(F.min(F.struct("i", "j")).alias("m"))
    found = asked.join(large(places), keys).select(*keys, (F.least("m.i", "m.j") + 1).alias("found"))
    return wanted.join(large(found), keys, "left").withColumn("line", F.coalesce("found", F.lit(0))).drop("found")


def locate_in_gradle(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """The first line (1-based, 0 if none) of the file that contains group:artifact.

    Lines are cut at their colons into the pieces that could be a wanted group and artifact, by the lengths that the file's wanted
    ones have, and these are joined by hash: no line meets a dependency that it doesn't hold. Where up to FEW wanted ones have the same
    lengths, pieces that are none of them are left out at once.
    """
    keys = ["file_uri", "group_id", "artifact_id"]
    asked = wanted.select(*keys).distinct()
    alike = asked.where("group_id IS NOT NULL AND artifact_id IS NOT NULL").groupBy("file_uri", F.char_length("group_id").alias("g"), F.char_length("artifact_id").alias("a"))
    pieces = F.xxhash64("group_id", "artifact_id")
    some = alike.agg(F.count("*").alias("n"), F.collect_set(F.pmod(pieces, F.lit(FEW * FEW))).alias("codes"))
    sizes = some.groupBy("file_uri").agg(F.collect_list(F.struct("g", "a", F.when(F.col("n") <= FEW, F.col("codes")).alias("codes"))).alias("sizes"))
    lines = sources.join(large(sizes), "file_uri").select("file_uri", "sizes", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    colons = F.size(F.split("line", ":", -1)) - 1
    cut = lines.where(F.contains("line", F.lit(":"))).select("file_uri", "sizes", "i", "line", F.explode(F.sequence(F.lit(1), colons)).alias("nth"))
    left = F.array_join(F.slice(F.split("line", ":", -1), F.lit(1), F.col("nth")), ":")
    sides = cut.select("file_uri", "i", left.alias("left"), F.substring("line", F.char_length(left) + 2, F.lit(1 << 30)).alias("right"), F.explode("sizes").alias("s"))
    held = sides.where((F.char_length("left") >= F.col("s.g")) & (F.char_length("right") >= F.col("s.a")))
    group = F.substring("left", F.char_length("left") - F.col("s.g") + 1, F.col("s.g"))
    hits = held.select("file_uri", group.alias("group_id"), F.substring("right", F.lit(1), F.col("s.a")).alias("artifact_id"), "i", "s.codes")
    hits = hits.where(F.col("codes").isNull() | F.array_contains("codes", F.pmod(pieces, F.lit(FEW * FEW)))).drop("codes")
    found = asked.join(large(hits.groupBy(*keys).agg((F.min("i") + 1).alias("found"))), keys)
    return wanted.join(large(found), keys, "left").withColumn("line", F.coalesce("found", F.lit(0))).drop("found")


def locate(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """By the file's name: pom.xml or *.gradle; other files give 0."""
    pom, gradle = F.col("file_uri").endswith("pom.xml"), F.col("file_uri").endswith(".gradle")
    out = locate_in_pom(wanted.where(pom), sources.where(pom)).unionByName(locate_in_gradle(wanted.where(gradle), sources.where(gradle)))
    return out.unionByName(wanted.where(~(pom | gradle)).withColumn("line", F.lit(0)))


def incidents(deps: DataFrame, build_file: str, sources: DataFrame) -> DataFrame:
    """(file_uri, line_number, name, version, group_id, artifact_id); a dependency not found in the file takes its base's line."""
    rows = deps.withColumn("file_uri", F.lit(build_file))
    own = locate(rows, sources).withColumnRenamed("line", "own_line")
    bases = own.where("base_dep IS NOT NULL AND own_line = 0").select("file_uri", F.col("base_dep.group_id").alias("group_id"), F.col("base_dep.artifact_id").alias("artifact_id")).distinct()
    base = locate(bases, sources).select(F.col("file_uri").alias("base_file"), F.col("group_id").alias("base_group"), F.col("artifact_id").alias("base_artifact"), F.col("line").alias("base_line"))
    joined = own.join(large(base), (F.col("file_uri") == F.col("base_file")) & (F.col("base_dep.group_id") == F.col("base_group")) & (F.col("base_dep.artifact_id") == F.col("base_artifact")), "left")
    line = F.coalesce(F.nullif("own_line", F.lit(0)), F.col("base_line"), F.lit(0)).cast("bigint")
    return joined.select("file_uri", line.alias("line_number"), dependency_name().alias("name"), F.coalesce("version", F.lit("")).alias("version"), "group_id", "artifact_id")


def flatten(edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path) of a forest (node_id, parent_id, ordinal): ordering by path is depth-first
    pre-order. A node below several parents comes once for each.

    One level is a join of the last level's table with the edges, however many rows there are. A cycle below a root is an
    error.
    """
    place = F.lpad(F.col("ordinal").cast("string"), 10, "0")
    again = F.array_contains("above", F.col("child"))
    level = edges.where("parent_id IS NULL").select("node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), place.alias("path"), F.array("node_id").alias("above"), F.lit(False).alias("again"))
    below = edges.where("parent_id IS NOT NULL").select(F.col("node_id").alias("child"), "parent_id", "ordinal")
    levels = [materialize(level, "level")]
    while True:
        n, cyclic = levels[-1].agg(F.count("*"), F.max("again")).first()
        if cyclic:
            raise ValueError("the graph has a cycle below a root")
        if not n:
            break
        step = levels[-1].drop("again").join(below, F.col("node_id") == F.col("parent_id"))
        row = [F.col("child").alias("node_id"), "root_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), place).alias("path"), F.concat("above", F.array("child")).alias("above"), again.alias("again")]
        levels.append(materialize(step.select(*row), "level"))
    out = levels[0]
    for one in levels[1:-1]:
        out = out.unionByName(one)
    done = materialize(out.drop("above", "again"), "flat")
    discard(*levels)
    return done


def walk(edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path) in depth-first pre-order by path: of a forest by its tours, of other graphs unfolded level by level."""
    if not forest.is_forest(edges):
        return flatten(edges)
    root = edges.where("parent_id IS NULL").select(F.col("node_id").alias("root_id"), F.lpad(F.col("ordinal").cast("string"), 10, "0").alias("place"))
    path = F.concat_ws("/", "place", F.lpad(F.col("pre").cast("string"), 12, "0"))
    return forest.preorder(edges).join(root, "root_id").select("node_id", "root_id", "depth", path.alias("path"))


def resolved(edges: DataFrame) -> DataFrame:
    """The dependency relation of a graph of ``model.EDGES``: all but roots are indirect and have their root as base.

    Of a node's edges, which may tell it differently, the one with the smallest parent and place describes it.
    """
    walked = walk(edges)
    facts = ["group_id", "artifact_id", "version", "classifier", "scope", "pom_path"]
    info = edges.groupBy("node_id").agg(F.min_by(F.struct(*facts), F.struct("parent_id", "ordinal", *facts)).alias("f")).select("node_id", "f.*")
    root = info.select(F.col("node_id").alias("root_id"), F.struct("group_id", "artifact_id", "version", "pom_path").alias("base"))
    joined = walked.join(info, "node_id").join(root, "root_id")
    return joined.select("group_id", "artifact_id", "version", "classifier", F.coalesce("scope", F.lit("compile")).alias("scope"), F.lit(None).cast("string").alias("jar_path"), F.lit(False).alias("has_source_jar"), (F.col("depth") > 0).alias("indirect"), "pom_path", F.when(F.col("depth") > 0, F.col("base")).alias("base_dep"), F.col("path"))


def unresolved(rows: DataFrame) -> DataFrame:
    """The same relation of dependencies known without a graph: (group_id, artifact_id, version, classifier, pom_path,
    ordinal), all direct; scope and jar_path are taken where there are such columns."""
    has = lambda c, other: F.col(c) if c in rows.columns else other
    base = F.lit(None).cast("struct<group_id:string,artifact_id:string,version:string,pom_path:string>")
    return rows.select("group_id", "artifact_id", "version", "classifier", F.coalesce(has("scope", F.lit(None)), F.lit("compile")).alias("scope"), has("jar_path", F.lit(None)).cast("string").alias("jar_path"), F.lit(False).alias("has_source_jar"), F.lit(False).alias("indirect"), "pom_path", base.alias("base_dep"), F.lpad(F.col("ordinal").cast("string"), 10, "0").alias("path"))


def with_jars(deps: DataFrame, listing: DataFrame, repository: str) -> DataFrame:
    """deps with the jars that a local repository really holds: jar_path (null if there is none) and has_source_jar.

    listing (path) has the repository's files; repository is written as the paths begin.
    """
    place = F.concat_ws("/", F.lit(repository.rstrip("/")), F.replace("group_id", F.lit("."), F.lit("/")), "artifact_id", "version", F.concat_ws("-", "artifact_id", "version"))
    known = listing.select("path").distinct()
    asked = deps.drop("jar_path", "has_source_jar").withColumns({"own_jar": F.concat(place, F.coalesce(F.concat(F.lit("-"), "classifier"), F.lit("")), F.lit(".jar")), "own_sources": F.concat(place, F.lit("-sources.jar"))})
    found = asked.join(known.toDF("jar_path"), F.col("own_jar") == F.col("jar_path"), "left").join(known.toDF("source_path"), F.col("own_sources") == F.col("source_path"), "left")
    return found.withColumn("has_source_jar", F.col("source_path").isNotNull()).drop("own_jar", "own_sources", "source_path").select(*deps.columns)


#: What the nested form tells of each dependency.
TOLD = ["group_id", "artifact_id", "version"]


def nested(edges: DataFrame) -> DataFrame:
    """(root_id, ordinal, json): each root's tree as nested JSON; a node below several parents comes once for each."""
    if forest.is_forest(edges):
        return forest.nested(edges, TOLD)
    info = edges.groupBy("node_id").agg(F.min_by(F.struct(*TOLD), F.struct("parent_id", "ordinal", *TOLD)).alias("f")).select(F.col("node_id").alias("known"), "f.*")
    rows = flatten(edges).join(info, F.col("node_id") == F.col("known"))
    # Each occurrence is a node of its own: its root and the places on the way to it.
    way = F.concat_ws("#", "root_id", "path")
    parent = F.when(F.col("depth") > 0, F.regexp_replace(way, "/[^/]*$", ""))
    return forest.nested(rows.select(way.alias("node_id"), parent.alias("parent_id"), F.element_at(F.split("path", "/"), -1).cast("long").alias("ordinal"), *TOLD), TOLD)


def labels(deps: DataFrame, patterns: Sequence[str] = (), excluded: Iterable[str] = (), domain: str = "dependency") -> DataFrame:
    """deps with labels: language, exclude for excluded group prefixes, and whether the source is open.

    Everything is open source where no pattern is given.
    """
    coordinate = F.concat_ws(":", "group_id", "artifact_id")
    opened = F.lit(not patterns)
    for p in patterns:
        opened |= full_match(coordinate, p)
    out = F.lit(False)
    for e in excluded:
        out |= F.col("group_id").startswith(e)
    found = F.array(F.lit(f"{domain}/language=java"), F.when(out, F.lit(f"{domain}/exclude=true")), F.concat(F.lit(f"{domain}/dep-source="), F.when(opened, "open-source").otherwise("internal")))
    return deps.withColumn("labels", F.array_compact(found))


#: Dependencies in one row of by_file.
CHUNK = 1000


def by_file(declared: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file_uri, chunk, n, dependencies): declared dependencies of each file in their order, those of a range of ordinals in a row.

    A row is of bounded size whatever its file holds; rows of one file in the order of chunk are its list.
    """
    one = F.struct("ordinal", "group_id", "artifact_id", "version", "classifier", "scope")
    part = F.floor(F.col("ordinal") / chunk).cast("long").alias("chunk")
    return declared.groupBy("file_uri", part).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("dependencies"))


def identify(archives: DataFrame, index: DataFrame, unknown_group: str = UNKNOWN_GROUP) -> DataFrame:
    """Coordinates of archives (path, sha1, properties struct or null): by index (sha1, ...), own properties, or name.

    Archives that nothing identifies are put into unknown_group. The index may hold millions of rows; both sides are joined by hash on sha1.
    """
    known = index.select("sha1", F.struct("group_id", "artifact_id", "version").alias("by_sha")).groupBy("sha1").agg(F.min("by_sha").alias("by_sha"))
    file = F.element_at(F.split("path", "/"), -1)
    made = F.struct(F.lit(unknown_group).alias("group_id"), F.regexp_replace(file, r"\.[^.]*$", "").alias("artifact_id"), F.lit(UNKNOWN_VERSION).alias("version"))
    joined = archives.join(known, "sha1", "left")
    return joined.withColumn("c", F.coalesce("by_sha", "properties", made)).select("path", "sha1", "c.*", F.when(F.col("by_sha").isNotNull(), "sha1").when(F.col("properties").isNotNull(), "properties").otherwise("name").alias("identified_by"))


def managed_versions(wanted: DataFrame, managed: DataFrame) -> DataFrame:
    """wanted (group_id, artifact_id) with the version of the first managed entry (ordinal, group_id, artifact_id, version)."""
    first = managed.groupBy("group_id", "artifact_id").agg(F.min_by("version", "ordinal").alias("version"))
    return wanted.join(first, ["group_id", "artifact_id"], "left")
