"""Sessions: an engine opens workspaces; a workspace answers conditions on one project's two relations."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.model import EDGES, SYMBOLS
from symlake.operators import conditions as C
from symlake.operators import deps as D
from symlake.operators import maven, snippets, symbols
from symlake.plans.conditions import Config, parse_dependency, parse_referenced
from symlake.sources import archives, builds, gradle, poms, scan, sha_index
from symlake.sources.store import SymbolStore
from symlake.tables import delete, exists, materialize, names_in, new_path, qualified


class Workspace:
    """One project. Relations are lazy; the symbol table is written once, partitioned by location, and read from then on.

    With cache (and a work_dir that stays) a table is kept for each state of the sources and found again, and of a new
    state only the files whose contents are new are parsed.
    """

    def __init__(self, spark: SparkSession, config: Config, edges: DataFrame | None = None, work_dir: str | None = None, cache: bool = False) -> None:
        self.spark, self.config = spark, config
        self._own_dir = work_dir is None
        self.work_dir = work_dir or new_path(spark, "workspace")
        if config.location.startswith("mvn://"):
            config = self.config = replace(config, location=self._in_repository(config.location))
        self.is_archive = config.location.lower().endswith((".jar", ".war", ".ear"))
        self.edges = edges if edges is not None else self._graph()
        self.resolved = D.resolved(self.edges) if self.edges is not None else self._unresolved()
        if config.maven_repository:
            self.resolved = materialize(D.with_jars(self.resolved, scan.listing(spark, config.maven_repository, "*.jar"), qualified(spark, config.maven_repository)), "resolved")
        self._store = SymbolStore(spark, f"{self.work_dir}/store") if cache else None
        self.files, rows = self._read()
        if config.maven_repository:
            rows = rows.unionByName(self._dependency_symbols())
        self.symbol_path = f"{self.work_dir}/symbols-{self._content_hash()}" if cache else f"{self.work_dir}/symbols"
        if not (cache and exists(spark, f"{self.symbol_path}/_SUCCESS")):
            scan.write_symbols(rows, self.symbol_path)
        self.symbols = spark.read.schema(SYMBOLS).parquet(self.symbol_path)
        self.closed = False

    def _in_repository(self, uri: str) -> str:
        """Where the local repository keeps what a mvn:// location names; nothing is downloaded."""
        c = builds.parse_maven_uri(uri)
        place = c.directory or self.config.maven_repository
        if not place:
            raise LookupError(f"{uri} needs a local repository")
        found = [p for p in (builds.jar_path(place, c.group_id, c.artifact_id, c.version, c.classifier), f"{place}/{c.artifact_id}-{c.version}.jar") if exists(self.spark, p)]
        if not found:
            raise LookupError(f"{uri} is not in {place}")
        return found[0]

    def _graph(self) -> DataFrame | None:
        """The graph of Gradle's printed trees, or of a Maven project resolved from a local repository; none without either."""
        if self.config.gradle_trees:
            trees = scan.read_files(self.spark, self.config.gradle_trees, "*", self.config.encoding)
            # Nodes are told apart by the print they come from.
            return gradle.edges(trees).withColumn("pom_path", F.lit(self.build_file))
        if not self.config.maven_repository or self.is_archive or self.build_tool != "maven":
            return None
        files, roots = self._project_poms()
        repository = scan.read_files(self.spark, self.config.maven_repository, "*.pom", self.config.encoding)
        return maven.resolve(files, repository, roots).select(*[f.name for f in EDGES])

    def _project_poms(self) -> tuple[DataFrame, DataFrame]:
        """The poms of the root and the modules it names (project, file_uri, text, root_uri), and their order; modules without a pom are passed over."""
        place = F.rtrim(scan.relative(F.regexp_replace("file_uri", "/?[^/]*$", "/"), self.config.location), F.lit("/"))
        found = self.build_files().where("file_uri LIKE '%/pom.xml'").select("file_uri", "text", place.alias("place"))
        root = found.where("place = ''")
        listed = poms.read(root).select(F.posexplode("pom.modules.module").alias("at", "module"))
        modules = listed.groupBy(F.trim("module", F.lit("/")).alias("place")).agg((F.min("at") + 1).alias("ordinal"))
        placed = root.withColumn("ordinal", F.lit(0)).unionByName(found.join(modules.where("place <> ''"), "place"))
        # The root stands for the parent of modules that name none.
        files = materialize(placed.select(F.lit("").alias("project"), "file_uri", "text", "ordinal", F.lit(self.build_file).alias("root_uri"), F.lit("pom.xml").alias("pom_path")), "poms")
        return files, files.select("project", "file_uri", "pom_path", "ordinal")

    def _unresolved(self) -> DataFrame:
        """Dependencies without a graph: identified archives, a Maven project's direct ones, or those a script declares."""
        none = F.lit(None).cast("string")
        if self.is_archive:
            return D.unresolved(self.archive_dependencies().select("*", none.alias("classifier"), F.lit(self.config.location).alias("pom_path"), F.col("path").alias("jar_path"), F.lit(0).alias("ordinal")))
        if self.build_tool == "gradle":
            return D.unresolved(builds.declared(self.build_files()).where("file_uri LIKE '%build.gradle'").withColumn("pom_path", F.col("file_uri")))
        files, roots = self._project_poms()
        rows = maven.effective(files, inherit=False).join(roots.select("file_uri", "pom_path", F.col("ordinal").alias("root")), "file_uri")
        return D.unresolved(rows.withColumn("ordinal", F.col("root") * (1 << 20) + F.col("place")[1]))

    def _dependency_symbols(self) -> DataFrame:
        """Symbols of the resolved dependencies that the repository holds: of their sources, else of their classes."""
        held = self.resolved.where("jar_path IS NOT NULL OR has_source_jar").select("group_id", "artifact_id", "version", "jar_path", "has_source_jar").distinct().collect()  # one project's
        base = qualified(self.spark, self.config.maven_repository)
        sources = [builds.jar_path(base, r["group_id"], r["artifact_id"], r["version"], "sources") for r in held if r["has_source_jar"]]
        binaries = [r["jar_path"] for r in held if not r["has_source_jar"]]
        out = self.spark.createDataFrame([], SYMBOLS)
        if sources:
            out = out.unionByName(scan.symbols(archives.java_files(archives.read_entries(self.spark, sources)), is_dependency=True))
        if binaries:
            out = out.unionByName(archives.class_symbols(archives.read_entries(self.spark, binaries), is_dependency=True))
        return out

    def exploded(self) -> DataFrame:
        """An archive's entries with their places in a Maven-style project."""
        return archives.exploded(archives.read_entries(self.spark, self.config.location))

    def archive_dependencies(self) -> DataFrame:
        """The archives inside this one (path, sha1, coordinates, how they were identified); with an index, by digest first."""
        facts = archives.nested_facts(self.spark, self.config.location)
        path = self.config.index_path
        if path and sha_index.is_written(self.spark, path):
            index = sha_index.lookup(self.spark, path, facts)
        else:
            index = builds.artifact_index(self.spark, path) if path else self.spark.createDataFrame([], "sha1 string, group_id string, artifact_id string, version string")
        return D.identify(facts, index, self.config.unknown_group)

    def synthetic_pom(self) -> str:
        """A pom that declares what an archive holds, as an exploded project would have it."""
        rows = self.archive_dependencies().select("group_id", "artifact_id", "version").distinct().orderBy("group_id", "artifact_id", "version")
        return builds.synthetic_pom([tuple(r) for r in rows.collect()])  # one archive's

    def _content_hash(self) -> str:
        """A fingerprint of all sources: a table cached in work_dir is used again as long as none changes."""
        mixed = self.files.select(F.xxhash64("file_uri", "text").cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
        return f"{mixed['n']}-{int(mixed['s'] or 0) % (1 << 64):016x}"

    def _read(self) -> tuple[DataFrame, DataFrame]:
        spark, config = self.spark, self.config
        if self.is_archive:
            found = archives.read_entries(spark, config.location)
            own = ~F.col("entry").rlike("(?i)[.](jar|war|ear)$") & (F.col("depth") == 0)
            app, other = found.where(own), found.where("depth > 0")
            files = archives.java_files(app)
            rows = scan.symbols(files).unionByName(archives.class_symbols(app)).unionByName(archives.class_symbols(other, is_dependency=True)).unionByName(scan.symbols(archives.java_files(other), is_dependency=True))
            return files, rows
        files = scan.app_files(spark, config.location, config.included_paths, config.encoding)
        parse = self._store.symbols if self._store else scan.symbols
        rows = parse(files)
        for root in config.dependency_roots:
            rows = rows.unionByName(parse(scan.dependency_files(spark, root), is_dependency=True))
        return files, rows

    @property
    def build_tool(self) -> str:
        return builds.detect_build_tool(names_in(self.spark, self.config.location), self.config.location)

    @property
    def build_file(self) -> str:
        """The root's build file; of an archive, the archive itself."""
        if self.is_archive:
            return qualified(self.spark, self.config.location)
        name = "build.gradle" if self.build_tool == "gradle" else "pom.xml"
        return f"{qualified(self.spark, self.config.location)}/{name}"

    def build_files(self) -> DataFrame:
        poms = scan.read_files(self.spark, self.config.location, "pom.xml", self.config.encoding)
        return poms.unionByName(scan.read_files(self.spark, self.config.location, "*.gradle", self.config.encoding))

    def evaluate(self, capability: str, condition: str) -> DataFrame:
        """The incidents of a YAML condition; an unknown capability or a condition of another kind gives none."""
        self._check()
        if capability == "referenced" and (c := parse_referenced(condition)):
            return symbols.referenced(self.symbols, c.pattern, c.location, c.annotation, c.elements, c.files)
        if capability == "dependency" and (d := parse_dependency(condition)):
            found = D.select(self.resolved, d.name, d.name_regex, d.lower, d.upper)
            sources = self.spark.createDataFrame([], "file_uri string, text string") if self.is_archive else self.build_files()
            return D.incidents(found, self.build_file, sources)
        return self.spark.createDataFrame([], "file_uri string, line_number long")

    def evaluate_dependencies(self, conditions: Mapping[str, str]) -> DataFrame:
        """(cond_id, dependency columns) of many YAML dependency conditions in one pass; those of another kind match nothing."""
        self._check()
        parsed = {ident: parse_dependency(text) for ident, text in conditions.items()}
        return C.match(self.resolved, [C.Condition(ident, d.name, d.name_regex, d.lower, d.upper) for ident, d in parsed.items() if d])

    def matched(self, capability: str, condition: str) -> bool:
        return not self.evaluate(capability, condition).isEmpty()

    def dependencies(self) -> DataFrame:
        """Dependencies with labels; declared ones without if there are none with a version."""
        self._check()
        if self.resolved.isEmpty() and not self.is_archive:
            return builds.declared(self.build_files())
        lines = self.spark.read.text(self.config.label_file).collect() if self.config.label_file else []  # a short list of patterns
        patterns = builds.label_patterns("\n".join(r[0] for r in lines))
        return D.labels(self.resolved, patterns, self.config.exclude_packages, self.config.label_domain)

    def dependency_dag(self) -> list[dict[str, Any]]:
        self._check()
        rows = D.nested(self.edges).orderBy("ordinal", "root_id").select("json").collect() if self.edges is not None else []  # one project's response
        return [json.loads(r["json"]) for r in rows]

    def snippets(self, incidents: DataFrame, context: int | None = None) -> DataFrame:
        self._check()
        return snippets.snippets(incidents, self.files, self.config.context_lines if context is None else context)

    def dependency_locations(self, wanted: DataFrame) -> DataFrame:
        """wanted (file_uri, group_id, artifact_id) with their lines."""
        self._check()
        return D.locate(wanted, self.build_files())

    def parse_errors(self) -> DataFrame:
        return scan.parse_errors(self.files)

    def size(self) -> int:
        return self.symbols.count()

    def close(self) -> None:
        self.closed = True
        if self._own_dir:
            delete(self.spark, self.work_dir)

    def _check(self) -> None:
        if self.closed:
            raise LookupError("unknown workspace id")


class Engine:
    """Opens and finds workspaces."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._workspaces, self._ids = spark, {}, itertools.count(1)

    def capabilities(self) -> list[str]:
        return ["referenced", "dependency"]

    def init(self, config: Config, edges: DataFrame | None = None) -> int:
        """A workspace's id. edges: the resolved dependency graph (``model.EDGES``), which needs a network to compute."""
        ident = next(self._ids)
        self._workspaces[ident] = Workspace(self.spark, config, edges)
        return ident

    def workspace(self, ident: int) -> Workspace:
        if ident not in self._workspaces:
            raise LookupError("unknown workspace id")
        return self._workspaces[ident]

    def evaluate(self, ident: int, capability: str, condition: str) -> DataFrame:
        return self.workspace(ident).evaluate(capability, condition)

    def stop(self, ident: int) -> None:
        found = self._workspaces.pop(ident, None)
        if found:
            found.close()
