import hashlib
import io
import itertools
import json
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith, StringStartsWith

from symlake.functions.patterns import glob_to_regex
from symlake.functions.versions import version_key
from symlake.model import Location as L
from symlake.operators import conditions, deps, forest, maven, postings, rules, symbols
from symlake.plans import catalog
from symlake.plans.conditions import Config, ConditionError, parse_dependency, parse_referenced
from symlake.plans.workspace import Engine
from symlake.sources import archives, builds, gradle, poms, scan, sha_index, store, zip_source
from tests.oracle import DATA
from tests.test_java_extract import BEAN, SERVICE


@pytest.fixture(scope="module")
def beans(spark):
    files = spark.createDataFrame([("file:///p/Bean.java", BEAN), ("file:///p/Service.java", SERVICE)], "file_uri string, text string")
    return scan.symbols(files).persist()


@pytest.mark.parametrize(
    "pattern,location,n",
    [("javax.ejb.Singleton", "IMPORT", 1), ("org.springframework.stereotype.*", "IMPORT", 1), ("javax.ejb.*", "IMPORT", 2), ("javax.ejb", "PACKAGE", 2), ("javax.*", "PACKAGE", 2), ("* com.example.apps.Bean", "FIELD", 1), ("com.example.apps.Bean.get*", "METHOD", 1), ("doStuff", "METHOD", 1), ("com.example.apps.Bean.getName", "METHOD_CALL", 1), ("com.example.apps.String", "VARIABLE_DECLARATION", 1), ("javax.ejb.Singleton", "ANNOTATION", 1), ("com.example.apps.Bean", "CONSTRUCTOR_CALL", 1), ("none.at.all", "IMPORT", 0)],
)
def test_queries(beans, pattern, location, n):
    assert symbols.query(beans, pattern, L.parse(location)).count() == n


def test_types_include_imports(beans):
    for word in ("TYPE", "type"):
        assert "Module" in [r["kind"] for r in symbols.query(beans, "javax.ejb.Singleton", L.parse(word)).collect()]
    assert {"Class", "Field"} <= {r["kind"] for r in symbols.query(beans, "com.example.apps.Bean", L.TYPE).collect()}
    assert symbols.query(beans, "com.example.apps.Bean<*>", L.TYPE).count() == symbols.query(beans, "com.example.apps.Bean", L.TYPE).count()


def test_package_rows_are_renamed(beans):
    assert {r["name"] for r in symbols.query(beans, "javax.ejb", L.PACKAGE).collect()} == {"javax.ejb"}


def test_whole_conditions(beans):
    out = symbols.referenced(beans, "javax.ejb.Singleton", L.ANNOTATION).first()
    assert (out["line_number"], out["kind"], out["start"]["line"]) == (7, "Property", 6)
    assert symbols.referenced(beans, "*", L.CLASS, "javax.ejb.Singleton").count() == 1
    assert symbols.referenced(beans, "* *Bean", L.METHOD, "no.such").count() == 1
    assert symbols.referenced(beans, "* *Bean", L.METHOD, "no.such", annotate_return_types=True).count() == 0
    assert symbols.referenced(beans, "*", L.CLASS, files=["/p/Service.java"]).count() == 1
    assert symbols.referenced(beans, "*", L.CLASS, files=["file:///p/None.java"]).count() == 0


@pytest.mark.parametrize("word,want", [(None, "DEFAULT"), ("", "DEFAULT"), ("type", "TYPE_KEYWORD"), ("field_declaration", "FIELD"), ("Method_Call", "METHOD_CALL"), ("nonsense", "TYPE")])
def test_locations(word, want):
    assert L.parse(word).value == want


@pytest.mark.parametrize("glob,yes,no", [("a(b|c)d", ["abd", "acd"], ["a(b|c)d"]), ("a(b)c", ["a(b)c"], ["abc"]), ("(a|(b|c))", ["a", "(b", "c)"], ["b"]), ("a?c", ["abc"], ["ac"]), ("a.b*", ["a.b", "a.b.c"], ["axb"]), ("a$b", ["a$b"], ["a"]), ("a|b", ["a|b"], ["a"]), ("((", ["(("], []), ("a)b", ["a)b"], []), ("x<*>", ["x<y>"], ["x"])])
def test_globs(glob, yes, no):
    assert all(re.fullmatch(glob_to_regex(glob), s) for s in yes)
    assert not any(re.fullmatch(glob_to_regex(glob), s) for s in no)


@settings(max_examples=200, deadline=None)
@given(st.text("ab.*?$[", max_size=8), st.text("ab.$[", max_size=8))
def test_globs_against_a_small_matcher(glob, text):
    def fits(g, s):
        if not g:
            return not s
        if g[0] == "*":
            return fits(g[1:], s) or bool(s) and fits(g, s[1:])
        return bool(s) and (g[0] == "?" or g[0] == s[0]) and fits(g[1:], s[1:])

    assert bool(re.fullmatch(glob_to_regex(glob), text)) == fits(glob, text)


def test_version_order(spark):
    order = ["1-alpha-1", "1-alpha-2", "1-beta-1", "1-m1", "1-rc1", "1-SNAPSHOT", "1", "1-sp", "1-xyz", "1-1", "1.0.1", "1.2", "1.10", "2-alpha", "2.0", "2.0.1", "10.0"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(version_key(F.col("v"))).collect()]
    assert got == order
    same = [("1", "1.0"), ("1", "1.0.0"), ("1", "1-ga"), ("1", "1.final"), ("1-cr2", "1-rc2"), ("1a1", "1-alpha-1"), ("1.0-SNAPSHOT", "1-snapshot"), ("01.2", "1.2")]
    for a, b in same:
        x = spark.range(1).select(version_key(F.lit(a)).alias("a"), version_key(F.lit(b)).alias("b")).first()
        assert x["a"] == x["b"], (a, b)


def test_rules_in_one_pass_are_like_single_queries(beans):
    some = [rules.Rule("f", "com.example.*"), rules.Rule("g", "*", L.METHOD_CALL), rules.Rule("h", "Bean.*", L.METHOD), rules.Rule("i", "getName", L.METHOD_CALL), rules.Rule("j", "com.example.apps.Bean<T>", L.parse("type")), rules.Rule("k", "com.example.apps.Bean.setName(String)", L.METHOD), rules.Rule("l", "* *String", L.FIELD), rules.Rule("n", "javax.?jb.Sing*"), rules.Rule("a", "javax.ejb.*", L.IMPORT), rules.Rule("b", "com.example.apps.Bean", L.CLASS), rules.Rule("c", "do*", L.METHOD), rules.Rule("d", "com.example.apps.Bean"), rules.Rule("e", "nothing", L.FIELD)]
    got = dict(rules.match_rules(beans, some, chunk=2).groupBy("rule_id").count().collect())
    want = {r.rule_id: symbols.query(beans, r.pattern, r.location).count() for r in some}
    assert got == {k: v for k, v in want.items() if v}


POM = """<project xmlns="http://maven.apache.org/POM/4.0.0">
  <groupId>g</groupId><properties><spring.version>5.3.${minor}</spring.version><minor>20</minor></properties>
  <dependencies>
    <dependency>
      <groupId>org.springframework</groupId>
      <artifactId>spring-core</artifactId>
      <version>${spring.version}</version>
    </dependency>
    <dependency>
      <artifactId>javax.servlet-api</artifactId>
      <groupId>javax.servlet</groupId>
      <version>4.0.1</version>
    </dependency>
  </dependencies>
</project>
"""


def files(spark, texts, **more):
    rows = [(uri, text, *[v.get(uri) for v in more.values()]) for uri, text in texts.items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("file_uri", "text", *more)))


def dependency(group, artifact, version=None, more=""):
    return f"<dependency><groupId>{group}</groupId><artifactId>{artifact}</artifactId>{f'<version>{version}</version>' if version else ''}{more}</dependency>"


def project(gav, dependencies="", managed="", properties="", parent=None, more=""):
    tags = lambda x: "".join(f"<{n}>{v}</{n}>" for n, v in zip(("groupId", "artifactId", "version"), x.split(":"), strict=False) if v)
    up = f"<parent>{tags(parent)}</parent>" if parent else ""
    return f"<project>{up}{tags(gav)}<properties>{properties}</properties><dependencyManagement><dependencies>{managed}</dependencies></dependencyManagement><dependencies>{dependencies}</dependencies>{more}</project>"


def test_poms(spark):
    found = builds.declared(files(spark, {"/a/pom.xml": POM, "/b/pom.xml": "<!DOCTYPE x>" + POM, "/c/pom.xml": "<bad", "/d/pom.xml": "", "/e/other.xml": POM})).orderBy("ordinal").collect()
    assert [r[:3] for r in found] == [("org.springframework", "spring-core", "5.3.20"), ("javax.servlet", "javax.servlet-api", "4.0.1")]
    lines = POM.split("\n")
    assert [lines[r["line"]].strip() for r in found] == ["<groupId>org.springframework</groupId>", "<groupId>javax.servlet</groupId>"]


@pytest.mark.parametrize(
    ("text", "properties", "every", "leftmost"),
    [
        ("${a}-${b}-${a}", {"a": "1"}, "1-${b}-1", "1-${b}-${a}"),
        ("${a}", {"a": "${b}${b}", "b": "${c}", "c": "x"}, "xx", "xx"),
        ("${a}", {"a": "${a}z"}, "${a}zzzzz", "${a}zzzzz"),
        ("no keys", {"a": "1"}, "no keys", "no keys"),
        ("${a", {"a": "1"}, "${a", "${a"),
        ("${}${a}", {"a": "$1\\"}, "${}$1\\", "${}${a}"),
        (None, {"a": "1"}, None, None),
        ("${a}${a}${a}${a}${a}${a}", {"a": "1"}, "111111", "11111${a}"),
        ("é${a}é\n${a}", {"a": "日"}, "é日é\n日", "é日é\n日"),
    ],
)
def test_interpolation(spark, text, properties, every, leftmost):
    df = spark.createDataFrame([(text, properties)], "t string, p map<string,string>")
    assert tuple(df.select(poms.interpolate_all(F.col("t"), F.col("p")), poms.interpolate_first(F.col("t"), F.col("p"))).first()) == (every, leftmost)


def versions(rows):
    return sorted(((r["artifact_id"], r["version"]) for r in rows.collect()), key=repr)


def test_managed_versions(spark):
    """Own entries first, then a BOM in its place, its parent's and imports' entries, then the parent's; cycles end."""
    boot = "<type>pom</type><scope>import</scope>"
    texts = {
        "app": project("g:app:1", "".join(dependency("x", a) for a in "abcdefg") + dependency("x", "h", "${project.version}-${deep}"), dependency("x", "a", "own") + dependency("m", "bom", "${b}", boot) + dependency("x", "b", "late"), "<b>1</b>", "g:up:9"),
        "up": project("g:up:9", dependency("x", "inherited", "0"), dependency("x", "c", "parent-${b}") + dependency("x", "a", "no"), "<deep>d</deep>", "g:top:9"),
        "top": project("g:top:9", "", dependency("x", "d", "top"), "", "g:up:9"),
        "bom": project("m:bom:1", "", dependency("x", "b", "${v}") + dependency("m", "bom2", "1", boot) + dependency("m", "bom", "1", boot), "<v>bom</v>", "m:bomtop:1"),
        "bomtop": project("m:bomtop:1", "", dependency("x", "e", "bomtop-${v}")),
        "bom2": project("m:bom2:1", "", dependency("x", "f", "bom2")),
    }
    rows = files(spark, texts, project={"app": "p"})
    own = maven.effective(rows, inherit=False).where("file_uri = 'app'")
    want = [("a", "own"), ("b", "bom"), ("c", "parent-1"), ("d", "top"), ("e", "bomtop-bom"), ("f", "bom2"), ("g", None), ("h", "1-d")]
    assert versions(own) == sorted(want, key=repr)
    assert versions(maven.effective(rows).where("file_uri = 'app'")) == sorted([*want, ("inherited", "0")], key=repr)


def test_resolution(spark):
    """Nearest wins before first declared; what lost is not followed; exclusions, scopes and missing poms."""
    top = {"b/pom.xml": project("t:app:1", dependency("g", "a", "1") + dependency("g", "b", "1", "<scope>test</scope>") + dependency("g", "z"))}
    repo = {
        "a": project("g:a:1", dependency("g", "c", "2", "<exclusions><exclusion><groupId>g</groupId><artifactId>f</artifactId></exclusion></exclusions>") + dependency("g", "t", "1", "<scope>test</scope>") + dependency("g", "o", "1", "<optional>true</optional>") + dependency("g", "r", "1", "<scope>runtime</scope>")),
        "b": project("g:b:1", dependency("g", "c", "1") + dependency("g", "d", "1")),
        "c2": project("g:c:2", dependency("g", "d", "2") + dependency("g", "f", "1") + dependency("g", "a", "7")),
        "c1": project("g:c:1", dependency("g", "lost", "1")),
        "d": project("g:d:1", dependency("g", "f", "3")),
        "r": project("g:r:1", dependency("g", "s", "1")),
    }
    roots = spark.createDataFrame([("p", "b/pom.xml", "pom.xml", 0)], "project string, file_uri string, pom_path string, ordinal int")
    out = maven.resolve(files(spark, top, project={"b/pom.xml": "p"}), files(spark, repo), roots)
    found = {(r["artifact_id"], r["version"], r["scope"], r["depth"]) for r in out.collect()}
    assert found == {("a", "1", "compile", 0), ("b", "1", "test", 0), ("z", None, "compile", 0), ("c", "2", "compile", 1), ("r", "1", "runtime", 1), ("d", "1", "test", 1), ("f", "3", "test", 2), ("s", "1", "runtime", 2)}
    tree = deps.resolved(out)
    assert {(r["artifact_id"], r["base_dep"]["artifact_id"] if r["indirect"] else None) for r in tree.collect()} == {("a", None), ("b", None), ("z", None), ("c", "a"), ("r", "a"), ("d", "b"), ("f", "b"), ("s", "a")}
    none = spark.createDataFrame([], "file_uri string, text string")
    assert maven.resolve(none.select(F.lit("p").alias("project"), "*"), none, roots).count() == 0


def test_modules(spark, tmp_path):
    root = "<project><groupId>g</groupId><version>7</version><modules><module>a</module><module>gone</module></modules><properties><v>2</v></properties><dependencies><dependency><groupId>x</groupId><artifactId>top</artifactId><version>1</version></dependency></dependencies></project>"
    child = "<project><artifactId>a</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>own</artifactId><version>${project.version}</version></dependency><dependency><groupId>y</groupId><artifactId>z</artifactId><version>${v}</version></dependency></dependencies></project>"
    for place, text in (("", root), ("a", child), ("a/deep", child), ("other", child)):
        (tmp_path / place).mkdir(exist_ok=True)
        (tmp_path / place / "pom.xml").write_text(text)
    engine = Engine(spark)
    own = engine.workspace(engine.init(Config(str(tmp_path))))
    assert [(r["artifact_id"], r["version"]) for r in own.resolved.orderBy("path").collect()] == [("top", "1"), ("own", "7"), ("z", "2")]
    assert "<artifactId>a&amp;b</artifactId>" in builds.synthetic_pom([("g", "a&b", "1")])


def test_transitive_dependencies_of_a_checkout(spark, tmp_path):
    """With a local repository no graph is needed."""
    (tmp_path / "app").mkdir()
    (tmp_path / "app/pom.xml").write_text(project("t:app:1", dependency("g", "a"), parent="g:up:1"))
    for gav, text in {"g:up:1": project("g:up:1", managed=dependency("g", "a", "1")), "g:a:1": project("g:a:1", dependency("g", "b", "2")), "g:b:2": project("g:b:2")}.items():
        g, a, v = gav.split(":")
        (tmp_path / "repo" / g / a / v).mkdir(parents=True)
        (tmp_path / "repo" / g / a / v / f"{a}-{v}.pom").write_text(text)
    engine = Engine(spark)
    ident = engine.init(Config(str(tmp_path / "app"), maven_repository=str(tmp_path / "repo")))
    assert {(r["name"], r["version"]) for r in engine.evaluate(ident, "dependency", "dependency: {name_regex: 'g[.].*'}").collect()} == {("g.a", "1"), ("g.b", "2")}
    assert engine.workspace(ident).dependency_dag()[0]["children"][0]["artifact_id"] == "b"


def test_cached_symbols(spark, tmp_path):
    from symlake.plans.workspace import Workspace

    (tmp_path / "src").mkdir()
    (tmp_path / "src/Bean.java").write_text(BEAN)
    open_ = lambda: Workspace(spark, Config(str(tmp_path / "src")), work_dir=str(tmp_path / "work"), cache=True)
    first, again = open_(), open_()
    assert first.symbol_path == again.symbol_path and again.size() == 17
    (tmp_path / "src/Bean.java").write_text(SERVICE)
    assert open_().symbol_path != first.symbol_path


def test_only_new_contents_are_parsed(spark, tmp_path):
    sources = {f"file:///p/B{k}.java": BEAN.replace("class Bean", f"class Bean{k}") for k in range(40)} | {"file:///q/Copy.java": BEAN.replace("class Bean", "class Bean7"), "file:///q/Empty.java": "", "file:///q/None.java": None}
    own = store.SymbolStore(spark, str(tmp_path))
    assert own.update(files(spark, sources)) == 41 and own.update(files(spark, sources)) == 0
    changed = sources | {"file:///p/B3.java": SERVICE}
    assert own.update(files(spark, changed)) == 1
    known = lambda df: sorted(map(repr, df.collect()))
    for state in (changed, sources):
        assert known(own.symbols(files(spark, state))) == known(scan.symbols(files(spark, state)))


def test_archives_are_read_by_ranges(spark, tmp_path, monkeypatch):
    """A large archive by several tasks; names pushed down to the source; broken archives and entries passed over."""
    rnd = random.Random(1)
    many = {f"p{k % 7}/E{k}.{'class' if k % 3 else 'txt'}": rnd.randbytes(3000) for k in range(400)} | {"../evil": b"no"}
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep/large.jar", "w") as z:
        for name, content in many.items():
            z.writestr(name, content)
    (tmp_path / "small.WAR").write_bytes(zipped({"a.txt": "1"}))
    (tmp_path / "broken.jar").write_bytes(b"no archive")
    (tmp_path / "other.zip").write_bytes(zipped({"b.txt": "1"}))
    monkeypatch.setattr(zip_source, "PART", 100_000)
    reader = zip_source.EntryReader([str(tmp_path)])
    parts = reader.partitions()
    assert len([p for p in parts if p.archives[0][0].endswith("large.jar")]) >= 10
    got = {(path.rpartition("/")[2], e): c for p in parts for b in reader.read(p) for path, e, c in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True)}
    assert got == {("large.jar", n): c for n, c in many.items() if n != "../evil"} | {("small.WAR", "a.txt"): b"1"}
    kept = EqualTo(("archive",), "x")
    assert list(reader.pushFilters([kept, StringEndsWith(("entry",), ".class"), StringStartsWith(("entry",), "p3/")])) == [kept]
    wanted = {n for n in many if n.startswith("p3/") and n.endswith(".class")}
    assert {e for p in reader.partitions() for b in reader.read(p) for e in b.column(1).to_pylist()} == wanted
    monkeypatch.undo()
    df = zip_source.scan(spark, str(tmp_path)).where("entry LIKE 'p3/%' AND endswith(entry, '.class')").select("archive", "entry")
    assert {r["entry"] for r in df.collect()} == wanted and all(r["archive"].startswith("file:///") for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # the source has taken them all


def files_read(df):
    """How many files the scan of a plan without joins reads."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value()


def test_sorted_index(spark, tmp_path, monkeypatch):
    digest = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(digest(k), f"g{k}", "a", "1") for k in range(3000)] + [(None, "no", "no", "0")]
    sha_index.write(spark.createDataFrame(rows, "sha1 string, group_id string, artifact_id string, version string"), str(tmp_path / "i"))
    asked = lambda *ks: spark.createDataFrame([(digest(k).upper(),) for k in ks] + [(None,)], "sha1 string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few = sha_index.lookup(spark, str(tmp_path / "i"), asked(5, 9000))
        assert [r["group_id"] for r in few.collect()] == ["g5"] and files_read(few) <= 2 < 200
        assert "In(sha1" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    monkeypatch.setattr(sha_index, "LITERALS", 3)
    many = sha_index.lookup(spark, str(tmp_path / "i"), asked(*range(10), 9000))
    assert sorted(r["group_id"] for r in many.collect()) == sorted(f"g{k}" for k in range(10))
    assert sha_index.is_written(spark, str(tmp_path / "i")) and not sha_index.is_written(spark, str(tmp_path))


def scripts(spark, *texts):
    return spark.createDataFrame([(f"/{k}/build.gradle", t) for k, t in enumerate(texts)], "file_uri string, text string")


def test_gradle(spark):
    text = "plugins { }\ndependencies {\n  implementation 'a:b:1'\n  testImplementation \"c:d:2\"\n  if (x) { api 'e:f:3' }\n}\nimplementation 'no:no:0'\n"
    other = "dependencies { api 'a:b:1' }\nbuildscript {\n  dependencies {\n    classpath('c:d:2') // api 'no:no:1'\n    /* api 'no:no:2'\n */ constraints { runtimeOnly(\"e:f:3\") }\n    api project(':x')\n    myapi 'no:no:3'\n    compileOnly 'g:h'\n  }\n}\napi 'no:no:4'\n// dependencies {\napi 'no:no:5'\nimplementation \"it's: { not: closed\"\n"
    odd = "} }\ndependencies {\n  api \'\'\'a:b:1\'\'\' }\n}\nx { dependencies(\"d\") {\n api ( ( 'q:r:1'\n } api 'no:no:1' }\ndependencies { def s = '" + "y" * 30_000 + "'\n api 'z:z:9' }"
    found = gradle.declared(scripts(spark, text, other, "dependencies {\n  api 'a:b:1'; api 'c:d:2'\n", odd, "", None)).orderBy("file_uri", "ordinal").collect()
    of = lambda k: [(r["group_id"], r["artifact_id"], r["version"], r["line"], r["ordinal"]) for r in found if r["file_uri"] == f"/{k}/build.gradle"]
    assert of(0) == [("a", "b", "1", 2, 0), ("c", "d", "2", 3, 1), ("e", "f", "3", 4, 2)]
    assert of(1) == [("a", "b", "1", 0, 0), ("c", "d", "2", 3, 1), ("e", "f", "3", 5, 2)]
    assert of(2) == [("a", "b", "1", 1, 0)]
    assert of(3) == [("a", "b", "1", 2, 0), ("q", "r", "1", 5, 1), ("z", "z", "9", 8, 2)]
    assert len(found) == 10
    assert builds.gradle_version("distributionUrl=https\\://x/gradle-8.5-bin.zip") == "8.5"


def test_gradle_trees(spark):
    tree = ["compileClasspath", "+--- a:b:1", "|    +--- c:d:2", "|    |    \\--- e:f:3 -> 4", "|    \\--- g:h:5", "\\--- i:j:6", "     \\--- k:l:7", "", "+--- m:n:8"]
    deep = ["|    " * k + "+--- g:n" + str(k) + ":1" for k in range(50)]
    skips = ["+--- g:a:1", "|    |    +--- g:b:1", "|    |    +--- g:c:1", "|    +--- g:d:1"]
    df = spark.createDataFrame([("t", "\n".join(tree)), ("deep", "\r\n".join(deep)), ("skips", "\n".join(skips)), ("none", None)], "file_uri string, text string")
    rows = gradle.edges(df).collect()
    by = {e["node_id"]: e for e in rows}
    up = lambda f: {e["artifact_id"]: by[e["parent_id"]]["artifact_id"] if e["parent_id"] else None for e in rows if e["pom_path"] == f}
    assert up("t") == {"b": None, "d": "b", "f": "d", "h": "b", "j": None, "l": "j", "n": None}
    assert up("deep") == {f"n{k}": f"n{k - 1}" if k else None for k in range(50)}
    assert up("skips") == {"a": None, "b": "a", "c": "a", "d": "a"}
    assert {e["artifact_id"]: e["ordinal"] for e in rows if e["pom_path"] == "t"} == {"b": 0, "d": 0, "f": 0, "h": 1, "j": 1, "l": 0, "n": 2}
    plan = gradle.edges(df)._jdf.queryExecution().toString() + gradle.declared(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_gradle_subprojects(spark):
    text = "Root project 'x'\n+--- Project ':app'\n|    \\--- Project ':app:core'\n\\--- Project ':lib' - text\n"
    found = gradle.subprojects(spark.createDataFrame([("p", text)], "file_uri string, text string")).orderBy("ordinal")
    assert [r["path"] for r in found.collect()] == [":app", ":app:core", ":lib"]


@pytest.mark.parametrize("text,want", [("g:a:jar:1", ("g", "a", "1", "jar", None)), ("g:a:jar:sources:1", ("g", "a", "1", "jar", "sources")), ("g:a", None), ("g:a:jar", ("g", "a", "", "jar", None))])
def test_coordinates(text, want):
    assert builds.parse_coordinates(text) == want


def test_maven_uri_and_paths():
    assert builds.parse_maven_uri("mvn://g.h:a:1:c@dir/x") == ("g.h", "a", "1", "c", "dir/x")
    assert builds.jar_path("/r", "g.h", "a", "1", "c") == "/r/g/h/a/1/a-1-c.jar"
    with pytest.raises(ValueError):
        builds.parse_maven_uri("mvn://g:a")


EDGES = [("1", None, 0, "org.springframework", "spring-core", "5.3.20"), ("2", None, 1, "javax.servlet", "javax.servlet-api", "4.0.1"), ("3", "1", 0, "org.springframework", "spring-jcl", "5.3.20"), ("4", "3", 0, "x", "leaf", "1.0-SNAPSHOT")]


def edges(spark):
    return spark.createDataFrame([(*e, None, None, "pom.xml") for e in EDGES], "node_id string, parent_id string, ordinal int, group_id string, artifact_id string, version string, classifier string, scope string, pom_path string")


def test_flatten_and_bases(spark):
    out = deps.resolved(edges(spark)).orderBy("path").collect()
    assert [r["artifact_id"] for r in out] == ["spring-core", "spring-jcl", "leaf", "javax.servlet-api"]
    assert [r["base_dep"] and r["base_dep"]["artifact_id"] for r in out] == [None, "spring-core", "spring-core", None]
    trees = [json.loads(r["json"]) for r in deps.nested(edges(spark)).orderBy("ordinal").collect()]
    assert trees[0]["children"][0]["children"][0]["artifact_id"] == "leaf" and len(trees) == 2
    assert deps.flatten(edges(spark).limit(0)).count() == 0


def test_tours(spark):
    """Pre-order, sizes and depths of random forests; deep chains take few rounds; rootless cycles are left out."""
    rnd = random.Random(4)
    rows = [(f"n{i}", f"n{rnd.randrange(i)}" if i > 3 and rnd.random() < 0.9 else None, rnd.randrange(5)) for i in range(300)]
    below = {}
    for n, p, o in rows:
        below.setdefault(p, []).append((o, n))
    want = []

    def go(node, root, depth, number):
        at, size = next(number), 1
        for _, c in sorted(below.get(node, [])):
            size += go(c, root, depth + 1, number)
        want.append((node, root, at, size, depth))
        return size

    for _, r in below[None]:
        go(r, r, 0, itertools.count())
    ddl = "node_id string, parent_id string, ordinal int"
    cycle = [("x", "y", 0), ("y", "x", 0), ("z", "y", 1)]
    got = forest.preorder(spark.createDataFrame(rows + cycle, ddl)).select("node_id", "root_id", "pre", "size", "depth")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    chain = spark.range(10_000).selectExpr("'c' || id AS node_id", "CASE WHEN id > 0 THEN 'c' || (id - 1) END AS parent_id", "0 AS ordinal")
    ranked, rounds = forest.ranked(forest._steps(chain))
    assert rounds < 20 and ranked.where("next IS NULL AND last = '>c0'").count() == 20_000
    assert forest.preorder(spark.createDataFrame([], ddl)).count() == 0


def test_shared_nodes_are_nested_once_for_each_parent(spark):
    rows = [("a", None, 0), ("b", None, 1), ("s", "a", 1), ("t", "a", 0), ("s", "b", 0), ("u", "s", 0)]
    df = spark.createDataFrame([(n, p, o, "g", n, None) for n, p, o in rows], "node_id string, parent_id string, ordinal int, group_id string, artifact_id string, version string")
    names_of = lambda t: (t["artifact_id"], [names_of(c) for c in t["children"]])
    assert [names_of(json.loads(r["json"])) for r in deps.nested(df).orderBy("ordinal").collect()] == [("a", [("t", []), ("s", [("u", [])])]), ("b", [("s", [("u", [])])])]


def symbol_rows(spark, rows):
    return spark.createDataFrame([(q, n, loc, k) for k, (q, n, loc) in enumerate(rows)], "qualified_name string, name string, location string, k int")


@pytest.mark.parametrize(
    ("glob", "location", "by_postings"),
    [("*Serv?ce*", "CLASS", True), ("a.*Bean", "CLASS", True), ("*(Red|Blue)Item*", "CLASS", True), ("*x*", "CLASS", False), ("(get|set)Name", "METHOD_CALL", True), ("*.List<T>", "CLASS", True), ("*(One|(Two|Three))*", "CLASS", False), ("*e(x)e*", "CLASS", True), ("*Name*", "TYPE", False)],
)
def test_postings_find_what_the_bucket_has(spark, tmp_path, glob, location, by_postings):
    names_ = ["a.b.MyServiceBean", "a.ServXceBean", "a.Bean", "b.RedItem", "b.BlueItems", "b.GreenItem", "a.List<T>", "a.List", "q.e(x)e", "z.One", "z.Two", "xx", "", "ünï.Service日本"]
    rows = [(q, q.rpartition(".")[2], loc) for q in names_ for loc in ("CLASS", "TYPE", "IMPORT")] + [("a.B.getName", "getName", "METHOD_CALL"), ("a.B.setNames", "setNames", "METHOD_CALL"), ("a.other", "setName", "METHOD_CALL"), ("a.B.getName", None, "METHOD_CALL"), (None, "getName", "METHOD_CALL"), ("a.B.getName", "getName", "METHOD_CALL")]
    df = symbol_rows(spark, rows)
    index = postings.build(df, str(tmp_path / "index"))
    assert (postings.candidates(index.postings, glob, L[location]) is not None) == by_postings
    plain, found = symbols.query(df, glob, L[location]), postings.search(index, glob, L[location])
    known = lambda x: sorted(map(repr, (tuple(r) for r in x.select("qualified_name", "name", "location", "k").where("qualified_name IS NOT NULL").collect())))
    assert known(found) == known(plain)


def test_postings_are_read_by_piece_and_shard(spark, tmp_path):
    df = symbol_rows(spark, [(f"com.p{k}.Name{k}", f"Name{k}", "CLASS") for k in range(500)])
    found = postings.search(postings.build(df, str(tmp_path / "index")), "*Name123*", L.CLASS)
    assert [r["k"] for r in found.collect()] == [123]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "dynamicpruning" in plan.lower()


def test_many_conditions_at_once(spark):
    """Like one condition at a time."""
    rnd = random.Random(2)
    names_ = ["a.x", "a.y", "b.z"]
    versions_ = ["1", "1.0", "1.0.1", "2-alpha", "2-rc1", "2", "2.1", "10", "", None]
    rows = spark.createDataFrame([(k, *rnd.choice(names_).split("."), rnd.choice(versions_)) for k in range(200)], "k int, group_id string, artifact_id string, version string").persist()
    asked = []
    for k in range(60):
        name, regex = rnd.choice([("a.x", None), (None, "a[.].*"), (None, None), ("none", "a.*")])
        asked.append(conditions.Condition(f"c{k}", name, regex, rnd.choice([None, *versions_[:8]]), rnd.choice([None, *versions_[:8]])))
    got = {(r["cond_id"], r["k"]) for r in conditions.match(rows, asked, chunk=2).collect()}
    want = {(c.cond_id, r["k"]) for c in asked for r in deps.select(rows, c.name, c.name_regex, c.lower, c.upper).collect()}
    assert got == want and conditions.match(rows, asked).count() == len(want)
    assert conditions.match(rows, []).count() == 0
    assert conditions.match(rows, [conditions.Condition("all")]).count() == 200


@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 6))
def test_nodes_cover_a_run_of_leaves(a, b, level):
    size = 1 << level
    covered = [leaf for leaf in range(size) if sum((leaf + size) >> k in conditions.nodes(a % size, b % size, size) for k in range(level + 1))]
    assert covered == list(range(a % size, b % size + 1))


def test_gradle_lines(spark):
    text = "x\napi 'my-org.x:lib:1'\napi 'org.x:library'\na:b:c d:e\n:\n"
    wanted = [("org.x", "lib"), ("org.x", "library"), ("b", "c d"), ("a:b", "c"), ("", ""), ("e", "x"), ("d", "e"), ("x", "lib")]
    df = spark.createDataFrame([("f", g, a) for g, a in wanted] + [("none", "a", "b")], "file_uri string, group_id string, artifact_id string")
    out = deps.locate_in_gradle(df, spark.createDataFrame([("f", text)], "file_uri string, text string")).collect()
    lines = text.split("\n")
    assert {(r["file_uri"], r["group_id"], r["artifact_id"], r["line"]) for r in out} == {("f", g, a, next((i + 1 for i, x in enumerate(lines) if f"{g}:{a}" in x), 0)) for g, a in wanted} | {("none", "a", "b", 0)}


def test_files_are_listed_in_chunks(spark):
    rows = spark.range(25).selectExpr("'f' AS file_uri", "CAST(id AS INT) AS ordinal", "'g' AS group_id", "'a' || id AS artifact_id", "'1' AS version", "'' AS classifier", "'' AS scope")
    out = deps.by_file(rows, 10).orderBy("chunk").collect()
    assert [r["n"] for r in out] == [10, 10, 5] and [d["artifact_id"] for r in out for d in r["dependencies"]] == [f"a{i}" for i in range(25)]


def test_wide_and_cyclic_graphs(spark):
    rows = spark.range(1_200_000).selectExpr("CAST(id AS STRING) AS node_id", "CASE WHEN id > 0 THEN '0' END AS parent_id", "CAST(id AS INT) AS ordinal")
    out = deps.flatten(rows)
    assert out.count() == 1_200_000 and out.where("depth = 1 AND root_id = '0'").count() == 1_199_999
    cycle = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("b", "c", 0)], "node_id string, parent_id string, ordinal int")
    with pytest.raises(ValueError, match="cycle"):
        deps.flatten(cycle)
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None, 0) for i in range(12)], "node_id string, parent_id string, ordinal int")
    assert deps.flatten(deep).agg({"depth": "max"}).first()[0] == 11


MANAGED = """<project><groupId>own</groupId><artifactId>top</artifactId><version>1</version><modules><module>web</module></modules>
<properties><v>5.3.20</v></properties>
<dependencyManagement><dependencies><dependency><groupId>org.managed</groupId><artifactId>lib</artifactId><version>2.5</version></dependency></dependencies></dependencyManagement>
<dependencies>
<dependency>
<groupId>org.springframework</groupId>
<artifactId>spring-core</artifactId>
<version>${v}</version>
</dependency>
<dependency>
<groupId>org.managed</groupId>
<artifactId>lib</artifactId>
</dependency>
<dependency><groupId>no</groupId><artifactId>version</artifactId></dependency>
</dependencies></project>"""


def names(found):
    return {(r["name"], r["version"], r["line_number"]) for r in found.collect()}


def test_maven_project_without_a_graph(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "pom.xml").write_text(MANAGED)
    (tmp_path / "web/pom.xml").write_text("<project><parent><groupId>own</groupId><artifactId>top</artifactId><version>1</version></parent><artifactId>web</artifactId><dependencies><dependency><groupId>javax.servlet</groupId><artifactId>api</artifactId><version>${v}</version></dependency></dependencies></project>")
    engine = Engine(spark)
    ident = engine.init(Config(str(tmp_path)))
    ask = lambda text: engine.evaluate(ident, "dependency", f"dependency: {text}")
    assert names(ask("{name_regex: '.*'}")) == {("org.springframework.spring-core", "5.3.20", 6), ("org.managed.lib", "2.5", 11), ("javax.servlet.api", "5.3.20", 0), ("no.version", "", 0)}
    assert names(ask("{name: org.springframework.spring-core, lowerbound: 5.0.0}")) == {("org.springframework.spring-core", "5.3.20", 6)}
    assert ask("{name: org.springframework.spring-core, lowerbound: 6.0}").count() == 0
    many = engine.workspace(ident).evaluate_dependencies({"a": "dependency: {name: org.managed.lib, upperbound: 3}", "b": "dependency: {name_regex: 'org[.].*', lowerbound: 5}", "c": "referenced: {pattern: x}"})
    assert sorted((r["cond_id"], r["artifact_id"]) for r in many.collect()) == [("a", "lib"), ("b", "spring-core")]
    assert engine.workspace(ident).matched("dependency", "dependency: {name: org.managed.lib}") and not engine.workspace(ident).matched("dependency", "dependency: {name: x}")
    wanted = spark.createDataFrame([(engine.workspace(ident).build_file, "org.managed", "lib"), ("file:///none", "a", "b")], "file_uri string, group_id string, artifact_id string")
    assert sorted(r["line"] for r in engine.workspace(ident).dependency_locations(wanted).collect()) == [0, 11]
    engine.stop(ident)


def test_jars_of_a_local_repository(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app/pom.xml").write_text("<project><dependencies>" + "".join(f"<dependency><groupId>g.h</groupId><artifactId>{a}</artifactId><version>1</version></dependency>" for a in "abc") + "</dependencies></project>")
    for name, entries in {"a": {"a-1.jar": {"x.txt": "1"}, "a-1-sources.jar": {"g/A.java": "package g; class A extends Top { }"}}, "b": {"b-1.jar": {"no.class": "junk"}}}.items():
        place = tmp_path / "repo/g/h" / name / "1"
        place.mkdir(parents=True)
        for jar, inner in entries.items():
            (place / jar).write_bytes(zipped(inner))
    engine = Engine(spark)
    own = engine.workspace(engine.init(Config(str(tmp_path / "app"), maven_repository=str(tmp_path / "repo"))))
    jars = {r["artifact_id"]: (r["jar_path"] and r["jar_path"].rpartition("/")[2], r["has_source_jar"]) for r in own.resolved.collect()}
    assert jars == {"a": ("a-1.jar", True), "b": ("b-1.jar", False), "c": (None, False)}
    assert own.symbols.where("is_dependency AND location = 'INHERITANCE'").count() == 1


def test_gradle_project_with_and_without_trees(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app/build.gradle").write_text("plugins { }\ndependencies {\n  implementation 'a:b:1.5'\n}\n")
    engine = Engine(spark)
    plain = engine.init(Config(str(tmp_path / "app")))
    assert names(engine.evaluate(plain, "dependency", "dependency: {name: a.b, lowerbound: 1.0}")) == {("a.b", "1.5", 3)}
    (tmp_path / "trees").mkdir()
    (tmp_path / "trees/app.txt").write_text("compileClasspath\n+--- a:b:1.5\n|    \\--- c:d:2.0\n\\--- e:f:3.0\n")
    full = engine.init(Config(str(tmp_path / "app"), gradle_trees=str(tmp_path / "trees")))
    assert names(engine.evaluate(full, "dependency", "dependency: {name_regex: '.*'}")) == {("a.b", "1.5", 3), ("c.d", "2.0", 3), ("e.f", "3.0", 0)}
    assert engine.workspace(full).dependency_dag()[0]["children"][0]["artifact_id"] == "d"


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    for name, text in [("src/Bean.java", BEAN), ("src/Service.java", SERVICE), ("target/Skip.java", BEAN), ("pom.xml", POM)]:
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    lib = tmp_path_factory.mktemp("lib")
    (lib / "Dep.java").write_text("package d; import javax.ejb.Singleton; class Dep { }")
    engine = Engine(spark)
    ident = engine.init(Config(str(root), dependency_roots=(str(lib),)), edges(spark))
    return engine, ident


def evaluate(workspace, capability, text):
    engine, ident = workspace
    return engine.evaluate(ident, capability, text).collect()


@pytest.mark.parametrize(
    "cond,n",
    [("name: org.springframework.spring-core", 1), ("name: no.such", 0), ("name_regex: 'javax\\..*'", 1), ("{name: org.springframework.spring-core, lowerbound: 5.0.0}", 1), ("{name: org.springframework.spring-core, lowerbound: 6.0}", 0), ("{name: org.springframework.spring-core, upperbound: 6.0}", 1), ("{name: org.springframework.spring-core, upperbound: 4.0.0}", 0), ("{name: org.springframework.spring-core, lowerbound: 5.0, upperbound: 6.0}", 1), ("{name: org.springframework.spring-core, name_regex: none}", 1)],
)
def test_dependency_conditions(workspace, cond, n):
    assert len(evaluate(workspace, "dependency", f"dependency: {cond}" if cond[0] == "{" else f"dependency:\n  {cond}")) == n


def test_dependency_lines(workspace):
    line = {r["artifact_id"]: r["line_number"] for r in evaluate(workspace, "dependency", "dependency: {name_regex: '.*'}")}
    assert line == {"spring-core": 5, "javax.servlet-api": 10, "spring-jcl": 5, "leaf": 5}


def test_workspace(workspace):
    engine, ident = workspace
    found = evaluate(workspace, "referenced", "referenced:\n  pattern: javax.ejb.Singleton\n  location: IMPORT\n")
    assert len(found) == 1 and found[0]["file_uri"].startswith("file:///") and found[0]["line_number"] == 3
    assert evaluate(workspace, "referenced", "other: 1") == [] and evaluate(workspace, "unknown", "x: 1") == []
    own = engine.workspace(ident)
    assert own.symbols.where("is_dependency").count() > 0
    snip = own.snippets(engine.evaluate(ident, "referenced", "referenced: {pattern: javax.ejb.Singleton, location: ANNOTATION}"), 1).first()["code_snip"]
    assert snip == "\n6  \n7  @Singleton\n8  public class Bean implements SessionBean {"
    listed = {r["artifact_id"]: (r["indirect"], r["labels"][-1]) for r in own.dependencies().collect()}
    assert listed["leaf"] == (True, "dependency/dep-source=open-source")
    assert engine.capabilities() == ["referenced", "dependency"]
    with pytest.raises(ConditionError):
        parse_referenced("referenced: {location: TYPE}")
    assert parse_dependency("dependency: {lowerbound: 5.0}").lower == "5.0"
    with pytest.raises(LookupError):
        engine.evaluate(99, "referenced", "x")
    other = engine.init(Config(own.config.location))
    assert engine.workspace(other).dependencies().count() == 2
    engine.stop(other)
    with pytest.raises(LookupError):
        engine.evaluate(other, "referenced", "referenced: {pattern: x}")


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    jar = zipped({"META-INF/maven/g/a/pom.properties": "groupId=g\nartifactId=a\nversion=2\n", "a/Dep.java": "package a; class Dep extends Top { }"})
    war = zipped({"WEB-INF/lib/a.jar": jar, "WEB-INF/classes/app/App.java": BEAN, "index.html": "<p>", "../evil.txt": "x"})
    (tmp_path / "app.war").write_bytes(war)
    (tmp_path / "named-1.0.jar").write_bytes(zipped({"x.txt": "1"}))
    (tmp_path / "known.jar").write_bytes(b"hello")
    got = {(r["entry"], r["depth"]) for r in archives.read_entries(spark, str(tmp_path)).collect()}
    assert ("a/Dep.java", 1) in got and not any("evil" in e for e, _ in got)
    (tmp_path / "index.txt").write_text("aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d org.k:known:jar:7\n")
    found = deps.identify(archives.archive_facts(spark, str(tmp_path)), builds.artifact_index(spark, str(tmp_path / "index.txt"))).collect()
    assert {r["path"].rpartition("/")[2]: (r["artifact_id"], r["version"], r["identified_by"]) for r in found} == {"app.war": ("app", "0.0.0-SNAPSHOT", "name"), "named-1.0.jar": ("named-1.0", "0.0.0-SNAPSHOT", "name"), "known.jar": ("known", "7", "sha1")}
    engine = Engine(spark)
    (tmp_path / "sha.txt").write_text(f"{hashlib.sha1(jar).hexdigest()} org.indexed:lib:jar:9\n")
    by_index = engine.init(Config(str(tmp_path / "app.war"), index_path=str(tmp_path / "sha.txt")))
    assert names(engine.evaluate(by_index, "dependency", "dependency: {name_regex: '.*'}")) == {("org.indexed.lib", "9", 0)}
    assert "<artifactId>lib</artifactId>" in engine.workspace(by_index).synthetic_pom()
    places = {r["entry"]: r["place"] for r in engine.workspace(by_index).exploded().where("depth = 0").collect()}
    assert places == {"WEB-INF/lib/a.jar": None, "WEB-INF/classes/app/App.java": "src/main/java/app/App.java", "index.html": "src/main/webapp/index.html"}
    own = engine.init(Config(str(tmp_path / "app.war")))
    assert names(engine.evaluate(own, "dependency", "dependency: {name: g.a, upperbound: 2}")) == {("g.a", "2", 0)}
    (tmp_path / "repo/x/y/z/1").mkdir(parents=True)
    (tmp_path / "repo/x/y/z/1/z-1.jar").write_bytes(jar)
    remote = engine.init(Config("mvn://x.y:z:1", maven_repository=str(tmp_path / "repo")))
    assert engine.workspace(remote).symbols.where("location = 'INHERITANCE'").count() == 1
    with pytest.raises(LookupError):
        engine.init(Config("mvn://x.y:none:1", maven_repository=str(tmp_path / "repo")))
    ident = engine.init(Config(str(tmp_path / "app.war")))
    assert engine.evaluate(ident, "referenced", "referenced: {pattern: javax.ejb.Singleton, location: IMPORT}").count() == 1
    assert engine.workspace(ident).symbols.where("is_dependency AND location = 'INHERITANCE'").count() == 1
    engine.stop(ident)
    assert archives.route("WEB-INF/lib/a.jar") == "dependency" and archives.route("WEB-INF/web.xml") == "src/main/webapp/WEB-INF/web.xml" and archives.route("conf.txt") == "src/main/resources/conf.txt"


def test_class_files(spark, tmp_path):
    import pathlib

    import pyspark

    jar = next(pathlib.Path(pyspark.__file__).parent.glob("jars/jackson-annotations-*.jar"))
    with zipfile.ZipFile(jar) as z:
        rows = archives.read_class(z.read("com/fasterxml/jackson/annotation/JsonProperty.class"))
    found = {(r["location"], r["qualified_name"]) for r in rows}
    own = "com.fasterxml.jackson.annotation.JsonProperty"
    assert {("PACKAGE", own.rpartition(".")[0]), ("CLASS", own), ("TYPE", own), ("INHERITANCE", "java.lang.annotation.Annotation"), ("METHOD", f"{own}.value"), ("RETURN_TYPE", "java.lang.String"), ("ANNOTATION", "java.lang.annotation.Retention"), ("ANNOTATION", "java.lang.annotation.Target")} <= found
    marks = {a["qualified_name"]: dict(a["elements"]) for r in rows if r["location"] == "CLASS" for a in r["annotations"]}
    assert marks["java.lang.annotation.Retention"] == {"value": "RetentionPolicy.RUNTIME"} and marks["java.lang.annotation.Target"]["value"].startswith("ElementType.")
    with pytest.raises(ValueError):
        archives.read_class(b"no class")
    (tmp_path / "lib.jar").write_bytes(jar.read_bytes())
    engine = Engine(spark)
    ident = engine.init(Config(str(tmp_path / "lib.jar")))
    ask = lambda text: engine.evaluate(ident, "referenced", f"referenced: {text}")
    assert ask("{pattern: java.lang.annotation.Retention, location: ANNOTATION}").count() > 30
    both = ask("{pattern: com.fasterxml.jackson.annotation.JsonProperty, location: CLASS, annotated: {pattern: 'java.lang.annotation.Ret*', elements: [{name: value, value: '.*RUNTIME'}]}}")
    assert both.count() == 1
    engine.stop(ident)


def test_labels(spark):
    rows = spark.createDataFrame([("com.acme", "x"), ("org.apache", "y")], "group_id string, artifact_id string")
    got = {r["group_id"]: r["labels"] for r in deps.labels(rows, ["org[.]apache:.*"], ["com."]).collect()}
    assert got["com.acme"][1:] == ["dependency/exclude=true", "dependency/dep-source=internal"] and got["org.apache"][1:] == ["dependency/dep-source=open-source"]
    assert builds.label_patterns("# c\n\n a.* \n") == ["a.*"]


def test_scan_errors_are_listed(spark):
    files = spark.createDataFrame([("f", "class A { void m( { }"), ("g", None)], "file_uri string, text string")
    assert {r["file_uri"] for r in scan.parse_errors(files).collect()} == {"f"}


def test_changes(spark, tmp_path):
    from symlake.streaming import changes

    table, feed = str(tmp_path / "t"), tmp_path / "feed"
    schema = "file_uri string, text string, saved int"
    first = spark.createDataFrame([("a", "class A { }", 1), ("b", "class B { }", 1), ("a", "class A2 { }", 2)], schema)
    first.coalesce(1).write.json(str(feed))
    for _ in range(2):
        q = changes.follow(spark.readStream.schema(schema).json(str(feed)), table, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        spark.createDataFrame([("b", None, 3), ("c", "class C { }", 3)], schema).coalesce(1).write.mode("append").json(str(feed))
    q = changes.follow(spark.readStream.schema(schema).json(str(feed)), table, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    names = {r["name"] for r in changes.read(spark, table).where("location = 'CLASS'").collect()}
    assert names == {"A2", "C"}
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) <= 3
    assert changes.read(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_that_fails_leaves_the_state(spark, tmp_path, monkeypatch):
    from symlake.streaming import changes

    table, schema = str(tmp_path / "t"), "file_uri string, text string, saved int"
    changes.apply(spark.createDataFrame([("a", "class A { }", 1), ("b", "class B { }", 1)], schema), table)
    monkeypatch.setattr(changes, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        changes.apply(spark.createDataFrame([("a", None, 2), ("b", "class C { }", 2)], schema), table)
    assert {r["name"] for r in changes.read(spark, table).where("location = 'CLASS'").collect()} == {"A", "B"}


def joins_of(plan):
    return set(re.findall(r"\w*(?:Join|BroadcastExchange|Window)\b", plan))


def test_locations_are_dealt_by_key(spark):
    files = spark.createDataFrame([("a/pom.xml", "<dependencies>\n<artifactId>a</artifactId>\n<groupId>g</groupId>\n<artifactId>b</artifactId>"), ("build.gradle", "x 'g:a:1'\ny 'gg:ab:1'")], "file_uri string, text string")
    wanted = spark.createDataFrame([("a/pom.xml", "g", "a"), ("a/pom.xml", "g", "b"), ("a/pom.xml", "g", "c"), ("build.gradle", "g", "ab"), ("build.gradle", "gg", "a"), ("build.gradle", "g", "b"), ("c", "g", "a"), ("build.gradle", None, "a")], "file_uri string, group_id string, artifact_id string")
    out = deps.locate(wanted, files)
    assert [r["line"] for r in out.orderBy(F.desc("file_uri"), "group_id", "artifact_id").collect()] == [0, 0, 2, 0, 2, 2, 3, 0]
    assert joins_of(out._jdf.queryExecution().executedPlan().toString()) == {"SortMergeJoin"}


def test_gradle_lines_with_few_and_many_wanted(spark, monkeypatch):
    names = [f"a{k:03d}" for k in range(100)]
    files = spark.createDataFrame([("build.gradle", "\n".join(f"  api 'g:{a}:1'" for a in names))], "file_uri string, text string")
    wanted = spark.createDataFrame([("build.gradle", "g", a) for a in [*names, "b000"]], "file_uri string, group_id string, artifact_id string")
    for few in (64, 200):
        monkeypatch.setattr(deps, "FEW", few)
        assert {r["artifact_id"]: r["line"] for r in deps.locate(wanted, files).collect()} == {a: k for k, a in enumerate(names, 1)} | {"b000": 0}


def test_maven_joins_are_dealt_by_key(spark, monkeypatch):
    """Tables of poms are a small part of their rows' memory, so sizes of files must not decide what is broadcast."""
    from symlake.plans import build_catalog

    plans, write = [], maven.materialize
    monkeypatch.setattr(maven, "materialize", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a))[1])
    build_catalog.maven_managed(spark, DATA)
    build_catalog.maven_resolved(spark, DATA)
    found = set().union(*map(joins_of, plans))
    assert len(plans) > 20 and "SortMergeJoin" in found and not any("Broadcast" in x for x in found)


@pytest.fixture(scope="module")
def one_brand(spark, tmp_path_factory):
    """1,200 parts of one brand and 2,500 documents of one source."""
    d = str(tmp_path_factory.mktemp("one"))
    spark.range(1200).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(3).alias("p_size")).write.parquet(f"{d}/part.parquet")
    spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 700 != 0, "en").alias("lang")).write.parquet(f"{d}/documents.parquet")
    return d


def test_lines_of_a_whole_brand_in_one_pom(spark, one_brand):
    lines = {r["dep_id"]: r["line"] for r in catalog.dep_line_lookup(spark, one_brand).collect()}
    assert lines == {k: 0 if k % 3 == 0 else 4 * (k + 1) for k in range(1200)}


def test_fallback_reads_a_whole_brands_pom(spark, one_brand):
    lines = {r["artifact_id"]: r["line_number"] for r in catalog.dep_line_fallback(spark, one_brand).collect()}
    assert lines == {f"part-{k}": 0 if k % 3 == 0 else 4 * (k + 1) for k in range(1200)}


def test_a_files_dependencies_are_one_row(spark, one_brand):
    rows = catalog.deps_grouped_by_file(spark, one_brand).collect()
    listed = hashlib.md5(",".join(f"{k}en" for k in range(2500) if k % 700).encode()).hexdigest()
    assert [tuple(r) for r in rows] == [("s", 2500, listed)]


def test_a_whole_brand_is_declared_in_one_pom(spark, one_brand):
    rows = catalog.declared_dependencies(spark, one_brand).collect()
    assert {r["file_uri"] for r in rows} == {"file:///brand11/pom.xml"} and sorted(r["artifact_id"] for r in rows) == sorted(f"part {k}" for k in range(1200))
