"""JAR, WAR and EAR files as rows of entries.

Class files are read as far as their constant pool and tables go (names, supertypes, interfaces, members, annotations with
their elements, and the classes and methods that they refer to); bodies are not turned back into source.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from symlake.model import SYMBOLS
from symlake.sources import zip_source
from symlake.sources.builds import read_properties
from symlake.sources.scan import file_uri
from symlake.sources.zip_source import safe_entry

ENTRIES = "archive string, entry string, depth int, content binary"
NESTING = 3
WEB = (".html", ".htm", ".css", ".js", ".jsp", ".jspx", ".xhtml", ".png", ".gif", ".jpg", ".svg", ".ico")


def is_archive(path: Column) -> Column:
    return F.lower(path).rlike("[.](jar|war|ear)$")


def entries(data: bytes, path: str = "", depth: int = 0) -> Iterator[tuple[str, str, int, bytes]]:
    """(archive, entry, depth, bytes) of all safe file entries; nested archives come as entries and then opened."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if info.is_dir() or not safe_entry(info.filename):
                    continue
                try:
                    content = z.read(info)
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
                    continue
                yield path, info.filename, depth, content
                if depth < NESTING and info.filename.lower().endswith((".jar", ".war", ".ear")):
                    yield from entries(content, f"{path}!/{info.filename}", depth + 1)
    except zipfile.BadZipFile:
        return


def route(entry: str) -> str:
    """Where an entry goes in a Maven-style project."""
    name = entry.removeprefix("WEB-INF/classes/")
    if name.endswith((".class", ".java")):
        return "src/main/java/" + name
    if entry.startswith("META-INF/maven/") and entry.endswith("/pom.xml"):
        return "pom.xml"
    if entry.startswith("WEB-INF/lib/") or entry.lower().endswith((".jar", ".war", ".ear")):
        return "dependency"
    if entry.startswith("WEB-INF/") and name == entry or entry.lower().endswith(WEB):
        return "src/main/webapp/" + entry
    return "src/main/resources/" + name


def exploded(archive_entries: DataFrame) -> DataFrame:
    """Entries with the place that each has in a Maven-style project (place), null for archives, which are dependencies."""
    names = [*[x.split()[0] for x in ENTRIES.split(", ")], "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [p if (p := route(e)) != "dependency" else None for e in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.string())], names)

    return archive_entries.select(*names[:-1]).mapInArrow(run, ENTRIES + ", place string")


def read_entries(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """All entries of all archives below a root or of listed ones, nested ones too.

    Large archives are read by several tasks (``zip_source``), those in a store that only Spark reads by one each.
    """
    names, types = ["archive", "entry", "depth", "content"], [pa.string(), pa.string(), pa.int32(), pa.binary()]
    one = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            for path, entry, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if entry.lower().endswith((".jar", ".war", ".ear")):
                    yield from map(one, entries(content.as_buffer().to_pybytes(), f"{path}!/{entry}", 1))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from map(one, entries(content.as_buffer().to_pybytes(), path))

    paths = [root] if isinstance(root, str) else root
    if all(map(zip_source.readable, paths)):
        return zip_source.scan(spark, paths).mapInArrow(inner, ENTRIES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_archive(F.col("path")))
    return files.select(file_uri(F.col("path")).alias("path"), "content").mapInArrow(whole, ENTRIES)


PROPERTIES = pa.struct([("group_id", pa.string()), ("artifact_id", pa.string()), ("version", pa.string())])


def own_properties(data: bytes) -> dict[str, str] | None:
    """The coordinates that an archive's first pom.properties tells."""
    for _, name, _, content in entries(data, depth=NESTING):
        if name.startswith("META-INF/maven/") and name.endswith("/pom.properties"):
            p = read_properties(content.decode("latin-1"))
            if "groupId" in p and "artifactId" in p:
                return {"group_id": p["groupId"], "artifact_id": p["artifactId"], "version": p.get("version", "0.0.0")}
    return None


def archive_facts(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha1, properties struct or null) of the archives below a root, for ``deps.identify``."""
    fields = "path string, sha1 string, properties struct<group_id:string,artifact_id:string,version:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own_properties(content.as_buffer().to_pybytes()) for content in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, PROPERTIES)], ["path", "sha1", "properties"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_archive(F.col("path")))
    return files.select(file_uri(F.col("path")).alias("path"), F.sha1("content").alias("sha1"), "content").mapInArrow(run, fields)


def nested_facts(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha1, properties) as ``archive_facts`` has them, of the archives inside those below a root."""
    inner = read_entries(spark, root).where(is_archive(F.col("entry")))
    fields = "path string, sha1 string, properties struct<group_id:string,artifact_id:string,version:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own_properties(content.as_buffer().to_pybytes()) for content in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, PROPERTIES)], ["path", "sha1", "properties"])

    return inner.select(F.concat_ws("!/", "archive", "entry").alias("path"), F.sha1("content").alias("sha1"), "content").mapInArrow(run, fields)


_WIDTH = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


def _descriptor(text: str) -> list[str]:
    """The type names of a descriptor, in order."""
    out, i = [], 0
    names = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
    while i < len(text):
        dims = 0
        while text[i] == "[":
            dims, i = dims + 1, i + 1
        if text[i] == "L":
            end = text.index(";", i)
            name, i = text[i + 1 : end].replace("/", ".").replace("$", "."), end + 1
        elif text[i] in names:
            name, i = names[text[i]], i + 1
        else:
            i += 1
            continue
        out.append(name + "[]" * dims)
    return out


_NUMBERS = {3: ">i", 4: ">f", 5: ">q", 6: ">d"}
#: Attributes that hold annotations (fixed values).
_ANNOTATED = ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations")


class _Marks:
    """Reads the annotations of an attribute: (qualified name, elements as text, of arrays the first)."""

    def __init__(self, data: bytes, at: int, pool: dict[int, tuple]) -> None:
        self.data, self.at, self.pool = data, at, pool

    def number(self) -> int:
        self.at += 2
        return struct.unpack_from(">H", self.data, self.at - 2)[0]

    def all(self) -> list[dict]:
        return [self.one() for _ in range(self.number())]

    def one(self) -> dict:
        name = _descriptor(self.pool[self.number()][1])[0]
        return {"qualified_name": name, "elements": {self.pool[self.number()][1]: self.value() for _ in range(self.number())}}

    def value(self) -> str:
        tag = chr(self.data[self.at])
        self.at += 1
        if tag == "[":
            found = [self.value() for _ in range(self.number())]
            return found[0] if found else ""
        if tag == "@":
            return "@" + self.one()["qualified_name"].rpartition(".")[2]
        if tag == "e":
            kind = _descriptor(self.pool[self.number()][1])[0]
            return f"{kind.rpartition('.')[2]}.{self.pool[self.number()][1]}"
        constant = self.pool[self.number()][1]
        if tag == "c":
            return _descriptor(constant)[0].rpartition(".")[2] + ".class"
        return {"Z": lambda: str(bool(constant)).lower(), "C": lambda: chr(constant)}.get(tag, lambda: str(constant))()


def _attributes(data: bytes, at: int, pool: dict[int, tuple]) -> tuple[int, list[dict]]:
    """The end of a table of attributes, and the annotations in it."""
    n, at, marks = struct.unpack_from(">H", data, at)[0], at + 2, []
    for _ in range(n):
        name, size = struct.unpack_from(">HI", data, at)
        if pool[name][1] in _ANNOTATED:
            marks += _Marks(data, at + 6, pool).all()
        at += 6 + size
    return at, marks


def read_class(data: bytes) -> list[dict]:
    """Symbol rows of a class file: the type, its supertypes, fields, methods, and the methods and classes it uses."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("not a class file")
    count, at = struct.unpack_from(">H", data, 8)[0], 10
    pool: dict[int, tuple] = {}
    k = 1
    while k < count:
        tag = data[at]
        if tag == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            pool[k] = (1, data[at + 3 : at + 3 + size].decode("utf-8", "replace"))
            at += 3 + size
        else:
            width = _WIDTH[tag]
            form = _NUMBERS.get(tag) or {4: ">HH", 2: ">H"}.get(width)
            pool[k] = (tag, *(struct.unpack_from(form, data, at + 1) if form else ()))
            at += 1 + width
            k += tag in (5, 6)
        k += 1
    name_of = lambda i: pool[pool[i][1]][1].replace("/", ".").replace("$", ".") if i else ""
    access, this, parent, n = struct.unpack_from(">HHHH", data, at)
    interfaces = struct.unpack_from(f">{n}H", data, at + 8)
    at += 8 + 2 * n
    own = name_of(this)
    simple, package = own.rpartition(".")[2], pool[pool[this][1]][1].rpartition("/")[0].replace("/", ".")
    rows: list[dict] = []


    def add(q: str, name: str, kind: str, location: str, marks: list[dict] | None = None) -> None:
        found = [{**m, "elements": list(m["elements"].items())} for m in marks or []]
        rows.append({"qualified_name": q, "name": name, "kind": kind, "location": location, "package_name": package, "line": 0, "start_char": 0, "end_line": 0, "end_char": 0, "annotations": found})

    def used(marks: list[dict]) -> None:
        for m in marks:
            add(m["qualified_name"], m["qualified_name"].rpartition(".")[2], "Property", "ANNOTATION", marks)

    if package:
        add(package, package, "Module", "PACKAGE")
    members = []
    for table in ("field", "method"):
        n, at = struct.unpack_from(">H", data, at)[0], at + 2
        for _ in range(n):
            flags, name, descriptor = struct.unpack_from(">HHH", data, at)
            at, marks = _attributes(data, at + 6, pool)
            if not flags & 0x1000:
                members.append((table, pool[name][1], _descriptor(pool[descriptor][1]), marks))
    marks = _attributes(data, at, pool)[1]
    kind = "Enum" if access & 0x4000 else "Class"
    add(own, simple, kind, "CLASS", marks)
    if kind == "Class":
        add(own, simple, kind, "TYPE", marks)
    used(marks)
    if parent and name_of(parent) not in ("java.lang.Object", "java.lang.Enum"):
        add(name_of(parent), simple, "Class", "INHERITANCE")
    for i in interfaces:
        add(name_of(i), simple, "Class", "INHERITANCE" if access & 0x0200 else "IMPLEMENTS_TYPE")
    for table, label, types, marks in members:
        if table == "field":
            add(types[0], label, "Field", "FIELD", marks)
            add(types[0], label, "Field", "TYPE")
        elif label != "<clinit>":
            shown = simple if label == "<init>" else label
            add(f"{own}.{shown}", shown, "Method", "METHOD", marks)
            if types[:-1]:
                add(f"{own}.{shown}({','.join(t.rpartition('.')[2] for t in types[:-1])})", shown, "Method", "METHOD", marks)
            if label != "<init>":
                add(types[-1], shown, "Method", "RETURN_TYPE")
            for t in types[:-1]:
                add(t, shown, "Method", "TYPE")
        used(marks)
    for entry in [e for e in pool.values() if e[0] in (10, 11)]:
        owner, called = name_of(entry[1]), pool[pool[entry[2]][1]][1]
        if called == "<init>":
            add(owner, owner.rpartition(".")[2], "Class", "CONSTRUCTOR_CALL")
        else:
            add(f"{owner}.{called}", simple, "Method", "METHOD_CALL")
    return rows


def class_symbols(archive_entries: DataFrame, is_dependency: bool = False) -> DataFrame:
    """``model.SYMBOLS`` rows of the class files among entries; unreadable ones give none."""
    schema = to_arrow_schema(SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = read_class(content.as_buffer().to_pybytes())
                except (ValueError, KeyError, IndexError, struct.error):
                    rows = []
                out += [{**r, "file_uri": uri, "is_dependency": is_dependency, "seq": k} for k, r in enumerate(rows)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    classes = archive_entries.where(F.col("entry").endswith(".class") & ~F.col("entry").rlike("(module|package)-info[.]class$"))
    return classes.select(F.concat_ws("!/", "archive", "entry").alias("file_uri"), "content").mapInArrow(run, SYMBOLS)


def java_files(archive_entries: DataFrame) -> DataFrame:
    """(file_uri, text) of the Java sources among entries."""
    return archive_entries.where(F.col("entry").endswith(".java")).select(F.concat_ws("!/", "archive", "entry").alias("file_uri"), F.decode("content", "UTF-8").alias("text"))
