"""Gradle scripts and printed trees as relations, read with built-in functions and windows over one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.model import DECLARED, EDGES

#: Gradle configurations whose dependencies are read (fixed values).
CONFIGURATIONS = ["implementation", "api", "compile", "runtime", "testImplementation", "testCompile", "testRuntime", "classpath", "compileOnly", "runtimeOnly"]
#: Characters that an indent has for each level of a printed tree.
INDENT = 5
#: A script's tokens as far as they matter: comments, strings, words, braces and parentheses, line ends. Loops are possessive, so that
#: long tokens need no deep stack.
_TOKENS = "|".join(
    [
        r"//[^\n]*+",
        r"/\*(?s:.*?)(?:\*/|\z)",
        r"'''(?s:.*?)'''",
        r'"""(?s:.*?)"""',
        r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
        r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
        r"[A-Za-z_$][\w$.-]*+",
        r"[{}()]",
        r"\n",
    ]
)
_TREE = r"^((?:[|+\\ -])*?)(?:[+\\]--- )([^:\s]+):([^:\s]+):([^\s]+)"


def tokens(files: DataFrame) -> DataFrame:
    """(file_uri, pos, kind, text, line) of scripts (file_uri, text): strings without quotes, words and marks with 0-based lines."""
    raw = files.select("file_uri", F.posexplode(F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0))).alias("pos", "t"))
    t = F.col("t")
    order = Window.partitionBy("file_uri").orderBy("pos")
    ends = F.size(F.split(t, "\n")) - 1
    line = F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quote = F.substring(t, 1, 1).isin("'", '"')
    long_ = t.rlike(r"(?s)\A('''.*'''|\"\"\".*\"\"\")\z") & (F.char_length(t) >= 6)
    kind = F.when(t.startswith("//") | t.startswith("/*"), "comment").when(quote, "string").when(t.isin("{", "}", "(", ")", "\n"), "mark").otherwise("word")
    text = F.when(quote & long_, F.substring(t, F.lit(4), F.char_length(t) - 6)).when(quote, F.substring(t, F.lit(2), F.char_length(t) - 2)).otherwise(t)
    return raw.select("file_uri", "pos", kind.alias("kind"), text.alias("text"), line.cast("int").alias("line")).where("kind <> 'comment'")


def in_blocks(rows: DataFrame, name: str) -> DataFrame:
    """Tokens with inside: how many blocks of that name are open at each.

    A block is named by the last word before its brace. Brackets are matched by prefix sums: the depth of a brace is the number of
    those open, and a closing one belongs to the last opening one of its depth.
    """
    order = Window.partitionBy("file_uri").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    open_, close = (F.col("kind") == "mark") & (F.col("text") == "{"), (F.col("kind") == "mark") & (F.col("text") == "}")
    step = F.when(open_, 1).when(close, -1).otherwise(0)
    summed = rows.withColumn("net", F.sum(step).over(upto))
    # Closing braces without an opening one count for nothing.
    depth = F.col("net") - F.least(F.lit(0), F.min("net").over(upto))
    last_word = F.max(F.when(F.col("kind") == "word", F.struct("pos", "text"))).over(upto)
    last_brace = F.max(F.when(open_ | close, F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = summed.withColumns({"depth": depth, "word": last_word, "brace": last_brace})
    title = F.when(F.col("word").isNotNull() & (F.coalesce(F.col("brace"), F.lit(-1)) < F.col("word.pos")), F.col("word.text")).otherwise("")
    level = F.when(open_, F.col("depth")).when(close, F.col("depth") + 1)
    named = known.withColumns({"title": F.when(open_, title), "level": level})
    same = Window.partitionBy("file_uri", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(open_, F.col("title")).when(close, F.last(F.when(F.col("kind") == "mark", F.struct("title", "text"))).over(same)["title"])
    # The stray closing braces have no partner: the last brace of their level is a closing one, or there is none.
    marked = named.withColumn("change", F.when(own == name, step).otherwise(0))
    return marked.withColumn("inside", F.sum("change").over(upto)).select("file_uri", "pos", "kind", "text", "line", "inside")


def declared(files: DataFrame) -> DataFrame:
    """``model.DECLARED`` rows of scripts (file_uri, text): the first declaration of each line inside a dependencies block, at any depth.

    A declaration is a configuration's word, maybe parentheses, and a string group:artifact:version.
    """
    rows = in_blocks(tokens(files), "dependencies").where("NOT (kind = 'mark' AND text = '(')")
    order = Window.partitionBy("file_uri").orderBy("pos")
    before = F.lag(F.struct("kind", "text")).over(order)
    parts = F.split("text", ":", 3)
    found = rows.withColumn("before", before).where((F.col("kind") == "string") & (F.col("inside") > 0) & (F.col("before.kind") == "word") & F.col("before.text").isin(*CONFIGURATIONS))
    found = found.withColumn("p", parts).where((F.size("p") == 3) & (F.array_min(F.transform("p", F.length)) > 0))
    first = found.groupBy("file_uri", "line").agg(F.min(F.struct("pos", "p")).alias("m"))
    ordinal = F.row_number().over(Window.partitionBy("file_uri").orderBy("m.pos")) - 1
    none = F.lit(None).cast("string")
    out = first.select(*[F.col("m.p")[k].alias(c) for k, c in enumerate(("group_id", "artifact_id", "version"))], none.alias("classifier"), none.alias("scope"), "line", "file_uri", ordinal.alias("ordinal"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECLARED])


def edges(trees: DataFrame) -> DataFrame:
    """``model.EDGES`` of printed dependency trees (file_uri, text), with the file in front of each node's id.

    Depth follows from the indent, and a blank line ends a tree. A line's parent is the last line before it that is one level up; where
    a print skips levels, the last one with a smaller depth.
    """
    lines = trees.select("file_uri", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("k", "line"))
    order = Window.partitionBy("file_uri").orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    part = lambda n: F.regexp_extract("line", _TREE, n)
    tree = F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(upto)
    nodes = lines.withColumn("tree", tree).where(F.col("line").rlike(_TREE))
    nodes = nodes.select("file_uri", "tree", "k", F.floor(F.char_length(part(1)) / INDENT).cast("int").alias("depth"), part(2).alias("group_id"), part(3).alias("artifact_id"), part(4).alias("version"))
    # As of each line: the last line of every level is looked up one level down.
    asks = nodes.select("*", (F.col("depth") - 1).alias("level"), F.lit(None).cast("int").alias("seen"))
    offers = nodes.select("*", F.col("depth").alias("level"), F.col("k").alias("seen"))
    both = asks.unionByName(offers)
    up = F.last("seen", ignorenulls=True).over(Window.partitionBy("file_uri", "tree", "level").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("parent", up).where("seen IS NULL").drop("level", "seen")
    # Where no level is skipped in a tree, the last line one level up is the parent; other trees are compared line by line.
    found = found.withColumn("before", F.lag("depth").over(Window.partitionBy("file_uri", "tree").orderBy("k")))
    skips = F.col("depth") > F.coalesce("before", F.lit(-1)) + 1
    odd = found.groupBy("file_uri", "tree").agg(F.max(skips).alias("odd"))
    found = found.join(odd, ["file_uri", "tree"])
    plain = found.where("NOT odd").select(*nodes.columns, "parent")
    wild = found.where("odd").select(*nodes.columns)
    above = wild.select("file_uri", "tree", F.col("k").alias("pk"), F.col("depth").alias("pd"))
    smaller = wild.join(above, ["file_uri", "tree"]).where("pk < k AND pd < depth").groupBy("file_uri", "k").agg(F.max("pk").alias("parent"))
    rows = plain.unionByName(wild.join(smaller, ["file_uri", "k"], "left").select(*nodes.columns, "parent"))
    ident = lambda c: F.when(c.isNotNull(), F.concat_ws("#", F.col("file_uri"), c.cast("string")))
    ordinal = F.row_number().over(Window.partitionBy("file_uri", "parent").orderBy("k")) - 1
    out = rows.select(ident(F.col("k")).alias("node_id"), ident(F.col("parent")).alias("parent_id"), ordinal.alias("ordinal"), "group_id", "artifact_id", "version", F.lit(None).alias("classifier"), F.lit("compile").alias("scope"), F.col("file_uri").alias("pom_path"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EDGES])


def subprojects(prints: DataFrame) -> DataFrame:
    """(file_uri, ordinal, path) of printed project lists (file_uri, text)."""
    lines = prints.select("file_uri", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("ordinal", "line"))
    path: Column = F.regexp_extract("line", r"[+\\]--- Project '(:[^']+)'", 1)
    return lines.select("file_uri", "ordinal", path.alias("path")).where("path <> ''")
