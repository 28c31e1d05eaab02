"""Forests in logarithmically many rounds: Euler tours ranked by pointer jumping.

A tour enters and leaves every node once. Each step knows the next one; in a round every step takes over what the step it points
to knows (how many steps and nodes lie behind, and what the depth changes by), and points where that one points. After log2(2n)
rounds, each one join of written tables, all point to the end of their root's tour, so pre-order numbers, depths and subtree sizes are differences of
sums, however deep the forest is.

A node has one parent here; ``deps.flatten`` unfolds graphs where it has several. Nodes below no root (on a cycle or below
one) are left out. Only the order of siblings is a window, over one parent's children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.tables import discard, materialize

_SUMS = ("pre", "steps", "depth")


def is_forest(edges: DataFrame) -> bool:
    """Whether no node comes twice."""
    return edges.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _steps(edges: DataFrame) -> DataFrame:
    """(x, next, last, pre, steps, depth): entering and leaving each node, with the step after it."""
    e = edges.select("node_id", "parent_id", "ordinal")
    after = F.lead("node_id").over(Window.partitionBy("parent_id").orderBy("ordinal", "node_id"))
    below = e.where("parent_id IS NOT NULL").withColumn("after", after)
    first = below.groupBy(F.col("parent_id").alias("above")).agg(F.min(F.struct("ordinal", "node_id"))["node_id"].alias("child"))
    nodes = below.unionByName(e.where("parent_id IS NULL").withColumn("after", F.lit(None).cast("string")))
    rows = nodes.join(first, F.col("node_id") == F.col("above"), "left")
    enter, leave = (lambda c: F.concat(F.lit("<"), c)), (lambda c: F.concat(F.lit(">"), c))
    step = lambda x, to, pre, depth: F.struct(x.alias("x"), to.alias("next"), F.when(to.isNull(), x).alias("last"), F.lit(pre).cast("long").alias("pre"), F.lit(1).cast("long").alias("steps"), F.lit(depth).cast("long").alias("depth"))
    node = F.col("node_id")
    both = F.array(step(enter(node), F.coalesce(enter(F.col("child")), leave(node)), 1, 1), step(leave(node), F.coalesce(enter(F.col("after")), leave(F.col("parent_id"))), 0, -1))
    return rows.select(F.explode(both).alias("s")).select("s.*")


def ranked(steps: DataFrame) -> tuple[DataFrame, int]:
    """Steps with the sums from each to its list's end, last; and the number of rounds."""
    rows = materialize(steps, "tour")
    n, open_ = rows.agg(F.count("*"), F.sum(F.when(F.col("next").isNotNull(), 1).otherwise(0))).first()
    rounds, most = 0, int(n).bit_length() + 1
    while open_ and rounds < most:
        there = rows.select(F.col("x").alias("there"), F.col("next").alias("then"), F.col("last").alias("end"), *[F.col(c).alias(f"more_{c}") for c in _SUMS])
        joined = rows.join(there, F.col("next") == F.col("there"), "left")
        one = materialize(joined.select("x", F.col("then").alias("next"), F.coalesce("last", "end").alias("last"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS]), "tour")
        discard(rows)
        rows, rounds = one, rounds + 1
        open_ = one.where("next IS NOT NULL").count()
    return rows, rounds


def preorder(edges: DataFrame) -> DataFrame:
    """(node_id, root_id, pre, size, depth, enter, leave) of a forest (node_id, parent_id, ordinal).

    pre numbers a root's nodes from 0 in depth-first order, size counts a subtree's nodes; enter and leave are places in
    the root's tour. Children of one parent are ordered by ordinal, then id.
    """
    rows, _ = ranked(_steps(edges))
    done = rows.where("next IS NULL AND last IS NOT NULL")
    way = lambda mark, c: F.max(F.when(F.col("x").startswith(mark), F.col(c)))
    per = done.groupBy(F.expr("substring(x, 2)").alias("node_id"), F.expr("substring(last, 2)").alias("root_id"))
    nodes = per.agg(way("<", "pre").alias("p"), way(">", "pre").alias("q"), way("<", "depth").alias("d"), way("<", "steps").alias("s"), way(">", "steps").alias("t"))
    total = nodes.where("node_id = root_id").select(F.col("root_id").alias("r"), F.col("p").alias("nodes"), F.col("s").alias("all"))
    out = nodes.join(total, F.col("root_id") == F.col("r"))
    return materialize(out.select("node_id", "root_id", (F.col("nodes") - F.col("p")).alias("pre"), (F.col("p") - F.col("q")).alias("size"), (-F.col("d")).cast("int").alias("depth"), (F.col("all") - F.col("s")).alias("enter"), (F.col("all") - F.col("t")).alias("leave")), "preorder")


def _object(facts: list[str]) -> Column:
    """A JSON object of columns, without its closing brace."""
    text = F.to_json(F.struct(*facts), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(1), F.char_length(text) - 1)


def nested(edges: DataFrame, facts: list[str]) -> DataFrame:
    """(root_id, ordinal, json): every root's tree as one JSON text with children, written down along its tour.

    A text is as large as its tree; trees are apart. edges has the facts of each node.
    """
    order = preorder(edges)
    ordinal = edges.where("parent_id IS NULL").select(F.col("node_id").alias("r"), F.col("ordinal").alias("root_ordinal"))
    first = edges.groupBy(F.col("parent_id").alias("above")).agg(F.min(F.struct("ordinal", "node_id"))["node_id"].alias("child"))
    info = edges.select("node_id", "parent_id", _object(facts).alias("object")).join(first, F.col("parent_id") == F.col("above"), "left")
    rows = order.join(info, "node_id")
    comma = F.when(F.col("parent_id").isNull() | (F.col("child") == F.col("node_id")), "").otherwise(",")
    parts = F.array(F.struct(F.col("enter").alias("at"), F.concat(comma, "object", F.lit(',"children":[')).alias("text")), F.struct(F.col("leave").alias("at"), F.lit("]}").alias("text")))
    text = rows.select("root_id", F.explode(parts).alias("part")).groupBy("root_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "").alias("json"))
    return text.join(ordinal, F.col("root_id") == F.col("r")).select("root_id", F.col("root_ordinal").alias("ordinal"), "json")
