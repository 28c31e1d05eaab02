"""Exact dedup with Patricia tries as owners of distinct byte strings.

1. Each map task inserts the normalised texts of its own partition into one compressed radix trie and emits one row for
   each distinct text: its bytes, the smallest id, a count. A hot text so leaves each task once, however often it occurs.
2. Those rows are dealt by (length, content hash); a task inserts the full byte strings of its part into a trie
   again, whose terminal nodes keep the smallest id and the sum of counts.
3. The owners' (digest, keep_id, group_size) are joined to the documents by digest.

A trie has a memory bound. Beyond it whole subtrees, the largest first, are written to files of that task alone until
half of the memory is free. After the input's end the files are read one by one, each into a trie with the same bound,
which may spill again.

Normalisation: each run of the bytes 20 and 09-0D becomes one space. A null text is an empty one; empty
texts are equal to each other. Of equal texts the smallest id stays, null ids come last. Rows that repeat an
id count as rows of the group. An empty table gives no rows; other columns are ignored. A very long text is one label of
its trie, or a file's record where it alone is beyond the bound.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import materialize, project, table

#: Bytes that the trie of a task may hold, and what a node counts for besides its label.
MEMORY, NODE = 96 << 20, 300
#: Files over which a trie spills.
FILES = 32
#: Rows in an Arrow batch that leaves a task.
BATCH = 512

Item = tuple[bytes, "int | None", int]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: bytes are compared in blocks."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A compressed radix trie from byte strings to (smallest id, count), under a memory bound.

    A node is [label, children by first byte or None, owner or None].
    """

    def __init__(self, memory: int = MEMORY, level: int = 0) -> None:
        self.root: list = [b"", {}, None]
        self.memory, self.level, self.held = memory, level, 0
        self.files: dict[int, object] = {}

    @staticmethod
    def _merge(node: list, ident: int | None, count: int) -> None:
        if node[2] is None:
            node[2] = (ident, count)
        else:
            old, n = node[2]
            known = [x for x in (old, ident) if x is not None]
            node[2] = (min(known) if known else None, n + count)

    def insert(self, key: bytes, ident: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            children = node[1]
            child = children.get(key[at]) if children else None
            if child is None:
                if children is None:
                    children = node[1] = {}
                children[key[at]] = [key[at:], None, (ident, count)]
                self.held += len(key) - at + NODE
                if self.held > self.memory:
                    self._spill()
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = shared(label, key[at : at + len(label)])
            fork = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            children[key[at]] = fork
            self.held += NODE
            node, at = fork, at + same
        self._merge(node, ident, count)

    @staticmethod
    def walk(start: list, prefix: bytes = b"") -> Iterator[Item]:
        """The items of a subtree whose label follows a prefix."""
        stack = [(start, prefix)]
        while stack:
            node, head = stack.pop()
            head += node[0]
            if node[2] is not None:
                yield head, *node[2]
            if node[1]:
                stack += [(child, head) for child in node[1].values()]

    def _subtrees(self) -> list[tuple[int, bytes, list, int]]:
        """(size, prefix, parent, first byte) of subtrees below a quarter of the memory (or leaves), largest first."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            if node[1]:
                stack += node[1].values()
        sizes: dict[int, int] = {}
        for node in reversed(order):
            sizes[id(node)] = len(node[0]) + NODE + sum(sizes[id(child)] for child in (node[1] or {}).values())
        out, wide = [], [(b"", self.root)]
        while wide:
            prefix, node = wide.pop()
            for first, child in (node[1] or {}).items():
                if 4 * sizes[id(child)] > self.memory and child[1]:
                    wide.append((prefix + child[0], child))
                else:
                    out.append((sizes[id(child)], prefix, node, first))
        return sorted(out, key=lambda x: -x[0])

    def _spill(self) -> None:
        subtrees = self._subtrees()
        if len(subtrees) == 1 and not self.root[2] and subtrees[0][2] is self.root and not self.root[1][subtrees[0][3]][1]:
            return  # a single text, which has to be held
        for size, prefix, parent, first in subtrees:
            if 2 * self.held <= self.memory:
                return
            for item in self.walk(parent[1].pop(first), prefix):
                self._write(item)
            self.held -= size
        for item in self.walk(self.root):  # those that all subtrees began with
            self._write(item)
        self.root, self.held = [b"", {}, None], 0

    def _write(self, item: Item) -> None:
        # Another level deals its keys differently, so that a file's keys part again.
        bucket = hash((self.level, item[0])) % FILES
        if bucket not in self.files:
            self.files[bucket] = tempfile.TemporaryFile()
        pickle.dump(item, self.files[bucket])

    def items(self) -> Iterator[Item]:
        """Every distinct key once; the trie is empty then."""
        if not self.files:
            yield from self.walk(self.root)
            return
        for item in self.walk(self.root):
            self._write(item)
        self.root = [b"", {}, None]
        while self.files:
            file = self.files.popitem()[1]
            end = file.tell()
            file.seek(0)
            part = Patricia(self.memory, self.level + 1)
            while file.tell() < end:
                part.insert(*pickle.load(file))
            file.close()
            yield from part.items()


OWNER_SCHEMA = pa.schema([("body", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _own(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    trie = Patricia(memory)
    for batch in batches:
        for body, ident, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            trie.insert(body, ident, n)
    out: list[Item] = []
    held = 0
    for item in trie.items():
        out.append(item)
        held += len(item[0])
        if len(out) >= BATCH or held > 4 << 20:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, field.type) for col, field in zip(zip(*rows, strict=True), OWNER_SCHEMA, strict=True)], schema=OWNER_SCHEMA)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def owners(rows: DataFrame, memory: int = MEMORY) -> DataFrame:
    """(body, keep_id, n) for each distinct body of (body binary, id, n)."""
    schema = "body binary, keep_id long, n long"
    keyed = rows.select("body", F.col("id").cast("long").alias("keep_id"), F.col("n").cast("long").alias("n"))
    own = lambda batches: _own(batches, memory)
    local = keyed.mapInArrow(own, schema).withColumns({"length": F.octet_length("body"), "hash": F.xxhash64("body")})
    return local.repartition("length", "hash").drop("length", "hash").mapInArrow(own, schema)


def dedup(df: DataFrame, id_col: str, text_col: str, memory: int = MEMORY) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row.

    kept marks the rows whose id is keep_id; ids are compared as integers, null equal to null.
    """
    rows = project(df, id=id_col, text=text_col)
    ids = rows.select(F.col("id").cast("long").alias("id"), normalised(F.col("text")).cast("binary").alias("body"))
    found = owners(ids.select("body", "id", F.lit(1).alias("n")), memory).select(F.sha2("body", 256).alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))
    found = materialize(found, "owners")
    each = ids.select("id", F.sha2("body", 256).alias("text_sha256"))
    out = each.join(found, "text_sha256")
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
