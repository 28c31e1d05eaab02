"""Phrase collocation mining with depth-limited count tries.

1. A task counts the words, word pairs and triples of about ``SHARD`` bytes of text in a trie of depth ``DEPTH`` for each
   language. Its vocabulary is sorted, so a node is a path of word ranks and the sorted paths are the trie in pre-order. The
   trie is serialised in ``RANGES`` parts by the hash of a node's prefix (its first two words).
2. Parts of one range are merged k ways: vocabularies are united, which keeps each run's order, and sorted runs are merged with
   their counts added. A round merges about ``FAN`` runs; with more of them, merged tries are cut into ranges again, by turns on
   the prefix and on the last word, so that a prefix however hot is spread too, and merged in another round. All parts stay
   about as large as those of a shard.
3. The last round keeps nodes with at least ``FLOOR`` occurrences: all parts of a candidate occur at least as often as it
   does, so nothing that is needed goes. The kept trie is a table of nodes. A step from a node to its parent gives the left part of a
   cut, and the parent's own parent the one before; a suffix link, to the node of the path without its first word, gives the
   right parts.
4. Scores are integer quotients of 38-digit decimals; an overflow is an error, never a wrong value.

Words and pieces: A-Z in lower case, pieces end at any of .,;:!? and at bytes 0A-0D, words at spaces and tabs. Edge cases: null and
empty texts have no words; a null language is 'und'; rows that repeat count again; an empty table or no phrase that is frequent
enough gives no rows; texts beyond ``SHARD`` bytes are cut between pieces; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.common import discard, materialize, project, release, table
from symlake.llm.rolling import U64, Prints, mix

DEPTH, FLOOR, TOP, COVER = 3, 10, 2000, 50
SCALE = 1_000_000
#: Bytes of text in a shard's tries; parts that a trie is cut into; runs that a merge takes, about.
SHARD, RANGES, FAN = 8 << 20, 128, 128
#: Phrases are ranked in so many groups a language first, then in fewer.
GROUPS = (1024, 32)
#: 0 for a word's bytes, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_TURN = (U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F))


class Trie(NamedTuple):
    """Sorted words, nodes as rows of DEPTH ranks (from 1; 0 where a path has ended) in pre-order, and their counts."""

    words: pa.BinaryArray
    paths: np.ndarray
    counts: np.ndarray


def ordered(words: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Distinct words in byte order, and each given word's rank from 1."""
    encoded = words.dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary)
    rank = np.empty(len(order) + 1, np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return encoded.dictionary.take(order), rank[encoded.indices.to_numpy()]


def tally(paths: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Paths in order, each once, with the sum of their counts (of ones without counts). Runs in order are merged as such."""
    bits = int(paths.max(initial=0)).bit_length()
    if bits * DEPTH < 64:
        keys = paths[:, 0].astype(np.int64)
        for k in range(1, DEPTH):
            keys = keys << bits | paths[:, k]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    else:
        order = np.lexsort([paths[:, k] for k in reversed(range(DEPTH))])
        sorted_ = paths[order]
        fresh = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)])) if len(paths) else np.zeros(0, np.int64)
    if counts is None:
        sums = np.diff(np.append(fresh, len(paths)))
    else:
        sums = np.add.reduceat(counts[order], fresh) if len(fresh) else np.zeros(0, np.int64)
    return paths[order[fresh]], sums.astype(np.int64)


def count(text: bytes) -> Trie:
    """The trie of a text's phrases."""
    data = np.frombuffer(text.lower(), np.uint8)
    kind = _KIND[data]
    edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    every = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[kind == 0]))])
    words, ranks = ordered(every)
    breaks = np.flatnonzero(kind == 2)
    del data, kind, edge, stop, every
    piece, ranks = np.searchsorted(breaks, start).astype(np.int32), ranks.astype(np.int32)
    found = []
    for depth in range(1, DEPTH + 1):
        m = max(0, len(ranks) - depth + 1)
        inside = piece[:m] == piece[depth - 1 : depth - 1 + m]
        paths = np.zeros((int(inside.sum()), DEPTH), np.int32)
        for k in range(depth):
            paths[:, k] = ranks[k : k + m][inside]
        found.append(tally(paths, None))
    return Trie(words, *tally(np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])))


def _planes(a: np.ndarray) -> bytes:
    """Numbers by bytes of like weight, which compress well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def _letters(words: pa.BinaryArray) -> bytes:
    """All words' bytes, one after the other."""
    if not len(words):
        return b""
    _, offsets, data = words.buffers()
    first, last = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)[[0, -1]].tolist()
    return data.slice(first, last - first).to_pybytes() if data is not None else b""


def dump(trie: Trie) -> bytes:
    """A trie with only the words that its paths have."""
    used, local = np.unique(trie.paths, return_inverse=True)
    local = local.reshape(trie.paths.shape) + (0 if len(used) and used[0] == 0 else 1)
    words = trie.words.take(pa.array(used[used > 0] - 1))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint32)
    letters = _letters(words)
    head = np.array([len(words), len(trie.paths), len(letters)], np.int64).tobytes()
    body = b"".join([head, _planes(lengths), letters, *[_planes(np.ascontiguousarray(local[:, k]).astype(np.uint32)) for k in range(DEPTH)], _planes(trie.counts)])
    return zstandard.ZstdCompressor(level=1).compress(body)


def load(blob: bytes) -> Trie:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n_words, n, n_letters = np.frombuffer(body, np.int64, 3)
    at = 24

    def planes(kind: type, many: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        out = np.frombuffer(body, np.uint8, many * size, at).reshape(size, many).T
        at += many * size
        return np.ascontiguousarray(out).view(kind).ravel()

    offsets = np.zeros(n_words + 1, np.int32)
    np.cumsum(planes(np.uint32, int(n_words)), out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), int(n_words), [None, pa.py_buffer(offsets), pa.py_buffer(body[at : at + int(n_letters)])])
    at += int(n_letters)
    paths = np.stack([planes(np.uint32, int(n)).astype(np.int32) for _ in range(DEPTH)], axis=1)
    return Trie(words, paths, planes(np.int64, int(n)))


def merge(blobs: list[bytes]) -> Trie:
    """One trie of several."""
    tries = [load(b) for b in blobs]
    words, rank = ordered(pa.concat_arrays([t.words for t in tries]))
    paths, at = [], 0
    for t in tries:
        own = np.concatenate([[0], rank[at : at + len(t.words)]]).astype(np.int32)
        paths.append(own[t.paths])
        at += len(t.words)
    return Trie(words, *tally(np.concatenate(paths), np.concatenate([t.counts for t in tries])))


def ranges(trie: Trie, round_: int) -> np.ndarray:
    """The range of each node: by its first two words in even rounds, by its last word in odd ones, other bits each time."""
    lengths = pc.binary_length(trie.words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(_letters(trie.words), np.uint8)
    ends = np.cumsum(lengths)
    word = np.zeros(len(lengths) + 1, U64)
    if len(lengths):
        word[1:] = mix(Prints(data).of(ends - lengths, ends) + lengths.astype(U64))
    paths = trie.paths
    code = word[paths[:, -1]] if round_ % 2 else mix(word[paths[:, 0]] * _TURN[0] + word[paths[:, 1]] * _TURN[1])
    return ((code >> U64(round_ // 2 * 7)) % U64(RANGES)).astype(np.int64)


def cut(trie: Trie, round_: int) -> Iterator[tuple[int, bytes]]:
    """(range, serialised part) of the ranges that have nodes."""
    where = ranges(trie, round_)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(RANGES + 1))
    for r in range(RANGES):
        own = order[edges[r] : edges[r + 1]]
        if len(own):
            yield r, dump(Trie(trie.words, trie.paths[own], trie.counts[own]))


PARTS = "lang string, path long, run long, part binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["lang", "path", "run", "part"])


def _whole_pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SHARD bytes that end where a piece ends."""
    at = 0
    while len(text) - at > SHARD:
        found = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, SHARD, at)] == 2)
        if not len(found):  # a piece longer than a shard stays whole
            rest = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, len(text) - at, at)] == 2)
            found = rest[:1] if len(rest) else np.array([len(text) - at - 1])
        end = at + int(found[-1]) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size, run = 0, TaskContext.get().partitionId() << 24

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            # A line end between texts ends a piece.
            trie = count(b"\n".join(held[lang]))
            rows = [(lang, r, run, part) for r, part in cut(trie, 0)]
            if rows:
                yield _batch(rows)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _whole_pieces(text.as_buffer().to_pybytes()):
                if size and size + len(part) > SHARD:
                    yield from flush()
                    held, size, run = {}, 0, run + 1
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
    yield from flush()


def _merged(parts: DataFrame, groups: int, round_: int) -> DataFrame:
    """Parts with the runs of each range and group merged, cut into ranges once more."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, path, group = (k.as_py() for k in key)
        out = [(lang, path * RANGES + r, group, part) for r, part in cut(merge([x.as_py() for x in rows.column("part")]), round_)]
        return pa.Table.from_batches([_batch(out)])

    return parts.groupBy("lang", "path", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).applyInArrow(run, PARTS)


NODES = "lang string, w1 string, w2 string, w3 string, f long"


def _kept(parts: DataFrame, floor: int) -> DataFrame:
    """``NODES`` of all ranges from floor occurrences on; a row without words has the number of a range's words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        trie = merge([x.as_py() for x in rows.column("part")])
        total = int(trie.counts[trie.paths[:, 1] == 0].sum())
        often = np.flatnonzero(trie.counts >= floor)
        words = [pc.cast(trie.words.take(pa.array(np.append(p, 0) - 1, mask=np.append(p, 0) == 0)), pa.string()) for p in (trie.paths[often, k] for k in range(DEPTH))]
        langs = pa.array([key[0].as_py()] * (len(often) + 1), pa.string())
        return pa.table([langs, *words, pa.array(np.append(trie.counts[often], total), pa.int64())], names=["lang", "w1", "w2", "w3", "f"])

    return parts.groupBy("lang", "path").applyInArrow(run, NODES)


def frequent(df: DataFrame, text_col: str, lang_col: str, floor: int = FLOOR, fan: int = FAN) -> DataFrame:
    """``NODES`` of the merged trie, written."""
    rows = project(df, lang=F.coalesce(df[lang_col].cast("string"), F.lit("und")), body=F.coalesce(df[text_col], F.lit("")).cast("binary"))
    parts = materialize(rows.mapInArrow(_shards, PARTS), "tries")
    runs, round_ = parts.agg(F.count_distinct("run")).first()[0], 0
    while runs > fan:
        groups, round_ = math.ceil(runs / fan), round_ + 1
        more = materialize(_merged(parts, groups, round_), "tries")
        discard(parts)
        parts, runs = more, groups
    out = materialize(_kept(parts, floor), "nodes")
    discard(parts)
    release(df.sparkSession)
    return out


def _cut_score(a: str, left: str, right: str) -> Column:
    big = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    return F.expr(f"CAST({big(SCALE)} * {big(a)} * {big(a)} div ({big(left)} * {big(right)}) AS LONG)")


def scored(nodes: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates but those that a longer one covers."""
    one = nodes.where("w1 IS NOT NULL AND w2 IS NULL").select("lang", "w1", "f")
    two = nodes.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a"))
    three = nodes.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    pairs = two.join(one.withColumnRenamed("f", "l"), ["lang", "w1"]).join(one.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r")), ["lang", "w2"])
    pairs = materialize(pairs.select("lang", "w1", "w2", "a", "l", "r"), "pairs")
    # A triple's parent gives both left parts, the node of its suffix both right ones.
    parent = pairs.select("lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    suffix = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    triples = three.join(parent, ["lang", "w1", "w2"]).join(suffix, ["lang", "w2", "w3"])
    triples = triples.withColumns({"s1": _cut_score("a", "l1", "r1"), "s2": _cut_score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    long_ = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    inside = three.select("lang", "w1", "w2", F.col("a").alias("whole")).unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("whole")))
    covered = inside.groupBy("lang", "w1", "w2").agg(F.max("whole").alias("whole"))
    free = pairs.join(covered, ["lang", "w1", "w2"], "left").where(f"whole IS NULL OR 100 * whole < {cover} * a")
    short = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _cut_score("a", "l", "r").alias("score"))
    return short.unionByName(long_)


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first phrases with their rank; the best of ever fewer groups meet, so that no task sorts a language."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for n in GROUPS:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*best)
        phrases = phrases.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("rank")
    return phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)


def mine(df: DataFrame, text_col: str, lang_col: str, floor: int = FLOOR, top: int = TOP, cover: int = COVER, fan: int = FAN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    nodes = frequent(df, text_col, lang_col, floor, fan)
    totals = nodes.where("w1 IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked(scored(nodes, cover), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"), "text", "lang")


SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {DEPTH + 1})) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= {FLOOR}),
s AS (SELECT c.lang, phrase, c.k, a, cut, array_to_string(ws[:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c),
q AS (SELECT s.lang, s.phrase, s.k, s.a, cut, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * s.a * s.a) // (l.f::HUGEINT * r.f) AS score FROM s JOIN g l ON l.lang = s.lang AND l.phrase = lp JOIN g r ON r.lang = s.lang AND r.phrase = rp),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
t AS (SELECT lang, phrase AS whole, a AS f, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND t.phrase = b.phrase AND 100 * t.f >= {COVER} * b.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}
"""
