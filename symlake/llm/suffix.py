"""Suffix-array dedup: remove every byte covered by a long string that also starts elsewhere.

Distributed prefix doubling decides which positions begin a repeated string, without ever holding more than
one text in a task:

* Positions are first thinned out to anchors. The anchor of a window start is the position with the least
  hash in the ``WINDOW`` bytes that follow (leftmost at ties); starts that share an anchor form an interval. Equal
  windows have equal anchors at equal distances, so that ranking anchors loses nothing.
* Round 1 ranks anchors by their first 73 bytes, and those with a rank of their own are out. Round 2 ranks pairs (rank
  at the anchor, name of the string 72 bytes further on), which tells the first 145 bytes: all that the windows
  of an interval share. Again only shared ranks stay.
* Rounds 3 and 4 take blocks of ``STEPS`` starts. They rank pairs (rank of the anchor so far, name of what all windows of the block
  share), which tells 385 and 400 bytes. Lengths are for a threshold of 400.
* From round 2 on, a block whose whole surroundings, from its first start to its last window's end, occur more than once
  is settled: all its starts repeat. Only the others (mostly edges of edits) go on to the next, longer round, one
  of each kind of equal surroundings.

Strings count as equal only if the salted SHA-256 of all their bytes (64 bits of it) agrees besides their ranks, and ranks come from prints
modulo a prime at a base that is drawn for each run, so that no text can be made to collide.

A rank is a 64-bit hash of the pair that it stands for rather than an ordinal, so that a round needs no global order: Spark
groups the pairs, partially before the shuffle, and joins the shared ones back. Ranking every position instead of
anchors would shuffle a pair for each byte and round, some hundred times the input.

The same is done on words instead of bytes (``WORDS``) where a passage is long by its number of words: positions
are then those of words, and a word counts by its hash.

Groups of any size are grouped and joined by hash with partial aggregation; no pairs are made. Work in
Python is done on chunks of ``CHUNK`` bytes whatever the length of a text.

Edge cases: null and empty texts have no bytes; texts below the threshold lose nothing; rows that repeat, ids
included, are documents of their own and so copies of each other; an empty table gives no rows. Rows are told
apart by a 64-bit hash of id and text. A very long text is taken in chunks; its spans are one array in one task.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import discard, materialize, project, release, table
from symlake.llm.oddsketch import words
from symlake.llm.rolling import U64, PrimePrints, Prints, drawn_base, mix

THRESHOLD = 400
#: Bytes within which every window has an anchor (a power of two), and the grams whose hashes choose it.
WINDOW, GRAM = 256, 16
#: Starts in a block, round by round.
STEPS = (WINDOW, 16, 1)
#: Words from which a repeated passage counts, however few bytes it has.
PASSAGE = 51
CHUNK = (1 << 20) - 8


class Unit(NamedTuple):
    """What a text is a sequence of, and how its windows are thinned out and cut into blocks."""

    symbols: Callable[[pa.Buffer, int], np.ndarray]
    window: int
    gram: int
    steps: tuple[int, ...]


BYTES = Unit(lambda buf, _: np.frombuffer(buf, np.uint8), WINDOW, GRAM, STEPS)
WORDS = Unit(lambda buf, base: words(buf.to_pybytes(), base)[2], 32, 2, (32, 4, 1))



class Run(NamedTuple):
    """What is drawn for each run: the prints' base and the digests' salt."""

    base: int
    salt: bytes


_PLACE = [("key", pa.int64()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]
FIRST = pa.schema([*_PLACE, ("head", pa.int64()), ("tail", pa.int64()), ("whole", pa.int64())])
FIRST_DDL = "key long, p int, a int, b int, head long, tail long, whole long"
ROWS = pa.schema([*_PLACE, ("root", pa.int64()), ("core", pa.int64()), ("whole", pa.int64())])
ROWS_DDL = "key long, p int, a int, b int, root long, core long, whole long"


def anchors(prints: Prints, valid: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, a, b): anchors and the intervals a .. b of valid window starts that have them."""
    k = mix(prints.grams(gram)) & U64(0xFFFFFFFF00000000)
    k |= np.arange(len(k), dtype=U64)
    step = 1
    while step < window:
        k = np.minimum(k[:-step], k[step:])
        step *= 2
    p = (k[: len(valid)] & U64(0xFFFFFFFF)).astype(np.int64)
    valid = valid[: len(p)]
    edge = np.ones(len(p), bool)
    edge[1:] = (p[1:] != p[:-1]) | (valid[1:] != valid[:-1])
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(p)) - 1
    a, b = a[valid[a]], b[valid[a]]
    return p[a], a, b


def surroundings(data: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: int, salt: bytes) -> np.ndarray:
    """Names of all that windows from lo to hi cover, and of where the anchor is in it: 64 bits of a salted SHA-256 of these symbols."""
    view, size = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    start = hashlib.sha256(salt)
    out = bytearray()
    for at, a, e in zip(p.tolist(), lo.tolist(), (hi + threshold).tolist(), strict=True):
        own = start.copy()
        own.update(b"%d %d " % (at - a, e - a))
        own.update(view[a * size : e * size])
        out += own.digest()[:8]
    return np.frombuffer(bytes(out), U64, len(p)) if len(p) else np.zeros(0, U64)


def blocks(data: np.ndarray, run: Run, p: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, threshold: int) -> tuple[np.ndarray, ...]:
    """Cut intervals into blocks of step starts, counted back from the anchor: (item, a, b, core, whole)."""
    first, last = (p - b) // step, (p - a) // step
    n = last - first + 1
    item = np.repeat(np.arange(len(p)), n)
    j = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + first[item]
    ip = p[item]
    lo, hi = np.maximum(a[item], ip - step * (j + 1) + 1), np.minimum(b[item], ip - step * j)
    core = mix(PrimePrints(data, run.base).of(ip - step * j, ip - step * (j + 1) + 1 + threshold) + j.astype(U64) * U64(0xD6E8FEB86659FD93))
    return item, lo, hi, core, surroundings(data, ip, lo, hi, threshold, run.salt)


def _batch(schema: pa.Schema, key: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, *names: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(key, pa.int64()), *[pa.array(x.astype(np.int32)) for x in (p, lo, hi)], *[pa.array(x.view(np.int64)) for x in names]]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _tiles(batches: Iterator[pa.RecordBatch], threshold: int, unit: Unit, base: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(key, offset, symbols) in lists of at most CHUNK symbols; tiles of a text overlap so that each start is in one."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            buf = text.as_buffer() if text.is_valid else None
            if buf is None or buf.size < threshold:
                continue
            own = unit.symbols(buf, base)
            room = CHUNK - threshold + 1
            for at in range(0, len(own) - threshold + 1, room):
                part = own[at : at + CHUNK].copy()
                if held and size + len(part) > CHUNK:
                    yield held
                    held, size = [], 0
                held.append((key, at, part))
                size += len(part)
    if held:
        yield held


def _round_one(batches: Iterator[pa.RecordBatch], threshold: int, run: Run, unit: Unit = BYTES) -> Iterator[pa.RecordBatch]:
    for tiles in _tiles(batches, threshold, unit, run.base):
        data = np.concatenate([t[2] for t in tiles])
        sizes = np.array([len(t[2]) for t in tiles])
        ends = np.cumsum(sizes)
        prints, valid = PrimePrints(data, run.base), np.ones(len(data), bool)
        for e in ends:
            valid[e - threshold + 1 : e] = False
        p, a, b = anchors(Prints(data), valid, unit.window, unit.gram)
        shared = threshold - unit.window + 1  # what all windows of an interval have, from the anchor on
        half = (shared + 1) // 2
        head, tail = mix(prints.of(p, p + half)), mix(prints.of(p + shared - half, p + shared))
        tile = np.searchsorted(ends, a, side="right")
        shift = np.array([t[1] for t in tiles])[tile] - (ends - sizes)[tile]
        yield _batch(FIRST, np.array([t[0] for t in tiles], np.int64)[tile], p + shift, a + shift, b + shift, head, tail, surroundings(data, p, a, b, threshold, run.salt))


def _next_round(batches: Iterator[pa.RecordBatch], step: int, threshold: int, run: Run, unit: Unit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = batch.column(2)
        ends = np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))
        flat = asked.flatten()
        every = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
        for k, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            own = unit.symbols(text.as_buffer(), run.base)
            rows = [x[ends[k - 1] if k else 0 : ends[k]] for x in every]
            order = np.argsort(rows[1], kind="stable")
            ps, starts, stops, ranks = (x[order] for x in rows)
            at = 0
            while at < len(starts):
                start = int(starts[at])
                end = max(at + 1, int(np.searchsorted(starts, start + CHUNK - threshold - 2 * unit.window, side="right")))
                p, a, b = (x[at:end] - start for x in (ps, starts, stops))
                part = own[start : start + int(b.max()) + threshold + unit.window]
                item, lo, hi, core, whole = blocks(part, run, p, a, b, step, threshold)
                yield _batch(ROWS, np.full(len(lo), key, np.int64), p[item] + start, lo + start, hi + start, ranks[at:end][item], core, whole)
                at = end


def _shared(rows: DataFrame, rank: list[str], spent: list[DataFrame]) -> DataFrame:
    """The rows of a table whose rank, a column or a pair, isn't their own; the table that they need joins spent."""
    # A table of its own: Spark can split a hot name's rows over tasks only where both sides of a join come from shuffles.
    often = materialize(rows.groupBy(*rank).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "often")
    spent.append(often)
    return rows.join(often, rank).select(*rows.columns)


def repeats(docs: DataFrame, threshold: int = THRESHOLD, unit: Unit = BYTES) -> DataFrame:
    """(key, spans): the spans of repeated strings of each document (key, body) that has any; unordered, may overlap.

    A span [a, e) is the number a * 2^32 + e. Threshold and spans count the unit's symbols; the threshold is larger than the unit's window and gram together.
    """
    assert threshold > unit.window + unit.gram
    run = Run(drawn_base(), secrets.token_bytes(16))
    spark = docs.sparkSession
    span = lambda df: df.select("key", (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b") + threshold).alias("span"))
    first = materialize(docs.select("key", "body").mapInArrow(lambda b: _round_one(b, threshold, run, unit), FIRST_DDL), "anchors")
    spent: list[DataFrame] = [first]
    shared = materialize(_shared(first, ["head"], spent), "round1")
    discard(*spent)
    rows = shared.select("key", "p", "a", "b", F.col("head").alias("root"), F.col("tail").alias("core"), "whole")
    found, slim, spent = [], None, [shared]
    for k, step in enumerate(unit.steps, 1):
        if step == 1:
            found.append(span(_shared(rows, ["root", "core", "whole"], spent)))
            break
        # A rank of its own is one kind that occurs once, and goes no further.
        kinds = materialize(rows.groupBy("root", "core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "p", "a", "b")).alias("one")), "kinds")
        found.append(span(rows.join(kinds.where("n > 1").select("root", "core", "whole"), ["root", "core", "whole"])))
        open_ = kinds.groupBy("root", "core").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where("kinds > 1 AND single > 0")
        open_ = materialize(open_.select("root", "core"), "open_names")
        rank = F.xxhash64("root", "core").alias("rank")
        asked = kinds.join(open_, ["root", "core"]).groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("one.p", "one.a", "one.b", rank)).alias("asked"))
        if slim is None:  # the texts that go on, once each
            texts = slim = materialize(docs.select("key", "body").join(asked, "key").dropDuplicates(["key"]), "open")
        else:
            texts = slim.drop("asked").join(asked, "key")
        spent += [kinds, open_, slim]
        release(spark)
        rows = materialize(texts.select("key", "body", "asked").mapInArrow(lambda b, s=unit.steps[k]: _next_round(b, s, threshold, run, unit), ROWS_DDL), f"blocks{k + 1}")
        spent.append(rows)
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    # Rows that repeat each other share their spans, which are kept once.
    out = materialize(all_.groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")
    discard(*spent)
    release(spark)
    return out


def merged(spans: pa.ListArray) -> list[np.ndarray]:
    """The maximal runs of each list of spans, as arrays with rows (a, e)."""
    sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    packed = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((packed, owner))
    packed, base = packed[order], owner[order] << 32
    a, top = base + (packed >> 32), np.maximum.accumulate(base + (packed & 0xFFFFFFFF))
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] > top[:-1]  # other lists begin beyond all before them
    at = np.flatnonzero(fresh)
    runs = np.stack([a[at] - base[at], top[np.append(at[1:], len(a)) - 1] - base[at]], axis=1) if len(at) else np.zeros((0, 2), np.int64)
    return np.split(runs, np.searchsorted(base[at] >> 32, np.arange(1, len(sizes)))) if len(sizes) else []


def cut(body: bytes, removed: list[tuple[int, int]]) -> bytes:
    """What is left of a body without sorted runs."""
    if not len(removed):
        return body
    edges = [0, *[x for r in removed for x in r], len(body)]
    return b"".join(body[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def whole_characters(body: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their edges, so that UTF-8 stays UTF-8."""
    out = []
    for a, e in removed:
        while a < e and body[a] & 0xC0 == 0x80:
            a += 1
        while e > a and e < len(body) and body[e] & 0xC0 == 0x80:
            e -= 1
        if a < e:
            out.append((a, e))
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in REPORT.split(", ")]
    for batch in batches:
        rows = []
        for ident, body, removed, passages in zip(*(batch.column(k).to_pylist() for k in range(2)), merged(batch.column(2)), merged(batch.column(3)), strict=True):
            n_removed, n_words = (int((r[:, 1] - r[:, 0]).sum()) if len(r) else 0 for r in (removed, passages))
            rows.append((ident, len(body), n_removed, len(removed), hashlib.sha256(cut(body, removed.tolist())).hexdigest(), n_words, len(passages)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, body) of every row."""
    rows = project(df, id=id_col, text=text_col)
    body = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(F.xxhash64("id", body).alias("key"), "id", body.alias("body"))


REPORT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long"


def _both(docs: DataFrame, threshold: int, n_words: int | None) -> DataFrame:
    """(key, spans, passages): repeated strings in bytes and, if asked for, repeated passages in words."""
    found = repeats(docs, threshold)
    if not n_words:
        return found.withColumn("passages", F.lit(None).cast(found.schema["spans"].dataType))
    return found.join(repeats(docs, n_words, WORDS).withColumnRenamed("spans", "passages"), "key", "full")


def report(df: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD, n_words: int | None = None) -> DataFrame:
    """``REPORT`` of every row: what goes by the threshold in bytes, and what passages of so many words would take besides."""
    docs = keyed(df, id_col, text_col)
    joined = docs.join(_both(docs, threshold, n_words), "key", "left").select(F.col("id").cast("long"), "body", "spans", "passages")
    return joined.mapInArrow(_report, REPORT)


def in_bytes(body: bytes, passages: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words as runs of bytes, from the first word's start to the last word's end."""
    start, stop, _ = words(body)
    return [(int(start[a]), int(stop[e - 1])) for a, e in passages]


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a union."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def remove(df: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD, n_words: int | None = None) -> DataFrame:
    """The rows of df, all columns, with repeated strings cut out of the text (whole characters only).

    With n_words, repeated passages of so many words go too, however few bytes they have. Null texts stay null.
    """
    docs = keyed(df, id_col, text_col)
    names = df.columns
    at = names.index(text_col)
    packed = df.select(F.xxhash64(df[id_col], F.coalesce(df[text_col], F.lit("")).cast("binary")).alias("key"), F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    joined = packed.join(_both(docs, threshold, n_words), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, passages in zip(batch.column(1).to_pylist(), merged(batch.column(2)), merged(batch.column(3)), strict=True):
                if len(spans) or len(passages):
                    body = text.encode()
                    gone = union([*map(tuple, spans.tolist()), *(in_bytes(body, passages) if len(passages) else [])])
                    text = cut(body, whole_characters(body, gone)).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    ddl = f"row {joined.schema['row'].dataType.simpleString()}, text string"
    done = joined.select("row", F.col(f"row.c{at}").alias("text"), "spans", "passages").mapInArrow(run, ddl)
    return done.select(*[(F.col("text") if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    return out.drop("n_passage_words", "n_passages")


SQL = rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, (2 * s + 1)::BIGINT, {2 * THRESHOLD})) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {THRESHOLD - 1})) AS s FROM d)),
r AS (SELECT doc_id, s FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {THRESHOLD} THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + {THRESHOLD} AS e FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a FROM runs UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * f + 1)::BIGINT, (CASE WHEN a IS NULL THEN len(h) ELSE 2 * (a - f) END)::BIGINT), '' ORDER BY f) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(e - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
