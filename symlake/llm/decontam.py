"""Benchmark decontamination: find and remove what documents share with test items.

1. The items' windows (``N`` consecutive words; a shorter item is one window) are made on executors, distinct by item.
2. They are dealt into slices of at most ``SLICE`` rows, and each slice is broadcast as a hash set of normalised n-grams. One
   slice is the rule; a larger benchmark takes more passes over the documents, never a larger broadcast.
3. A task scans all windows of whole texts: a rolling hash of word hashes asks a bitmap, the few windows that pass are
   compared byte for byte with the set. Words inside a verified window are hit; hit words in a row are one span.
4. ``remove`` cuts the spans out of the texts, or drops documents by the share of their words that are hit.

Texts are lower-cased in A-Z only; words are runs of digits, letters and bytes above 7F. Documents never leave their
partition unless there are several slices; then the hits, which are found once for each distinct text, are joined back by the text's digest.

Edge cases: null and empty texts have no words and are never hit; items without words have no windows; rows of items that
share an id are one item, and a null id reads as ''; rows that repeat each other are reported one by one; a very long text is
scanned in chunks of ``CHUNK`` bytes that overlap by a window; an empty benchmark hits nothing; extra columns are kept by ``remove``
and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import discard, materialize, project, table
from symlake.llm.rolling import U64, Prints, mix

N = 10
#: (window, item) rows in one broadcast; a row is a window's text and an item's id.
SLICE = 1 << 18
CHUNK = (1 << 20) - 8
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(N)], np.uint64)

RUNS = "n_words long, runs array<long>, items array<string>"


class Words(NamedTuple):
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray


def chunks(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) parts of a text that end between words."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n and _WORD[text[end - 1]] and _WORD[text[end]]:  # a word goes on: it stays whole
            step = np.frombuffer(text, np.uint8, min(n - end, CHUNK), end)
            rest = np.flatnonzero(~_WORD[step])
            end += int(rest[0]) if len(rest) else len(step)
        yield at, text[at:end]
        at = end


def words(lowered: bytes) -> Words:
    data = np.frombuffer(lowered, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(start, stop, mix(Prints(data).of(start, stop) + (stop - start).astype(U64)) if len(start) else np.zeros(0, U64))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(hashes) - n + 1)
    total = np.zeros(m, U64)
    for k in range(n):
        total += hashes[k : k + m] * _POWERS[k]
    return mix(total + U64(n))


def windows_of(text: str | None) -> set[bytes]:
    """The normalised windows of an item."""
    lowered = (text or "").encode().lower()
    own: list[bytes] = []
    for _, part in chunks(lowered):
        w = words(part)
        own += [part[a:b] for a, b in zip(w.start.tolist(), w.stop.tolist(), strict=True)]
    n = min(N, len(own))
    return {b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


class Windows:
    """A slice of windows: exact texts with their items, and bitmaps of their hashes by length."""

    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        names = sorted({item for _, item in rows})
        index = {item: k for k, item in enumerate(names)}
        self.items, self.known = names, {}
        for text, item in rows:
            self.known.setdefault(text, []).append(index[item])
        by_length: dict[int, list[np.ndarray]] = {}
        for text in self.known:
            own = words(text).hash
            by_length.setdefault(len(own), []).append(window_hashes(own, len(own)))
        self.maps: dict[int, np.ndarray] = {}
        for n, hashes in by_length.items():
            bitmap = np.zeros(1 << max(16, (64 * len(hashes)).bit_length()), bool)
            bitmap[(np.concatenate(hashes) & U64(len(bitmap) - 1)).astype(np.int64)] = True
            self.maps[n] = bitmap

    def find(self, text: bytes) -> tuple[int, np.ndarray, set[int]]:
        """(number of words, runs of hit words as rows (first word, word after, first byte, byte after), items)."""
        found: set[int] = set()
        runs: list[np.ndarray] = []
        seen, tail = 0, Words(*[np.zeros(0, np.int64)] * 2, np.zeros(0, U64))
        for at, part in chunks(text):
            own = words(part)
            w = Words(*(np.concatenate([a, b]) for a, b in zip(tail, (own.start + at, own.stop + at, own.hash), strict=True)))
            first = seen - len(tail.start)
            hit = np.zeros(len(w.start) + 1, np.int32)
            for n, bitmap in self.maps.items():
                asked = window_hashes(w.hash, n)
                for i in np.flatnonzero(bitmap[(asked & U64(len(bitmap) - 1)).astype(np.int64)]).tolist():
                    key = b" ".join([text[a:b] for a, b in zip(w.start[i : i + n].tolist(), w.stop[i : i + n].tolist(), strict=True)])
                    items = self.known.get(key)
                    if items is not None:
                        found.update(items)
                        hit[i] += 1
                        hit[i + n] -= 1
            on = np.diff(np.concatenate([[0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]]))
            a, e = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
            if len(a):
                runs.append(np.stack([a + first, e + first, w.start[a], w.stop[e - 1]], axis=1))
            seen += len(own.start)
            tail = Words(*(x[max(0, len(x) - N + 1) :] for x in w))
        return seen, union(np.concatenate(runs) if runs else np.zeros((0, 4), np.int64)), found


def union(runs: np.ndarray) -> np.ndarray:
    """Maximal runs of words; those that touch are one."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    top = np.maximum.accumulate(runs[:, 1])
    at = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > top[:-1]]))
    return np.stack([runs[at, 0], np.maximum.reduceat(runs[:, 1], at), runs[at, 2], np.maximum.reduceat(runs[:, 3], at)], axis=1)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(window binary, item string), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, item) for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in windows_of(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], ["window", "item"])

    rows = project(benchmark, item=F.coalesce(benchmark[id_col].cast("string"), F.lit("")), text=text_col)
    return rows.mapInArrow(run, "window binary, item string").distinct()


def slices(benchmark: DataFrame, id_col: str, text_col: str, bound: int = SLICE) -> list[Broadcast]:
    """The benchmark's windows as broadcasts of at most so many (window, item) rows each."""
    spark = benchmark.sparkSession
    rows = materialize(item_windows(benchmark, id_col, text_col), "windows")
    n = rows.count()
    parts = 1 if n <= bound else math.ceil(2 * n / bound)
    out = []
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k)
        held = own.limit(bound + 1).collect()  # bounded by the slice
        if len(held) > bound:
            raise ValueError("a slice of windows is larger than its bound")
        out.append(spark.sparkContext.broadcast([(bytes(r["window"]), r["item"]) for r in held]))
    discard(rows)
    return out


def _scan(batches: Iterator[pa.RecordBatch], part: Broadcast, only_hits: bool) -> Iterator[pa.RecordBatch]:
    """The batch's columns but body, which comes first, with ``RUNS``."""
    known = Windows(part.value)
    for batch in batches:
        counts, runs, items, hit = [], [], [], []
        for text in batch.column(0):
            n, found, own = known.find(text.as_buffer().to_pybytes().lower()) if text.is_valid else (0, np.zeros((0, 4), np.int64), set())
            hit.append(bool(own))
            counts.append(n)
            runs.append(found.ravel())
            items.append([known.items[k] for k in sorted(own)])
        out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[1:], "n_words", "runs", "items"])
        yield out.filter(pa.array(hit, pa.bool_())) if only_hits else out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def marked(rows: DataFrame, parts: list[Broadcast]) -> DataFrame:
    """rows (body binary, ...) without body and with ``RUNS``: runs are groups of four numbers, those of one text maximal."""
    if len(parts) == 1:
        return rows.mapInArrow(lambda b, p=parts[0]: _scan(b, p, False), f"{_ddl(rows.drop('body'))}, {RUNS}")
    keyed = rows.withColumn("digest", F.sha2("body", 256))
    texts = keyed.select("body", "digest")
    first = keyed.mapInArrow(lambda b: _scan(b, parts[0], False), f"{_ddl(keyed.drop('body'))}, {RUNS}")
    more = None
    for k, part in enumerate(parts[1:], 1):
        own = texts.mapInArrow(lambda b, p=part: _scan(b, p, True), f"digest string, {RUNS}").withColumn("slice", F.lit(k))
        more = own if more is None else more.unionByName(own)
    # Equal texts have equal hits, so that a text counts once for each slice, however often it comes.
    once = more.groupBy("digest", "slice").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))
    found = materialize(once.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("more_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items")), "hits")
    joined = first.join(found, "digest", "left")
    both = {"runs": F.concat("runs", F.coalesce("more_runs", F.array().cast("array<long>"))), "items": F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>")))}
    return joined.withColumns(both).drop("digest", "more_runs", "more_items")


REPORT = "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for ident, n, runs, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r = union(np.array(runs, np.int64).reshape(-1, 4))
            hit = int((r[:, 1] - r[:, 0]).sum())
            rows.append((ident, n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string(), pa.bool_()), strict=True)], [x.split()[0] for x in REPORT.split(", ")])


def report(df: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, bound: int = SLICE) -> DataFrame:
    """``REPORT`` of every row."""
    rows = project(df, body=F.coalesce(df[text_col], F.lit("")).cast("binary"), id=df[id_col].cast("long"))
    return marked(rows, slices(benchmark, item_col, item_text, bound)).select("id", "n_words", "runs", "items").mapInArrow(_report, REPORT)


def remove(df: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, drop_from: float | None = None, bound: int = SLICE) -> DataFrame:
    """The rows of df, all columns, with hit spans cut out of the text.

    With drop_from, documents of which at least this share of words is hit go, and the others stay as they are.
    """
    names = df.columns
    at = names.index(text_col)
    packed = df.select(F.coalesce(df[text_col], F.lit("")).cast("binary").alias("body"), F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    found = marked(packed, slices(benchmark, item_col, item_text, bound))
    texts = found.select("row", F.col(f"row.c{at}").alias("text"), "n_words", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kept = [], []
            for text, n, runs in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                r = union(np.array(runs, np.int64).reshape(-1, 4))
                hit = int((r[:, 1] - r[:, 0]).sum())
                kept.append(drop_from is None or not hit or hit < drop_from * n)
                if hit and drop_from is None:
                    body = text.encode()
                    edges = [0, *r[:, 2:].ravel().tolist(), len(body)]
                    text = b"".join(body[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"]).filter(pa.array(kept, pa.bool_()))

    done = texts.mapInArrow(run, f"row {texts.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[(F.col("text") if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return out.withColumnRenamed("id", "doc_id")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS_SQL} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least({N}, len(ws)) AS n, array_to_string(ws[i:i + least({N}, len(ws)) - 1], ' ') AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {N - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
o AS (SELECT doc_id, i, dw.n, item FROM dw JOIN iw USING (w)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
