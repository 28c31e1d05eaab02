"""Ranked lexical search over an index whose documents recursive graph bisection has put in order.

Index (``build``): a task takes shards of up to ``SHARD_DOCS`` documents as they lie. The documents of a shard and their terms are a
bipartite graph; it is halved again and again, and each half swaps documents with the other as long as that lowers the
logarithmic gap cost of the terms. The leaves are clusters of up to ``CLUSTER`` documents that share terms. A cluster is a row: its
documents' ids and lengths, its terms in full with the highest count and the shortest document of each, and the postings.
Nothing is shuffled, and no term or document is left out.

Search (``search``), exact: a cluster's bound for a query is the sum over the query's terms of what the highest count would score in the
shortest document. One pass over the clusters' summaries finds each query's ``SEEDS`` clusters of highest bound; scoring these gives
a floor, the k-th best score so far. Then every task visits its clusters in the order of their bounds and stops where a bound is
below the floor or below its own k-th best score; equal bounds are visited, as ties are decided by document ids. The tasks' best are ranked by score and id.

Terms are runs of digits, ASCII letters (lower-cased) and bytes above 7F; a score adds integers only, weights are the floor of a
double. Queries are broadcast in slices of at most ``SLICE`` (query, term) pairs plus one query's; more queries take more passes.

Edge cases: null and empty texts have no terms, count for nothing and are never found; rows that repeat are documents of their own;
a null id loses ties; queries without known terms find nothing; rows of one query id are one query (a null one too); terms that
all documents have may weigh 0, and scores of 0 are not returned; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.common import discard, materialize, project, table
from symlake.llm.decontam import _WORD

K = 10
SHARD_DOCS, SHARD_BYTES, CLUSTER, ROUNDS = 2048, 16 << 20, 64, 8
#: Clusters scored for the floor, clusters that a task holds at a time, those of a row group, (query, term) pairs in a broadcast.
SEEDS, HELD, ROW_GROUP, SLICE = 4, 64, 16, 1 << 18

CLUSTERS = "cluster string, ids array<long>, lengths array<int>, terms array<binary>, top_tf array<int>, low_n array<int>, edges array<int>, docs array<smallint>, tfs array<int>"
_TYPES = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int16()), pa.list_(pa.int32())]
_NAMES = [c.split()[0] for c in CLUSTERS.split(", ")]


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """(text, number of the term) of every term's occurrence, and the distinct terms."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    inside = _WORD[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    every = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    encoded = every.dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, start, side="right"), encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    """Bits for the gaps of terms that d of n documents have."""
    return d * np.log2(n / (d + 1.0))


def bisected(doc: np.ndarray, term: np.ndarray, n: int, cluster: int = CLUSTER, rounds: int = ROUNDS) -> np.ndarray:
    """An order of n documents in which those that share terms are near; doc is ascending."""
    if n <= cluster:
        return np.arange(n)
    # A term in one document alone costs the same wherever that is.
    _, term, df = np.unique(term, return_inverse=True, return_counts=True)
    keep = df[term] > 1
    doc, term = doc[keep], term[keep]
    size = len(df)
    n_left = cluster * ((n + cluster - 1) // cluster // 2) if n > cluster else n
    n_left = max(min(n_left, n - 1), 1)
    right = np.arange(n) >= n_left
    for _ in range(rounds):
        on_right = right[doc]
        dr = np.bincount(term[on_right], minlength=size).astype(float)
        dl = np.bincount(term[~on_right], minlength=size).astype(float)
        now = _cost(dl, n_left) + _cost(dr, n - n_left)
        to_right = now - _cost(np.maximum(dl - 1, 0), n_left) - _cost(dr + 1, n - n_left)
        to_left = now - _cost(dl + 1, n_left) - _cost(np.maximum(dr - 1, 0), n - n_left)
        gain = np.bincount(doc, weights=np.where(on_right, to_left[term], to_right[term]), minlength=n)
        left_docs, right_docs = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = left_docs[np.argsort(-gain[left_docs], kind="stable")], right_docs[np.argsort(-gain[right_docs], kind="stable")]
        m = min(len(a), len(b))
        swap = int(np.argmin(np.append(gain[a[:m]] + gain[b[:m]] > 1e-9, False)))
        if not swap:
            break
        right[a[:swap]], right[b[:swap]] = True, False
    out = []
    for side in (~right, right):
        own = np.flatnonzero(side)
        place = np.cumsum(side) - 1
        mine = side[doc]
        out.append(own[bisected(place[doc[mine]], term[mine], len(own), cluster, rounds)])
    return np.concatenate(out)


def clusters_of(ids: list[int | None], texts: list[bytes], name: str, cluster: int = CLUSTER) -> pa.RecordBatch:
    """The clusters of a shard."""
    doc, term, words = terms_of(texts)
    n = len(texts)
    lengths = np.bincount(doc, minlength=n)
    pair, tf = np.unique(doc * (len(words) + 1) + term, return_counts=True)
    doc, term = pair // (len(words) + 1), pair % (len(words) + 1)
    order = bisected(doc, term, n, cluster)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by = np.lexsort((place[doc], term, place[doc] // cluster))
    at, term, tf = place[doc][by], term[by], tf[by]
    edges = np.searchsorted(at // cluster, np.arange((n + cluster - 1) // cluster + 1))
    rows = []
    for c in range(len(edges) - 1):
        own = order[c * cluster : (c + 1) * cluster]
        t, p, f = term[edges[c] : edges[c + 1]], at[edges[c] : edges[c + 1]] - c * cluster, tf[edges[c] : edges[c + 1]]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(f, first) if len(first) else first
        low = np.minimum.reduceat(lengths[own][p], first) if len(first) else first
        rows.append((f"{name}-{c}", [ids[k] for k in own], lengths[own], words.take(pa.array(t[first])).to_pylist(), top, low, np.append(first, len(t)), p.astype(np.int16), f))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _index(batches: Iterator[pa.RecordBatch], cluster: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ids: list[int | None] = []
    texts: list[bytes] = []
    size, shard, task = 0, 0, TaskContext.get().partitionId()
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = text.as_buffer().to_pybytes()
            if texts and (len(texts) == SHARD_DOCS or size + len(body) > SHARD_BYTES):
                yield clusters_of(ids, texts, f"{task}-{shard}", cluster)
                ids, texts, size, shard = [], [], 0, shard + 1
            ids.append(ident)
            texts.append(body)
            size += len(body)
    if texts:
        yield clusters_of(ids, texts, f"{task}-{shard}", cluster)


def build(df: DataFrame, id_col: str, text_col: str, cluster: int = CLUSTER) -> DataFrame:
    """``CLUSTERS``, the index of all rows, as a written table; its row groups are small, so that a task's memory doesn't grow with its part of the table."""
    rows = project(df, id=df[id_col].cast("long"), body=F.coalesce(df[text_col], F.lit("")).cast("binary"))
    return materialize(rows.mapInArrow(lambda b: _index(b, cluster), CLUSTERS), "clusters", group=ROW_GROUP)


class Queries:
    """A slice of queries: (query number, term) pairs by query, with the terms' weights and the corpus's size."""

    def __init__(self, pairs: list[tuple[int, bytes]], df: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        known = sorted({t for _, t in pairs if t in df})
        self.number = {t: k for k, t in enumerate(known)}
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in known], np.int64)
        own = sorted((q, self.number[t]) for q, t in set(pairs) if t in df)
        self.query, self.starts = np.unique(np.array([q for q, _ in own], np.int64), return_index=True)
        self.term = np.array([t for _, t in own], np.int64)
        self.ends = np.append(self.starts[1:], len(own))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """What a document of n terms adds to the divisor; exact also where products pass 64 bits."""
        top = int(n.max(initial=0))
        if 90 * top * self.n_docs < 1 << 63:
            return 10 + 90 * n.astype(np.int64) * self.n_docs // max(1, self.n_terms)
        return np.array([10 + 90 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)

    def impact(self, number: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return self.weight[number] * (1_000_000_000 * tf // (1000 * tf + 8 * self.lengths(n)))

    def known(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in terms, number) of the terms that queries have."""
        number = self.number
        hits = [(k, number[t]) for k, t in enumerate(terms.to_pylist()) if t in number]
        both = np.array(hits, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def bounds(self, terms: pa.Array, top_tf: np.ndarray, low_n: np.ndarray) -> np.ndarray:
        """The highest score that any document of a cluster can have, by query."""
        at, number = self.known(terms)
        most = np.zeros(len(self.weight), np.int64)
        most[number] = self.impact(number, top_tf[at], low_n[at])
        return np.add.reduceat(most[self.term], self.starts) if len(self.term) else np.zeros(0, np.int64)


class Best:
    """The best (score, id) pairs of each query so far."""

    def __init__(self, queries: Queries, k: int, floors: dict[int, int]) -> None:
        self.k, self.heaps = k, [[] for _ in queries.query]
        self.floor = np.array([floors.get(int(q), 1) for q in queries.query], np.int64)

    def offer(self, q: int, scores: np.ndarray, ids: list[int | None]) -> None:
        heap = self.heaps[q]
        for d in np.flatnonzero(scores >= self.floor[q]).tolist():
            entry = (int(scores[d]), -(1 << 64) if ids[d] is None else -ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.floor[q] = max(self.floor[q], heap[0][0])


class Cluster(NamedTuple):
    ids: list[int | None]
    rows: np.ndarray  # of impacts, by known term and document; the last row is of zeros
    row_of: np.ndarray


def _opened(batch: pa.RecordBatch, k: int, queries: Queries) -> Cluster:
    """A cluster's impacts for the terms that queries have."""
    col = lambda name: batch.column(name)[k].values
    number_of = lambda name: col(name).to_numpy(zero_copy_only=False)
    at, number = queries.known(col("terms"))
    edges, docs, tfs, lengths = (number_of(c) for c in ("edges", "docs", "tfs", "lengths"))
    many = edges[at + 1] - edges[at]
    place = np.repeat(edges[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    row = np.repeat(np.arange(len(at)), many)
    rows = np.zeros((len(at) + 1, len(lengths)), np.int64)
    rows[row, docs[place]] = queries.impact(number[row], tfs[place], lengths[docs[place]])
    row_of = np.full(len(queries.weight), len(at), np.int64)
    row_of[number] = np.arange(len(at))
    return Cluster(col("ids").to_pylist(), rows, row_of)


def visit(batch: pa.RecordBatch, queries: Queries, best: Best) -> int:
    """Score a batch's clusters for each query in the order of their bounds until none can matter; the number of scorings."""
    summary = lambda k, name: batch.column(name)[k].values
    bounds = np.stack([queries.bounds(summary(k, "terms"), *(summary(k, c).to_numpy(zero_copy_only=False) for c in ("top_tf", "low_n"))) for k in range(batch.num_rows)])
    order = np.argsort(-bounds, axis=0, kind="stable")
    opened: dict[int, Cluster] = {}
    scored = 0
    for nth in order:
        going = np.flatnonzero(bounds[nth, np.arange(len(nth))] >= best.floor)
        if not len(going):
            break
        for c in np.unique(nth[going]).tolist():
            own = opened.get(c)
            if own is None:
                own = opened[c] = _opened(batch, c, queries)
            for q in going[nth[going] == c].tolist():
                best.offer(q, own.rows[own.row_of[queries.term[queries.starts[q] : queries.ends[q]]]].sum(axis=0), own.ids)
                scored += 1
    return scored


def _frequencies(batches: Iterator[pa.RecordBatch], terms: Broadcast) -> Iterator[pa.RecordBatch]:
    known = {t: k for k, t in enumerate(terms.value)}
    counts = np.zeros(len(known), np.int64)
    for batch in batches:
        for words, edges in zip(batch.column("terms"), batch.column("edges"), strict=True):  # one cluster's terms at a time
            df = np.diff(edges.values.to_numpy())
            hits = [(k, known[t]) for k, t in enumerate(words.values.to_pylist()) if t in known]
            if hits:
                at, number = np.array(hits, np.int64).T
                counts[number] += df[at]
    found = np.flatnonzero(counts)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array([terms.value[k] for k in found], pa.binary()), pa.array(counts[found])], ["term", "df"])


def _bounds(batches: Iterator[pa.RecordBatch], queries: Broadcast, seeds: int) -> Iterator[pa.RecordBatch]:
    own = queries.value
    heaps: list[list[tuple[int, str]]] = [[] for _ in own.query]
    low = np.zeros(len(heaps), np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            name = batch.column("cluster")[k].as_py()
            bounds = own.bounds(batch.column("terms")[k].values, *(batch.column(c)[k].values.to_numpy() for c in ("top_tf", "low_n")))
            for q in np.flatnonzero(bounds > low).tolist():
                heapq.heappush(heaps[q], (int(bounds[q]), name))
                if len(heaps[q]) > seeds:
                    heapq.heappop(heaps[q])
                    low[q] = heaps[q][0][0]
    rows = [(int(own.query[q]), b, name) for q, heap in enumerate(heaps) for b, name in heap]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["q", "bound", "cluster"])


def _visits(batches: Iterator[pa.RecordBatch], queries: Broadcast, floors: dict[int, int], k: int) -> Iterator[pa.RecordBatch]:
    own = queries.value
    best = Best(own, k, floors)
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            visit(batch.slice(at, HELD), own, best)
    rows = [(int(own.query[q]), None if ident == -(1 << 64) else -ident, score) for q, heap in enumerate(best.heaps) for score, ident in heap]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["q", "doc_id", "score"])


FOUND = "q long, doc_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, q, term): the distinct terms of each query; q stands for the item and is never null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            if texts:
                row, term, words = terms_of(texts)
                pair = np.unique(row * (len(words) + 1) + term)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // (len(words) + 1))), words.take(pa.array(pair % (len(words) + 1)))], ["item", "term"])

    kind = queries.schema[id_col].dataType.simpleString()
    rows = project(queries, item=id_col, body=F.coalesce(queries[text_col], F.lit("")).cast("binary"))
    return rows.mapInArrow(run, f"item {kind}, term binary").distinct().select("item", F.xxhash64(F.col("item").isNull(), "item").alias("q"), "term")


def search(clusters: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = K, bound: int = SLICE, seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents of an index of ``build``."""
    spark = clusters.sparkSession
    asked = materialize(query_terms(queries, id_col, text_col), "queries")
    sizes = asked.groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))
    pairs, longest, clash = sizes.agg(F.sum("n"), F.max("n"), F.max("items")).first()
    if (clash or 0) > 1:
        raise ValueError("two queries have one 64-bit number")
    total = clusters.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    parts = 1 if (pairs or 0) <= bound else math.ceil(2 * pairs / bound)
    out = None
    for part in range(parts):
        rows = asked.where(F.pmod("q", F.lit(parts)) == part).select("q", "term").limit(bound + (longest or 0) + 1).collect()  # bounded by the slice
        if len(rows) > bound + (longest or 0):
            raise ValueError("a slice of queries is larger than its bound")
        terms = spark.sparkContext.broadcast(sorted({bytes(r["term"]) for r in rows}))
        counted = clusters.select("terms", "edges").mapInArrow(lambda b, t=terms: _frequencies(b, t), "term binary, df long")
        df = {bytes(r["term"]): r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a slice's terms at most
        own = spark.sparkContext.broadcast(Queries([(r["q"], bytes(r["term"])) for r in rows], df, n_docs, n_terms))
        bests = clusters.select("cluster", "terms", "top_tf", "low_n").mapInArrow(lambda b, q=own: _bounds(b, q, seeds), "q long, bound long, cluster string")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "cluster")
        chosen = bests.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= seeds).select("cluster").distinct()
        # At most SEEDS names a query, and queries are bounded by the slice.
        first = _ranked(clusters.join(F.broadcast(chosen), "cluster", "left_semi").mapInArrow(lambda b, q=own: _visits(b, q, {}, k), FOUND), k)
        floors = {r["q"]: r["score"] for r in first.where(F.col("rank") == k).select("q", "score").collect()}  # one number a query
        found = clusters.mapInArrow(lambda b, q=own, f=floors: _visits(b, q, f, k), FOUND)
        out = found if out is None else out.unionByName(found)
    names = asked.select("q", F.col("item").alias("item_id")).distinct()
    return _ranked(out, k).join(names, "q").select("item_id", "rank", "doc_id", "score")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = build(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = materialize(search(clusters, table(spark, sf_dir, "benchmark"), "item_id", "text"), "ranked")
    discard(clusters)
    return out


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark)),
p AS (SELECT doc_id, len(ts)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, c.n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * c.n) // c.l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
