"""Ranked search against brute force, the order of documents, and the edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from symlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    bags = [(ident, Counter(TERM.findall((text or "").translate(LOWER)))) for ident, text in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        found = []
        for ident, bag in bags:
            n = sum(bag.values())
            m = 10 + 90 * n * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                found.append((-score, ident is None, ident))
        out += [(item, rank, ident, -s) for rank, (s, _, ident) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def sample(n=400):
    rnd = random.Random(11)
    topics = [[f"{chr(97 + t)}{k}" for k in range(30)] for t in range(8)]
    text = lambda: " ".join(rnd.choices(rnd.choice(topics), k=rnd.randrange(1, 40)) + rnd.choices(["The", "of", "ünï"], k=3))
    docs = [(k, text()) for k in range(n)] + [(1000, None), (1001, ""), (1002, "?! ..."), (None, "a1 a2 a3"), (7, "a1 a2 a3"), (7, "a1 a2 a3"), (2000, "a1 a2 a3 " * 3000)]
    items = [(k, text()) for k in range(20)] + [(30, None), (31, "unknownterm"), (None, "A1 a2 zzz"), (3, "b1 b2 more of item three"), (33, "the of")]
    return docs, items


def frames(spark, docs, items):
    extra = [F.lit(1).alias(c) for c in ("id", "body", "q", "term", "score", "rank", "cluster", "item")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("*", *extra), spark.createDataFrame(items, "item_id long, text string").select("*", *extra[:6])


@pytest.mark.parametrize(("cluster", "bound", "k"), [(lexical.CLUSTER, lexical.SLICE, 10), (8, 40, 3), (5, lexical.SLICE, 400)])
def test_search_is_like_brute_force(spark, monkeypatch, cluster, bound, k):
    monkeypatch.setattr(lexical, "HELD", 5)
    docs, items = sample()
    d, b = frames(spark, docs, items)
    got = lexical.search(lexical.build(d, "doc_id", "text", cluster), b, "item_id", "text", k, bound)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_bisection_brings_topics_together_and_visits_few_clusters():
    docs, _ = sample(512)
    docs = docs[:512]
    ids, texts = [i for i, _ in docs], [t.encode() for _, t in docs]
    doc, term, words = lexical.terms_of(texts)
    pair = np.unique(doc * (len(words) + 1) + term)
    order = lexical.bisected(pair // (len(words) + 1), pair % (len(words) + 1), 512, 16)
    assert sorted(order) == list(range(512))
    topic = [re.search("[a-h][0-9]", t)[0][0] for _, t in docs]
    same = lambda o: sum(topic[a] == topic[b] for a, b in zip(o, o[1:], strict=False))
    assert same(order) > 2.5 * same(range(512))
    batch = lexical.clusters_of(ids, texts, "x", 16)
    df = Counter(t for text in texts for t in set(TERM.findall(text.decode().translate(LOWER))))
    queries = lexical.Queries([(1, b"a1"), (1, b"a2"), (1, b"a3")], {k.encode(): v for k, v in df.items()}, 512, sum(len(t.split()) for t in texts))
    assert lexical.visit(batch, queries, lexical.Best(queries, 3, {})) < batch.num_rows / 2


def test_lengths_beyond_64_bits():
    queries = lexical.Queries([(1, b"a")], {b"a": 3}, 10**13, 10**15)
    n = np.array([1, 10**7], np.int64)
    assert queries.lengths(n).tolist() == [10 + 90 * int(x) * 10**13 // 10**15 for x in n]


def test_empty(spark):
    d, b = frames(spark, *sample(20))
    assert lexical.search(lexical.build(d.where("false"), "doc_id", "text"), b, "item_id", "text").count() == 0
    assert lexical.search(lexical.build(d, "doc_id", "text"), b.where("false"), "item_id", "text").count() == 0


def test_row_groups_of_the_index_are_small(spark):
    docs, _ = sample(200)
    clusters = lexical.build(spark.createDataFrame(docs, "d long, t string").coalesce(1), "d", "t", cluster=4)
    paths = [p.removeprefix("file://") for p in clusters.inputFiles()]
    groups = [f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, paths) for k in range(f.num_row_groups)]
    assert sum(groups) == 52 and max(groups) <= lexical.ROW_GROUP
