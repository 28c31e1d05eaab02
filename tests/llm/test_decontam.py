"""Decontamination against brute force, and its edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from symlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = tokens(text)
        n = min(decontam.N, len(ws))
        for i in range(len(ws) - n + 1) if n else []:
            windows.setdefault(tuple(ws[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for ident, text in docs:
        ws, hit, found = tokens(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                own = windows.get(tuple(ws[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((ident, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def sample():
    rnd = random.Random(5)
    vocabulary = ["Alpha", "beta", "gamma9", "ünï", "日本", "delta", "x", "y", "Z"]
    line = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--", "  "]) for _ in range(n))
    items = [(k, line(rnd.choice([12, 15, 30]))) for k in range(12)] + [(12, "Rare singleton"), (13, ""), (14, None), (None, "null id word window"), (3, "second row of item three is one more window ok")]
    docs = []
    for k in range(60):
        parts = [line(rnd.randrange(0, 40))]
        if k % 3 == 0:
            parts.append(rnd.choice(items)[1] or "")
        if k % 7 == 0:
            parts.append("rare\tSINGLETON, null ID word-window")
        docs.append((k, " ; ".join([*parts, line(rnd.randrange(0, 9))])))
    return docs + [(100, None), (101, ""), (102, "?!"), (None, items[0][1]), (3, docs[3][1]), (3, docs[3][1])], items


def tables(spark, docs, items):
    extra = [F.lit(1).alias(c) for c in ("body", "digest", "runs", "items", "n_words", "row", "id")]
    return spark.createDataFrame(docs, "doc_id long, text string").select("*", *extra), spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(2).alias("window"))


@pytest.mark.parametrize("bound", [decontam.SLICE, 40])
def test_report_is_like_brute_force(spark, bound):
    docs, items = sample()
    d, b = tables(spark, docs, items)
    got = decontam.report(d, "doc_id", "text", b, "item_id", "text", bound)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(docs, items)))


def test_chunks_overlap(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK", 17)
    docs, items = sample()
    rows = [(w, "" if i is None else str(i)) for i, t in items for w in decontam.windows_of(t)]
    known = decontam.Windows(sorted(set(rows)))
    for (ident, text), want in zip(docs, brute(docs, items), strict=True):
        n, runs, own = known.find((text or "").encode().lower())
        assert (n, int((runs[:, 1] - runs[:, 0]).sum()), len(own)) == want[1:4], ident


def test_remove(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Ü keep this. {item.upper()}! and this"), (2, "clean"), (3, None), (4, item), (5, "one two three four five six seven eight nine")]
    d, b = tables(spark, docs, [(1, item)])
    for bound in (decontam.SLICE, 1):
        cut = decontam.remove(d, "doc_id", "text", b, "item_id", "text", bound=bound)
        assert cut.columns == d.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Ü keep this. ! and this", 2: "clean", 3: None, 4: "", 5: docs[4][1]}
        left = decontam.remove(d, "doc_id", "text", b, "item_id", "text", drop_from=0.9, bound=bound)
        assert {r["doc_id"]: r["text"] for r in left.collect()} == {k: t for k, t in docs if k != 4}


def test_empty_tables(spark):
    d, b = tables(spark, *sample())
    none = b.where("false")
    assert decontam.report(d.where("false"), "doc_id", "text", b, "item_id", "text").count() == 0
    out = decontam.report(d, "doc_id", "text", none, "item_id", "text")
    assert out.count() == d.count() and out.where("contaminated OR n_items > 0").count() == 0


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(14))
    text = " ".join(f"n{i}" for i in range(400_000)) + " " + item + " tail " + "q" * 3_000_000
    d, b = tables(spark, [(1, text)], [(7, item)])
    r = decontam.report(d, "doc_id", "text", b, "item_id", "text").first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (400_016, 14, 1)
