"""Collocations against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symlake.llm import collocation

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, floor, top, cover):
    f, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < floor or any(len(q) > len(p) and c >= floor and 100 * c >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in own.items()):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, lf, r, total[lang], -s) for rank, (s, a, p, lf, r) in enumerate(sorted(found)[:top], 1)]
    return out


def sample():
    rnd = random.Random(3)
    vocabulary = ["New", "york", "city", "ünï", "日本", "of", "the", "a\x00b", "x-y"]
    text = lambda: "".join(rnd.choices(vocabulary, [5, 5, 3, 2, 1, 4, 6, 1, 1])[0] + rnd.choice([" ", "\t", "  ", " ", ", ", ".\n", "?"]) for _ in range(rnd.randrange(60)))
    docs = [(text(), rnd.choice(["en", "fr", None])) for _ in range(150)]
    return docs + [(None, "en"), ("", None), ("lone", "de"), (" \t", "xx"), *[("new york stock exchange", "en")] * 30]


def frame(spark, docs, parts=4):
    return spark.createDataFrame(docs, "text string, lang string").repartition(parts).select("*", *[F.lit(1).alias(c) for c in ("phrase", "path", "run", "f", "w1", "body", "rank")])


@pytest.mark.parametrize(("shard", "fan"), [(collocation.SHARD, collocation.FAN), (300, 3)])
def test_mine_is_like_brute_force(spark, monkeypatch, shard, fan):
    monkeypatch.setattr(collocation, "SHARD", shard)
    monkeypatch.setattr(collocation, "RANGES", 4)
    docs = sample()
    got = collocation.mine(frame(spark, docs), "text", "lang", floor=4, top=12, fan=fan)
    want = brute(docs, 4, 12, collocation.COVER)
    assert len(want) > 25 and sorted(map(tuple, got.collect())) == sorted(want)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocation, "SHARD", 40)
    text = ("one two. three four five, " * 9 + "z " * 60 + ". end here").encode()
    parts = list(collocation._whole_pieces(text))
    assert b"".join(parts) == text and len(parts) > 5
    whole, merged = collocation.count(text), collocation.merge([collocation.dump(collocation.count(p)) for p in parts])
    assert whole.words.equals(merged.words) and (whole.paths == merged.paths).all() and (whole.counts == merged.counts).all()


def test_wide_vocabularies():
    """Ranks that three of which don't fit into a word, by the same result as narrow ones."""
    rnd = random.Random(1)
    import numpy as np

    paths = np.array([[rnd.randrange(3) for _ in range(3)] for _ in range(200)], np.int32)
    ones = np.ones(200, np.int64)
    narrow, wide = collocation.tally(paths, ones), collocation.tally(paths * (1 << 22), ones)
    assert (narrow[0] * (1 << 22) == wide[0]).all() and (narrow[1] == wide[1]).all()


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", None, None, None, 9 * big), ("en", "a", None, None, 2 * big), ("en", "b", None, None, 3 * big), ("en", "a", "b", None, big)]
    out = collocation.scored(spark.createDataFrame(rows, collocation.NODES)).collect()
    assert [tuple(r) for r in out] == [("en", "a b", big, 2 * big, 3 * big, 166666)]


def test_empty(spark):
    none = frame(spark, [("few words only", "en")])
    assert collocation.mine(none, "text", "lang").count() == 0
    assert collocation.mine(none.where("false"), "text", "lang").count() == 0
