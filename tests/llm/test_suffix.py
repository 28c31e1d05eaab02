import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symlake.llm import oddsketch, rolling, suffix
from symlake.llm.rolling import Prints


def brute(rows, threshold):
    """Per row (n_bytes, n_removed, n_spans, kept_sha256), by a dictionary of all strings."""
    bodies = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in bodies:
        for s in range(len(b) - threshold + 1):
            k = b[s : s + threshold]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (ident, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - threshold + 1):
            if seen[b[s : s + threshold]] > 1:
                gone[s : s + threshold] = b"\1" * threshold
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((ident, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, threshold=400):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).repartition(3)
    got = [tuple(r)[:5] for r in suffix.report(df, "doc_id", "text", threshold).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, threshold)))
    return got


def prose(rnd, n):
    return "".join(rnd.choice("abcdefgh é") for _ in range(n))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    base, passages = prose(rnd, 3000), [prose(rnd, n) for n in (390, 399, 400, 401, 450, 700)]
    rows = [(0, base), (1, base)]
    for i in range(2, 40):
        t = list(base)
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        rows.append((i, "".join(t)))
    for i in range(40, 80):
        rows.append((i, prose(rnd, rnd.randint(0, 500)) + rnd.choice(passages)[: rnd.randint(300, 700)] + prose(rnd, rnd.randint(0, 500))))
    got = check(spark, rows)
    assert any(0 < r[2] < r[1] for r in got)


def colliding():
    """Two texts of 192 bytes that all prints modulo 2^64 at odd bases take to be equal."""
    factors = [*range(7), *range(6), 0]
    c = np.array([1], np.int64)
    for k in factors:
        x = np.zeros(len(c) + (1 << k), np.int64)
        x[1 << k :] += c
        x[: len(c)] -= c
        c = x
    assert len(c) == 192 and abs(c).max() < 87  # printable from 40 on
    a = np.where(c > 0, c, 0) + 40
    return a.astype(np.uint8).tobytes().decode(), (a - c).astype(np.uint8).tobytes().decode()


def test_colliding_texts(spark):
    rnd = random.Random(9)
    one, other = colliding()
    prints = [Prints(np.frombuffer(x.encode(), np.uint8)).of(np.array([0]), np.array([192]))[0] for x in (one, other)]
    assert one != other and prints[0] == prints[1]
    rows = []
    for k in range(20):
        before, after = prose(rnd, 350)[:300], prose(rnd, 300)[:250]
        rows += [(2 * k, before + one + after), (2 * k + 1, before + other + after)]
    assert all(r[2] == 0 for r in check(spark, rows))
    pair = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert all(r["kept"] for r in oddsketch.groups(pair, "doc_id", "text").collect())


@given(st.lists(st.tuples(st.integers(0, 2**61 - 2), st.integers(0, 2**61 - 2)), min_size=1, max_size=20))
def test_products_modulo_the_prime(pairs):
    a, b = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    assert rolling.product(a, b).tolist() == [x * y % rolling.PRIME for x, y in pairs]


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_prime_prints(monkeypatch, kind):
    monkeypatch.setattr(rolling, "_BLOCK", 64)
    rnd = np.random.default_rng(2)
    buf = rnd.integers(0, np.iinfo(kind).max, 500, dtype=kind, endpoint=True)
    base = rolling.drawn_base()
    prints = rolling.PrimePrints(buf, base)
    start, size = rnd.integers(0, 400, 50), rnd.integers(0, 100, 50)
    want = [sum((int(c) + (kind is np.uint8)) * pow(base, j, rolling.PRIME) for j, c in enumerate(buf[s : s + n])) % rolling.PRIME for s, n in zip(start, size, strict=True)]
    assert prints.of(start, start + size).tolist() == want


def test_repetition_within_one_document(spark):
    rnd = random.Random(6)
    own = prose(rnd, 500)
    check(spark, [(1, "a" * 900), (2, "ab" * 500), (3, own + "!" + own), (4, "abc" * 134), (5, "a" * 399), (6, "z" * 400), (7, "y" * 401)])


def test_edges(spark):
    rnd = random.Random(7)
    t = prose(rnd, 450)
    check(spark, [(1, None), (2, ""), (3, t), (3, t), (None, t), (None, t[:420]), (4, "x")])
    assert suffix.report(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1500)
    rnd = random.Random(8)
    base = prose(rnd, 6000)
    rows = [(0, base), (1, base[:2000] + "?" + base[2000:]), (2, prose(rnd, 900) + base[1000:1600])]
    bodies = [(i, (t or "").encode()) for i, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in bodies], pa.int64()), pa.array([b for _, b in bodies], pa.binary())], ["key", "body"])
    whole = {(r["key"], s) for b in suffix._round_one(iter([batch]), 400, suffix.Run(rolling.drawn_base(), b"salt")) for r in b.to_pylist() for s in range(r["a"], r["b"] + 1)}
    assert whole == {(i, s) for i, b in bodies for s in range(len(b) - 399)}


def test_remove_keeps_columns_and_characters(spark):
    rnd = random.Random(9)
    shared = "é" * 3 + prose(rnd, 420)
    rows = [(1, "A" + shared + "B", "u"), (2, "C" + shared + "D", "v"), (3, "free", "w"), (4, None, None)]
    out = {r["doc_id"]: r for r in suffix.remove(spark.createDataFrame(rows, "doc_id long, text string, c0 string"), "doc_id", "text").collect()}
    assert (out[1]["text"], out[2]["text"], out[3]["text"], out[4]["text"]) == ("AB", "CD", "free", None)
    assert out[1]["c0"] == "u" and out[4]["c0"] is None


@pytest.mark.parametrize("a,e,want", [(0, 3, [(0, 2)]), (1, 4, [(2, 4)]), (1, 2, [])])
def test_whole_characters(a, e, want):
    assert suffix.whole_characters("éé".encode(), [(a, e)]) == want


def test_words_against_brute_force(spark):
    rnd, n = random.Random(10), suffix.WORDS.window + suffix.WORDS.gram + 6
    base = [rnd.choice("abcdefgh") for _ in range(400)]
    rows = [(0, " ".join(base)), (1, "  " + "\n".join(base)), (2, "x " * 90), (3, None), (4, "")]
    for i in range(5, 60):
        t = list(base)
        for _ in range(rnd.randint(1, 20)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        at = rnd.randrange(len(t))
        rows.append((i, " ".join(t[at : at + rnd.randint(0, 120)])))
    seen = {}
    for _, t in rows:
        w = (t or "").split()
        for s in range(len(w) - n + 1):
            seen[tuple(w[s : s + n])] = seen.get(tuple(w[s : s + n]), 0) + 1
    want = {}
    for i, t in rows:
        w = (t or "").split()
        gone = {s + k for s in range(len(w) - n + 1) if seen[tuple(w[s : s + n])] > 1 for k in range(n)}
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"] or "").split() for r in suffix.remove(df, "doc_id", "text", 10**6, n).collect()}
    assert got == want and any(0 < len(got[i]) < len((t or "").split()) for i, t in rows)
