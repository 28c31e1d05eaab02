import random
import re

import numpy as np
from pyspark.sql import functions as F

from symlake.llm import oddsketch


def brute(rows):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            low[find(i)] = min(low.get(find(i), ident), ident)
    return sorted((str(r[0]), len(sets[i]), str(low.get(find(i)))) for i, r in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    out = oddsketch.groups(df, "doc_id", "text").collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in out)
    return out


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, ident = [], 100
    for _ in range(25):
        base = rnd.choices(vocabulary, k=rnd.randint(5, 300))
        for _ in range(rnd.randint(1, 12)):
            rows.append((ident, edited(rnd, base, rnd.randint(0, max(1, len(base) // 20)))))
            ident += rnd.randint(1, 3)
    rnd.shuffle(rows)
    out = check(spark, rows)
    assert len({r["component_id"] for r in out}) < len(rows) - 50


def test_chains_and_large_groups(spark):
    rnd = random.Random(4)
    words = [f"c{i}" for i in range(200)]
    chain = [(1000 + i, " ".join(words[3 * i : 3 * i + 100])) for i in range(34)]
    base = rnd.choices([f"g{i}" for i in range(900)], k=90)
    check(spark, chain + [(i, edited(rnd, base, 2)) for i in range(120)])


def test_edges(spark):
    long = " ".join(f"l{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (9, long), (10, long + " tail"), (None, "n1 n2 n3 n4 n5 n6"), (11, "n1 n2 n3 n4 n5 n6"), (None, "alone in the world at last"), (12, "rep rep rep rep rep rep rep"), (12, "rep rep rep rep rep rep rep")]
    check(spark, rows)
    assert oddsketch.groups(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = b"alpha beta gamma delta " * 50 + b"x" * 300 + b" end"
    whole = oddsketch.shingles(text)
    monkeypatch.setattr(oddsketch, "CHUNK", 64)
    assert np.array_equal(whole, oddsketch.shingles(text))


def test_sketches_tell_far_from_near(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for n in (20, 150, 600, 5000, 40_000):
        for similarity in (0.4, 0.75, 0.95):
            for _ in range(12):
                pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
                both = round(2 * n * similarity / (1 + similarity))
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
                rows.append((similarity, n, len(a), len(b), *(oddsketch.odd_sketch(x).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "similarity double, n long, na long, nb long, a array<long>, b array<long>")
    out = df.select("similarity", "n", oddsketch._distance("a", "b", "na", "nb", 75).alias("d")).collect()
    assert all(r["d"] <= 1 for r in out if r["similarity"] >= 0.75)
    assert all(r["d"] > 1 for r in out if r["similarity"] == 0.4 and 150 <= r["n"] <= 600)
