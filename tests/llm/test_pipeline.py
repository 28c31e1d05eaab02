import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symlake.llm import catalog, suffix
from tests.llm import test_oddsketch
from tests.llm.test_operators import toxic_corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rnd = random.Random(11)
    rows, labels = toxic_corpus()
    words = [f"w{i}" for i in range(2000)]
    passage = " ".join(rnd.choices(words, k=120))
    own = lambda: " ".join(rnd.choices(words, k=100))
    clean = [(1000 + i, " ".join(rnd.choices(words, k=150))) for i in range(40)]
    more = [(2000, clean[0][1]), (2001, clean[0][1].replace(" ", "\n ")), (2002, clean[1][1].replace("w1", "v1", 1)), (2003, clean[1][1] + " end"), (2004, own() + " head a " + passage + " tail b " + own()), (2005, own() + " start c " + passage + " stop d " + own()), (2006, None), (2007, ""), (2008, "é " * 3000)]
    rows = [*rows, *clean, *more, more[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("bigint").alias("n_chars"))
    df.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def as_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]

    one = corpus_pipeline.materialize(stages["toxicity"](spark, docs, corpus), "t")
    kept = as_rows(one)
    gone = {r[0] for r in as_rows(docs)} - {r[0] for r in kept}
    toxic = {i for i in range(600) if i % 6 == 0}
    assert len(gone & toxic) > 90 and len(gone - toxic) < 10 and all(i < 600 for i in gone)

    two = corpus_pipeline.materialize(stages["exact_dedup"](spark, one, corpus), "t")
    first = {}
    for ident, text in sorted(kept, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), ident)
    assert sorted(r[0] for r in as_rows(two)) == sorted(first.values())

    three = corpus_pipeline.materialize(stages["near_dedup"](spark, two, corpus), "t")
    want = sorted(int(i) for i, _, component in test_oddsketch.brute(as_rows(two)) if i == component)
    assert sorted(r[0] for r in as_rows(three)) == want and 2003 not in want

    four = corpus_pipeline.materialize(stages["suffix_dedup"](spark, three, corpus), "t")
    for df in (one, two, three, four):
        assert df.columns == COLUMNS
    before, after = dict(as_rows(three)), dict(as_rows(four))
    assert before.keys() == after.keys() and {i for i in before if before[i] != after[i]} == {2004, 2005, 2008}
    assert "head a" in after[2004] and len(before[2004]) - len(after[2004]) > 400 and after[2008] == ""
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in four.collect())

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    expected = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in after.items())]
    five = stages["packing"](spark, four, corpus).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in five) == sorted(expected)
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, corpus).collect()) == sorted(expected)


def test_empty_documents(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0).withColumn("row", F.lit(1)).withColumn("ident", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_null_ids_and_more_columns_go_through(spark, corpus):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "other words in a text here"), (1, None)], "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("digest", F.lit("d")).withColumn("spans", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, corpus), "t")
        assert docs.columns == ["doc_id", "text", "key", "digest", "spans"]
    assert sorted(docs.collect(), key=str)[0]["key"] == "k" and docs.count() == 3


def test_catalog_has_all_eleven():
    names = catalog.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert catalog.oracle_sql().keys() < names.keys()
    assert suffix.STEPS[0] == suffix.WINDOW


@pytest.mark.parametrize("letters", [1, 4])
def test_passages_of_over_50_words_are_cut_however_short(spark, corpus, letters):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters))
    own = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    passages = {n: " ".join(word() for _ in range(n)) for n in (40, 50, 51, 52, 58, 65)}
    rows = [(10 * n + k, f"{own(rnd.randrange(60))} top{n}{k} {p} end{n}{k} {own(rnd.randrange(60))}") for n, p in passages.items() for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    after = dict(as_rows(corpus_pipeline.suffix_dedup(spark, docs, corpus)))
    for ident, text in rows:
        p = passages[ident // 10]
        assert len(p) < 390  # no bytes of 400 can repeat
        assert after[ident].split() == (text.replace(p, "") if ident // 10 > 50 else text).split()


def test_near_duplicates_go_also_where_ids_are_null_or_repeat(spark, corpus):
    rnd = random.Random(13)
    text = lambda: " ".join(rnd.choices([f"w{i}" for i in range(2000)], k=150))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a), (5, a + " end"), (None, b), (7, c), (8, d), (7, d + " end"), (8, text()), (None, c + " x"), (None, None), (None, ""), (9, b + " y")]
    e = text()
    three = [(None, f"{e} {k}") for k in "klm"]
    out = as_rows(corpus_pipeline.near_dedup(spark, spark.createDataFrame([*rows, *three], "doc_id long, text string").repartition(3), corpus))
    assert sum(r in three for r in out) == 1
    assert sorted((r for r in out if r not in three), key=str) == sorted([rows[i] for i in (1, 3, 5, 6, 8, 9, 10)], key=str)
