"""A training-corpus pipeline: toxic documents and copies go, repeated passages are cut, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, which has the columns of ``documents`` and maybe
more, whatever their names; all stages but the last keep those columns. Rows with null ids or texts go through like
others, very long texts are read whole, and an empty table gives no rows in every stage.

This module needs the subpackage ``symlake.llm`` and belongs to it: without it, importing this raises ModuleNotFoundError.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm import oddsketch, packing, patricia, suffix, toxicity
from symlake.llm.common import materialize, table


#: Words whose ids a worker of the packing stage remembers; it lives on beside the other stages.
WORDS = 300_000


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on these documents and their labels, doesn't predict to be toxic.

    Null and empty texts stay, unless there is nothing but toxic labels to learn from; equal texts share their fate.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return docs.where(toxicity.score(model, docs["text"]) < 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id; one of rows that repeat it.

    Null and empty texts are equal to each other, so that one of them stays; null ids come last; of rows with one id and
    texts equal but for white space the least text stays.
    """
    kept = patricia.dedup(docs, "doc_id", "text").where("kept").select(F.col("id").alias("ident"), F.col("text_sha256").alias("digest")).distinct()
    names = docs.columns
    packed = docs.select(docs["doc_id"].alias("ident"), F.sha2(patricia.normalised(docs["text"]).cast("binary"), 256).alias("digest"), docs["text"].alias("body"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    found = packed.join(kept, packed["ident"].eqNullSafe(kept["ident"]) & (packed["digest"] == kept["digest"]), "left_semi")
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("ident", "digest").orderBy("body"))).where("nth = 1")
    return first.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, and one only if that is null or repeats.

    Texts without words are near nothing and stay; rows that repeat id and text stay together, as they share a key.
    """
    kept = oddsketch.kept_rows(docs, "doc_id", "text")
    return docs.join(kept, oddsketch.row_key(docs["doc_id"], docs["text"]) == kept["kept_key"], "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of over 50 words, or of 400 bytes or more, that occur more than once; n_chars follows the text.

    Null texts stay null, empty ones empty; a text that is all repeated becomes empty; rows that repeat each other are each
    other's copies.
    """
    out = suffix.remove(docs, "doc_id", "text", n_words=suffix.PASSAGE)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in out.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence of at most 2,048 tokens.

    Null and empty texts are one token long; rows that repeat each other are packed each on its own.
    """
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), cache=WORDS).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", best_fit_packing)]

#: The first stage trains a classifier, which SQL can't express; tests compare all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
