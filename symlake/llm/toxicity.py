"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all text, labels unseen, is the unlabelled set. A linear
classifier is trained in numpy on the risk  prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)),  whose second part
estimates the risk on negatives; where it goes below zero (overfitting) the step climbs back instead. The class
prior is the share of toxic rows among the labelled training rows.

Features are hashed words and their prefixes of 4 to 8 bytes (so that inflected words count), each at three levels:
present, at least twice, at least four times. Up to 1,024 that positives have far oftener than unlabelled text take
part. Levels instead of frequencies make scores of long and short texts comparable.

Fitting uses bounded samples (``POSITIVES``, ``UNLABELLED``: the ids with the least hashes, a text for each) of
rows that are not held out, but all features of their texts, however long: these are counted on executors, and the driver gets the
chosen ones and which of them each text has. Scoring reads whole texts, in chunks of bytes.

Edge cases: null and empty texts get the score of a text without features; labels for absent or null ids are ignored, of
repeated labels the larger counts; of rows that share an id the least text may be a sample; without positives or text to learn from every score is 0; repeated rows get equal
scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import discard, materialize, project, table
from symlake.llm.rolling import U64, Prints, mix

#: Documents that the classifier is fitted on, at most.
POSITIVES, UNLABELLED = 3000, 5000
#: Features that the classifier has, at most.
CHOSEN = 1024
#: What a feature needs to be chosen: a share of positives among the texts that have it, and a gain in log likelihood
#: beyond the one that chance gives the best of all candidates.
PURITY, SPARE_GAIN = 0.5, 8.0
PREFIXES = (4, 5, 6, 7, 8)
#: Counts from which a feature is on, by level; the level is kept in a feature's two lowest bits.
LEVELS = (1, 2, 4)
CHUNK = (1 << 20) - 8
FOLDS = 5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _segments(texts: Iterable[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, bytes) in lists of at most CHUNK bytes; long texts are cut at spaces."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        body = (text or "").lower().encode()
        at = 0
        while at < len(body):
            end = min(len(body), at + CHUNK)
            if end < len(body):
                end = max(body.rfind(b" ", at, end), body.rfind(b"\n", at, end)) + 1 or end
            if held and size + end - at + 1 > CHUNK:
                yield held
                held, size = [], 0
            held.append((k, body[at:end]))
            size += end - at + 1
            at = end
    if held:
        yield held


def features(segments: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words in a list of segments, with repetitions."""
    data = np.frombuffer(b" ".join(s[1] for s in segments), np.uint8)
    edge = np.diff(np.concatenate(([0], _LETTER[data].view(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(s[1]) + 1 for s in segments])
    owner = np.array([s[0] for s in segments])[np.searchsorted(ends, start, side="right")]
    prints = Prints(data)
    names = [prints.of(start, stop)]
    owners = [owner]
    for n in PREFIXES:
        long = stop - start > n
        names.append(prints.of(start[long], start[long] + n) + U64(n))
        owners.append(owner[long])
    return np.concatenate(owners), (mix(np.concatenate(names)) >> U64(34)).astype(np.int64) << 2


def levels(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature with level), once for each level that a feature reaches in a text."""
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(owner)))
    reached = [at[count >= n] for n in LEVELS]
    return np.concatenate([owner[r] for r in reached]), np.concatenate([feature[r] + k for k, r in enumerate(reached)])


@dataclass(frozen=True)
class Model:
    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: Iterable[str | None], count: int) -> np.ndarray:
        bases = np.unique(self.chosen & ~3)
        likely = np.zeros(1 << 16, bool)  # a first sieve on some bits
        likely[(bases >> 2) & 0xFFFF] = True
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for segment in _segments(texts):
            owner, feature = features(segment)
            hit = likely[(feature >> 2) & 0xFFFF]
            owner, feature = owner[hit], feature[hit]
            hit = np.isin(feature, bases)
            owners.append(owner[hit])
            found.append(feature[hit])
        owner, feature = levels(np.concatenate(owners), np.concatenate(found))
        total = np.full(count, self.bias)
        if len(self.chosen):
            place = np.minimum(np.searchsorted(self.chosen, feature), len(self.chosen) - 1)
            known = self.chosen[place] == feature
            total += np.bincount(owner[known], self.weights[place[known]], count)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def choose(counts: DataFrame, n_p: int, n_u: int, prior: float) -> DataFrame:
    """(feature): those that positives have far oftener than unlabelled text, by the gain in likelihood; ``CHOSEN`` at most.

    counts (feature, p, u) has the positives and the unlabelled texts with each feature. A feature counts if most unlabelled
    texts that have it would have to be positive to explain its share among the positives.
    """
    often = counts.where("p >= 3")
    chance = 2 * math.log(max(1, often.count()))
    share_p, share_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    gain = 2 * (F.col("p") * F.log(share_p / share_u) - n_p * (share_p - share_u))
    likely = often.where(prior * share_p >= PURITY * share_u).withColumn("gain", gain)
    return likely.where(F.col("gain") > chance + SPARE_GAIN).orderBy(F.desc("gain"), "feature").limit(CHOSEN).select("feature")


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction to step against: its gradient (the bias last), or that of minus the part
    on negatives where this part is below zero."""
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -50, 50)))
    gp, gu = xp @ w + b, xu @ w + b
    positive = prior * np.mean(np.logaddexp(0, -gp))
    negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
    at_u, at_p = sigmoid(gu) / len(gu), -prior * sigmoid(gp) / len(gp)  # of the part on negatives
    if negative >= 0:
        at_p = at_p - prior * (1 - sigmoid(gp)) / len(gp)
    else:
        at_u, at_p = -at_u, -at_p
    step = np.append(xu.T @ at_u.astype(xu.dtype) + xp.T @ at_p.astype(xp.dtype), at_u.sum() + at_p.sum())
    return positive + max(0.0, negative), step


def fit(xp: np.ndarray, xu: np.ndarray, chosen: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Train by full-batch Adam on the non-negative risk with logistic loss; a row of xp and xu for each text, a column for each chosen feature."""
    w, b = np.zeros(len(chosen), np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        grad = risk(xp, xu, w, b, prior)[1]
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    return Model(chosen.astype(np.int64), w, float(b), prior)


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = [features(s)[1] for s in _segments([text])]
            found = np.concatenate(own) if own else np.zeros(0, np.int64)
            list_ = pa.array([levels(np.zeros(len(found), np.int64), found)[1]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), list_], ["part", "features"])


def _places(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each sampled text, the places of its chosen features."""
    for batch in batches:
        own = [np.flatnonzero(np.isin(chosen, x.values.to_numpy())) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["part", "places"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the rows that are not held out."""
    marks = project(labels, id=labels[id_col].cast("long"), toxic=labels[label_col].cast("int")).where("id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = project(docs, id=docs[id_col].cast("long"), text=text_col).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    by_hash = lambda df, n: df.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    some = by_hash(marks.where("toxic = 1"), positives).select("id", F.lit(1).alias("part")).unionByName(by_hash(texts, unlabelled).select("id", F.lit(0).alias("part")))
    prior = seen["k"] / seen["n"] if seen["n"] else 0.0
    # At most positives + unlabelled ids: small enough to broadcast whatever the input.
    chosen = texts.join(F.broadcast(some), "id").groupBy("part", "id").agg(F.min("text").alias("text"))
    nothing = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -50.0, prior)
    sample = materialize(chosen.select("part", "text").mapInArrow(_distinct_features, "part int, features array<long>"), "sample")
    sizes = {r["part"]: r["count"] for r in sample.groupBy("part").count().collect()}
    if not sizes.get(1) or not sizes.get(0) or not 0 < prior < 1:
        discard(sample)
        return nothing
    each = sample.select("part", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("part").alias("p"), F.sum(1 - F.col("part")).alias("u"))
    picked = np.sort(np.array([r["feature"] for r in choose(counts, sizes[1], sizes[0], prior).collect()], np.int64))  # CHOSEN at most
    # A list of at most CHOSEN places for each of at most positives + unlabelled texts, whatever their lengths.
    held = sample.mapInArrow(lambda b: _places(b, picked), "part int, places array<long>").toArrow()
    discard(sample)
    x = np.zeros((held.num_rows, len(picked)), np.float32)
    lists = held.column("places").combine_chunks()
    x[np.repeat(np.arange(held.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)] = 1
    part = held.column("part").to_numpy()
    return fit(x[part == 1], x[part == 0], picked, prior)


def score(model: Model, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts, len(texts)))

    return F.pandas_udf(run, "double")(text)


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    scored = docs.select("doc_id", score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
