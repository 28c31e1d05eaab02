"""Near-duplicates by MinHash bands, odd sketches and full comparison.

1. One pass over the texts gives each document the hashes of its five-word shingles, the SHA-256 (half of it) and size of
   that set, 160 MinHash samples in 40 bands of four, and an odd sketch: a 4,096-bit map in which each of up to 8,192
   further samples (the least hash of each of 8,192 ranges) flips a bit. Documents with equal sets are one node from
   here on, whatever their number.
2. In each band bucket every node is paired with one hub (the member with the least hash for that band), so a
   bucket of any size gives one pair a member; the 40 bands give 40 different hubs.
3. The population count of the XOR of two odd sketches estimates how far two sample sets differ. Pairs that differ by five
   standard deviations more than sets of similarity 0.75 and these sizes would are left out, the others ranked.
4. Each node's best pair is compared on the full shingle sets; links make components. All other near pairs between
   components are compared next.
5. So that no hub's choice decides, all pairs of nodes that share a bucket but no component are tested then: in
   each bucket the nodes outside its largest component meet all others by blocks of up to 256 sketches, block
   against block in numpy; pairs that are near are compared in full.

Two documents of similarity 0.75 share no band with probability 3e-7, and are left out by their sketches with
probability 6e-7 (five standard deviations); more similar ones with far less. These are the only approximations. The work of
step 5 grows with the product of a bucket's unlinked nodes and its nodes, a few nanoseconds a product; its rows are blocks and
the near pairs found, each in the first band that its nodes share.

Words are runs of bytes other than 20 and 09-0D after lower-casing A-Z. A document with fewer words than five
has one shingle, the whole sequence. Edge cases: null or empty texts and texts without words are linked with nothing; rows that
repeat, ids included, are nodes of their own set; a null id counts as larger than any; an empty table gives no rows.
Nodes are told apart by 64-bit hashes of id and text, shingles by 64-bit hashes of prints modulo a prime at a base drawn for each run,
and confirmed at a second one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import ModuleType
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import components, discard, materialize, project, release, table
from symlake.llm.rolling import BASE, U64, PrimePrints, drawn_base, mix

WORDS, SIMILARITY = 5, 75
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
#: Hash ranges that give a sample each, bits of a sketch, and the standard deviations that pairs may be off.
RANGES, BITS, DEVIATIONS = 8192, 4096, 5.0
#: Nodes in a block of sketches, and shingles that a comparing task remembers.
BLOCK, REMEMBERED = 256, 4 << 20
CHUNK = (1 << 20) - 8
Sizes = TypeVar("Sizes", Column, np.ndarray)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240601)
_A = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
_B = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_POW = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)
_BAND_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F)


def _combine(words: np.ndarray) -> np.ndarray:
    n = len(words) - WORDS + 1
    total = np.zeros(max(0, n), np.uint64)
    for k in range(WORDS):
        total += words[k : k + max(0, n)] * _POW[k]
    return mix(total)


def words(text: bytes, base: int = BASE >> 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash at a base) of a text's words, a chunk at a time; a word longer than a chunk is hashed by its own."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # end between words if there is a space in the chunk
            cut = end
            while cut > at and not _SPACE[text[cut - 1]]:
                cut -= 1
            end = cut if cut > at else n if (s := _next_space(text, end)) < 0 else s
        data = np.frombuffer(text, np.uint8, end - at, at)
        space = _SPACE[data]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            out.append((start + at, stop + at, mix(PrimePrints(data, base).of(start, stop) + (stop - start).astype(U64) * U64(0x9FB21C651E98DF25))))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, stops, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    return starts, stops, hashes


def _next_space(text: bytes, at: int) -> int:
    found = [p for c in b" \t\n\x0b\x0c\r" if (p := text.find(bytes([c]), at)) >= 0]
    return min(found, default=-1)


def shingles(text: bytes, base: int = BASE >> 4) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    own = words(text.lower(), base)[2]
    if not len(own):
        return own
    if len(own) < WORDS:
        return mix((own * _POW[: len(own)]).sum(keepdims=True) + U64(len(own)))
    return np.unique(_combine(own))


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    low = np.full(SAMPLES, U64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        part = hashes[None, at : at + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity bitmap of a sorted set's samples, as 64-bit words: the first hash in each range flips a bit."""
    ranges = hashes >> U64(64 - RANGES.bit_length() + 1)
    first = np.ones(len(hashes), bool)
    first[1:] = ranges[1:] != ranges[:-1]
    bits = (mix(hashes[first]) & U64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def max_flipped(n_a: Sizes, n_b: Sizes, percent: int, lib: ModuleType = F) -> Sizes:
    """Bits that the sketches of two sets of these sizes and at least this similarity may differ by; lib is F or numpy.

    With u elements in both, 1 - exp(-u / ranges) of the ranges give a sample of the union, which is common with the
    probability of the similarity; what differs flips bits, some of them back.
    """
    j = percent / 100
    share = lambda n: RANGES * (1 - lib.exp(-n / float(RANGES)))
    union = (n_a + n_b) / (1 + j)
    drawn = share(union)
    apart = share(n_a) + share(n_b) - 2 * j * drawn
    variance = 4 * j * (1 - j) * drawn * (1.01 - drawn / union)
    # Of the bits that so many flips leave on: mean and variance, and how an error in the flips carries over.
    kept = lib.exp(-2 * apart / BITS)
    mean, spread = BITS / 2 * (1 - kept), BITS / 4 * (1 - kept * kept) - apart * kept * kept
    return mean + DEVIATIONS * lib.sqrt(spread + kept * kept * variance) + 1


def bands(low: np.ndarray) -> np.ndarray:
    return mix((low.reshape(BANDS, ROWS) * _POW[None, :ROWS]).sum(axis=1) + _BAND_SALT).view(np.int64)


SIGNATURE = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
SIGNATURE_DDL = "key long, id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"


def _sign(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = []
            for key, ident, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                own = shingles(body.as_buffer().to_pybytes(), base)
                if len(own):
                    low = samples(own)
                    s1, s2 = np.frombuffer(hashlib.sha256(own.tobytes()).digest(), np.int64, 2).tolist()
                    rows.append((key, ident, len(own), s1, s2, bands(low), odd_sketch(own)))
                else:
                    rows.append((key, ident, 0, 0, 0, [], []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SIGNATURE, strict=True)], schema=SIGNATURE)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, base: int) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        links = []
        for x, y, bx, by in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            sets = []
            for key, body in ((x, bx), (y, by)):
                own = known.get(key)
                if own is None:
                    own = shingles(body.as_buffer().to_pybytes(), base)
                    if held + len(own) > REMEMBERED:
                        known, held = {}, 0
                    known[key] = own
                    held += len(own)
                sets.append(own)
            if similar(*sets, percent):
                links.append((x, y))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["x", "y"])


def _distance(a: str, b: str, n_a: str, n_b: str, percent: int) -> Column:
    """Flipped bits as a share of the allowed ones: above 1 for pairs that are too far apart, also by their sizes."""
    flipped = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, v: s + v)
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return F.when(sizes, flipped / max_flipped(F.col(n_a), F.col(n_b), percent)).otherwise(F.lit(2.0))


def row_key(ident: Column, text: Column) -> Column:
    """The 64-bit hash by which rows are told apart."""
    return F.xxhash64(ident.cast("long"), F.coalesce(text, F.lit("")).cast("binary"))


def groups(df: DataFrame, id_col: str, text_col: str, percent: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    return _grouped(df, id_col, text_col, percent).select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_rows(df: DataFrame, id_col: str, text_col: str, percent: int = SIMILARITY) -> DataFrame:
    """(kept_key), the row_key of one row of each component: of those with the smallest id, also if ids repeat or are null."""
    low = _grouped(df, id_col, text_col, percent).where(F.col("id").eqNullSafe(F.col("component_id"))).select("component", "key")
    one = low.where("component IS NOT NULL").groupBy("component").agg(F.min("key").alias("kept_key")).select("kept_key")
    return one.unionByName(low.where("component IS NULL").select(F.col("key").alias("kept_key")))


def _grouped(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(key, id, n_shingles, component, component_id) for every row; component is null where there are no words."""
    spark = df.sparkSession
    rows = project(df, id=df[id_col].cast("long"), text=text_col)
    body = F.coalesce("text", F.lit("")).cast("binary")
    docs = rows.select(F.xxhash64("id", body).alias("key"), "id", body.alias("body"))
    # Sets are made at one base and compared at another, so that no pair of words passes for equal in both.
    base, other = drawn_base(), drawn_base()
    signed = materialize(docs.mapInArrow(lambda b: _sign(b, base), SIGNATURE_DDL), "signatures")
    whole = ["s1", "s2", "n"]
    nodes = signed.where("n > 0").groupBy(*whole).agg(F.min("key").alias("node"), F.min("id").alias("low_id"), F.min_by(F.struct("bands", "sketch"), "key").alias("sig"))
    nodes = materialize(nodes.select("node", "low_id", *whole, "sig.bands", "sig.sketch"), "nodes")

    in_band = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    hubs = in_band.groupBy("h").agg(F.min_by("node", F.xxhash64("node", "h")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = materialize(hubs, "hubs")  # joins of tables, not of aggregates, can be split at hot keys
    shared = materialize(in_band.join(hubs, "h"), "buckets")  # members of the buckets that hold several nodes
    discard(hubs)
    pairs = shared.where("node <> hub").select(F.greatest("node", "hub").alias("x"), F.least("node", "hub").alias("y")).distinct()
    sketch = nodes.select("node", "sketch", "n")
    seen = pairs.join(sketch.toDF("x", "sx", "nx"), "x").join(sketch.toDF("y", "sy", "ny"), "y")
    near = materialize(seen.select("x", "y", _distance("sx", "sy", "nx", "ny", percent).alias("distance")).where("distance <= 1"), "near")

    def texts_of(p: DataFrame) -> DataFrame:
        wanted = p.select(F.col("x").alias("key")).unionByName(p.select(F.col("y").alias("key"))).distinct()
        # Always a merge join: its plan, and so what it needs, doesn't turn over with the number of pairs.
        return docs.select("key", "body").join(wanted.hint("merge"), "key").dropDuplicates(["key"])

    def confirmed(p: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        with_y = p.select("x", "y").join(texts.select(F.col("key").alias("y"), F.col("body").alias("by")), "y")
        both = with_y.join(texts.select(F.col("key").alias("x"), F.col("body").alias("bx")), "x").select("x", "y", "bx", "by")
        return materialize(both.mapInArrow(lambda b: _confirm(b, percent, other), "x long, y long"), name)

    def relabelled(label: DataFrame, more: DataFrame) -> DataFrame:
        """Components with more links: label's own are single nodes here."""
        a, b = (label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "xy")
        between = more.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
        merged = components(between, "x", "y")
        moved = label.join(merged.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        # A node of its own that was linked now is not in label yet; one that stands for a component is.
        fresh = merged.join(label.select("node"), "node", "left_anti")
        out = materialize(moved.unionByName(fresh), "label")
        discard(merged)
        return out

    def apart(p: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs in different components."""
        a, b = (label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "xy")
        return p.join(a, "x", "left").join(b, "y", "left").where("coalesce(cx, x) <> coalesce(cy, y)").select(*p.columns)

    def best_of(p: DataFrame) -> DataFrame:
        """Each node's nearest pair."""
        one = F.struct("distance", "x", "y").alias("p")
        each = p.select(F.col("x").alias("node"), one).unionByName(p.select(F.col("y").alias("node"), one))
        return materialize(each.groupBy("node").agg(F.min("p").alias("p")).select("p.x", "p.y").distinct(), "best")

    texts, best = materialize(texts_of(near), "texts"), best_of(near)
    links = confirmed(best, texts, "links")
    label = components(links, "x", "y")
    left = materialize(apart(near.select("x", "y"), label).join(best, ["x", "y"], "left_anti"), "left")
    if not left.isEmpty():
        found, old = confirmed(left, texts, "links"), label
        label = relabelled(old, found)
        discard(old, found)
    discard(texts, links)
    release(spark)
    mixed = _mixed(shared, label, nodes.select("node", "sketch", "n", "bands"))
    last = _crossing(mixed, percent).join(best.unionByName(left), ["x", "y"], "left_anti")
    last = materialize(last, "crossing")
    discard(mixed, shared, near, best, left)
    if not last.isEmpty():
        more = materialize(texts_of(last), "texts")
        found, old = confirmed(last, more, "links"), label
        label = relabelled(old, found)
        discard(more, found, old)
    discard(last)
    release(spark)

    named = nodes.join(label, "node", "left").select(*whole, F.coalesce("component", "node").alias("component"), "low_id")
    named = materialize(named, "named")
    lows = materialize(named.groupBy("component").agg(F.min("low_id").alias("component_id")), "lows")
    by_set = materialize(named.join(lows, "component").select(*whole, "component", "component_id"), "sets")
    discard(nodes, label, named, lows)
    release(spark)
    linked = signed.where("n > 0").select("key", "id", *whole).join(by_set, whole).select("key", "id", F.col("n").alias("n_shingles"), "component", "component_id")
    alone = signed.where("n = 0").select("key", "id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def _mixed(shared: DataFrame, label: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their bucket's largest component as main and its blocks' number."""
    member = shared.where("size > 2").select("h", "band", "node").join(label, "node", "left").select("h", "band", "node", F.coalesce("component", "node").alias("c"))
    sizes = member.groupBy("h", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("h").agg(F.count("*").alias("parts"), F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all")).where("parts > 1")
    main = materialize(main.select("h", F.col("m.c").alias("main"), F.ceil(F.col("all") / BLOCK).alias("blocks")), "main")
    mixed = materialize(member.join(main, "h").join(sketches, "node"), "mixed")
    discard(main)
    return mixed


def _crossing(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of nodes that share a bucket but no component, and whose sketches are near; each once.

    In each bucket only the nodes outside its largest component meet all others, a block of them against a block.
    Two nodes are paired in the first band that they share.
    """
    one = F.struct("node", "c", "n", "sketch", "bands")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    whole = mixed.groupBy("h", block).agg(F.first("band").alias("band"), F.first("main").alias("main"), F.collect_list(one).alias("v"))
    few = mixed.where("c <> main").groupBy("h", block, "blocks").agg(F.collect_list(one).alias("u"))
    few = few.select("h", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    met = few.join(whole, ["h", "block"]).select("band", "main", "u", "v")
    return met.mapInArrow(lambda b: _meet(b, percent), "x long, y long")


def _members(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
    """(node, component, size, sketch, bands) of a block."""
    flat = rows.values
    node, c, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    sketch, band = (flat.field(k).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) for k in (3, 4))
    return node, c, n, sketch.view(np.uint64), band


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[np.ndarray] = []
        for band, main, few, whole in zip(*(batch.column(k) for k in range(4)), strict=True):
            u, uc, un, us, ub = _members(few)
            v, vc, vn, vs, vb = _members(whole)
            flipped = np.zeros((len(u), len(v)), np.int32)
            for k in range(us.shape[1]):
                flipped += np.bitwise_count(us[:, k, None] ^ vs[None, :, k])
            na, nb = un[:, None].astype(float), vn[None, :].astype(float)
            ok = (flipped <= max_flipped(na, nb, percent, np)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            ok &= (uc[:, None] != vc[None, :]) & ((vc[None, :] == main.as_py()) | (u[:, None] > v[None, :]))
            i, j = np.nonzero(ok)
            if len(i):
                first = (ub[i] == vb[j]).argmax(axis=1) == band.as_py()
                i, j = i[first], j[first]
                found.append(np.stack([np.maximum(u[i], v[j]), np.minimum(u[i], v[j])]))
        if found:
            both = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["x", "y"])


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {SIMILARITY} * (a.n + b.n - k)),
r AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, l.y FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""
