"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a prefix ends in one token only, so an array of last tokens, filled from left to right, holds
the encodings of all prefixes of a pretoken. For prefix i the candidates are the vocabulary's tokens that
end there; a suffix automaton of the vocabulary, fed byte by byte, lists them. A candidate t fits if the last
token of the prefix before it and t can stand side by side, which a test on the merge history of the two
decides without encoding anything. Back-pointers then give the ids. Merges are never applied to the text.

Texts are cut into pretokens as the vocabulary's file says; the ids of distinct pretokens are kept in
a bounded cache of each worker. Special tokens that occur in a text are found first.

Edge cases: null and empty texts have no tokens; any text is cut and encoded whole, whatever its length; rows
that repeat are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from symlake.llm.common import project, table

#: How byte-level vocabularies cut a text into pretokens (fixed values).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pretokens whose ids a worker remembers, and token pairs whose test it remembers.
CACHE, PAIRS = 1_000_000, 500_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """Of a set of byte strings; lists which of them end at each position of a text."""

    def __init__(self, words: dict[bytes, int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for word in words:
            last = 0
            for c in word:
                last = self._extend(last, c)
        ends: list[list[tuple[int, int]]] = [[] for _ in self.len]
        for word, ident in words.items():
            state = 0
            for c in word:
                state = self.next[state][c]
            ends[state].append((len(word), ident))
        for e in ends:
            e.sort(reverse=True)
        # All words that end wherever a state does, longest first: its own, then those of its suffix link.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(ends)
        for state in sorted(range(1, len(ends)), key=self.len.__getitem__):
            below = self.ends[self.link[state]]
            self.ends[state] = (*ends[state], *below) if ends[state] else below

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        known = nxt[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, known, c)
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def matches(self, text: bytes) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
        """For each position the longest match's length and (length, word) pairs; those not above it end there."""
        nxt, link, lens, ends = self.next, self.link, self.len, self.ends
        state = held = 0
        out = []
        for c in text:
            step = nxt[state].get(c)
            while step is None and state:
                state = link[state]
                held = lens[state]
                step = nxt[state].get(c)
            if step is not None:
                state, held = step, held + 1
            out.append((held, ends[state]))
        return out


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = byte_names()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(names[c] for c in word) for word, i in vocab.items() if all(c in names for c in word)}
        self.bytes |= {i: word.encode() for word, i in self.special.items()}
        self.rank, self.left, self.right, self.merge = dict.fromkeys(vocab.values(), -1), {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[spec_join(pair)]
            self.merge[a, b] = r
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        usable = {i for i in vocab.values() if i not in self.special.values() and (len(self.bytes[i]) == 1 or self.rank[i] >= 0)}
        own = {i for i in usable if self.rank[i] < 0 or self._apart(self.left[i], self.right[i], self.rank[i])}
        self.automaton = SuffixAutomaton({self.bytes[i]: i for i in sorted(own)})
        self.pretokens = regex.compile(PRETOKENS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Pretokens that decode to another text than their own are odd. Half of the cache is what was learnt last; of the
        # other half, pretokens that come again move over.
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.cache = cache
        #: By the first token times 2^32 plus the second.
        self.pairs: dict[int, bool] = {}

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether a and b stay two tokens side by side as far as merges ranked below limit go.

        The histories of both are undone from the latest merge on. At each step the tokens that touch at the
        border would have merged if their merge comes before the one that is undone next; at equal ranks
        the merge further left comes first.
        """
        rank, left, right, merge = self.rank, self.left, self.right, self.merge
        while True:
            if merge.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << 32 | b)
        if found is None:
            found = self.pairs[a << 32 | b] = self._apart(a, b, 1 << 60)
        return found

    def encode_pretoken(self, text: bytes) -> list[int]:
        last, pairs = [-1], self.pairs
        for at, (held, ending) in enumerate(self.automaton.matches(text), 1):
            for length, ident in ending:
                if length > held:
                    continue
                before = last[at - length]
                if at == length or before >= 0 and (fits if (fits := pairs.get(before << 32 | ident)) is not None else self.compatible(before, ident)):
                    last.append(ident)
                    break
            else:
                last.append(-1)
        if len(pairs) > PAIRS:
            pairs.clear()
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.bytes[last[at]])
        return ids[::-1]

    def _learn(self, pretoken: str) -> str:
        """The ids, as text with a comma behind each, of a pretoken that isn't known."""
        found = self.known.get(pretoken) or self.old.get(pretoken)
        if found is None:
            ids = [self.special[pretoken]] if pretoken in self.special else self.encode_pretoken(pretoken.encode())
            found = "".join([f"{i}," for i in ids])
            if (back := self.decode(ids)) != pretoken:
                self.odd[pretoken] = back
        if 2 * len(self.known) >= self.cache:
            self.known, self.old = {}, self.known
        if len(pretoken) <= 256:
            self.known[pretoken] = found
        return found

    def _look_up(self, pretokens: list[str]) -> list[str]:
        """The ids of pretokens as texts, with a comma behind each."""
        found = list(map(self.known.get, pretokens))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self._learn(pretokens[i])
        return found

    def cut(self, text: str) -> list[str]:
        """Pretokens and special tokens."""
        if not self.special or not any(s in text for s in self.special):
            return self.pretokens.findall(text)
        return [p for part in self.split.split(text) for p in ([part] if part in self.special else self.pretokens.findall(part))]

    def digest(self, text: str) -> tuple[str, str]:
        """The ids as text, a comma behind each, and the text that they decode to."""
        cut = self.cut(text)
        ids = "".join(self._look_up(cut))
        return ids, "".join([self.odd.get(p, p) for p in cut] if self.odd else cut)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in "".join(self._look_up(self.cut(text))).split(",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def spec_join(pair: list[str] | str) -> str:
    return "".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a worker, built once."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


DIGESTS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        rows = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, decoded = bpe.digest(text or "")
            rows.append((ident, ids.count(","), hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGESTS, strict=True)], schema=DIGESTS)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])


def encode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids array<int>) of every text."""
    rows = project(df, id=df[id_col].cast("long"), text=text_col)
    return rows.mapInArrow(lambda b: _encode(b, path), "id long, ids array<int>")


def decode(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """(id, text) of every list of ids; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return project(df, id=df[id_col].cast("long"), ids=ids_col).mapInArrow(run, "id long, text string")


def round_trip(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    rows = project(df, id=df[id_col].cast("long"), text=text_col)
    return rows.mapInArrow(lambda b: _digest(b, path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
