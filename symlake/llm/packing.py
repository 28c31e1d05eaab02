"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Tokenising: texts are cut at spaces and line ends, where this tokenizer never joins anything, and the ids of
each distinct piece come from the tokenizers library once for each worker's cache.

Packing: the pieces of all documents are dealt by a hash of (document, piece) into groups of about
``GROUP`` pieces; a group is packed by itself and loses at most a part of one sequence of some thousands.
Within a group, bins are filled greedily with the longest piece that fits. Then a bin's smallest piece is
taken out if two unpacked pieces fill the wider gap more tightly. Lengths present are bits of one integer, so that
both searches are a few machine-word operations whatever the group's size.

Edge cases: null and empty texts have the end token alone and are packed like others; rows that repeat an id
are packed each on its own; texts above the limit are cut into pieces of the limit, only the last shorter; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import materialize, project, table

if TYPE_CHECKING:
    from tokenizers import Tokenizer

LIMIT = 2048
#: Pieces that one task packs together.
GROUP = 16384
#: Distinct strings whose ids a worker remembers.
CACHE = 1_600_000
#: Bytes that end words and are never part of one with the letters before them (fixed values).
PUNCTUATION = b".,;:!?*$%&#@-_()[]{}+=/|~"
END = b"\0\0\0\0"
_STEM = re.compile(rb"(?m)^(.*?)([" + re.escape(PUNCTUATION) + rb"]*)$")
#: The characters by which a vocabulary on bytes names those that don't print: the next ones from 256 on.
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)) if b != 0x20}


class Encoder:
    """Ids of whole texts as little-endian 32-bit words.

    The tokenizer lower-cases, so ASCII letters are lowered first and share entries; a word with punctuation behind it
    is looked up as two. New words of Latin letters alone are encoded many at a time and parted at the tokens that
    end a word. Texts that may hold special tokens are encoded by the library directly.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        assert sys.byteorder == "little"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        # The same model without normal forms, which lower-case Latin letters don't need.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Half of the cache is what was learnt last; of the other half, words that come again move over.
        self.cache, self.known, self.old = cache, {b"": b""}, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        cut, missed = [], set()
        look_up = self.known.get
        for text in texts:
            body = text.encode()
            if any(m in body for m in self.marks):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(None)
                words = body.lower().replace(b"\n", b" ").split(b" ")
                found = list(map(look_up, words))
                gaps = [i for i, ids in enumerate(found) if ids is None]
                new = [words[i] for i in gaps]
                missed.update(new)
                cut.append((found, gaps, new))
        self._learn(missed)
        known = self.known
        for found, gaps, new in cut:
            for i, word in zip(gaps, new, strict=True):
                found[i] = known[word]
        rest = (b"".join(found) for found, _, _ in cut)
        return [next(rest) if ids is None else ids for ids in out]

    def _learn(self, new: set[bytes]) -> None:
        """Put words that aren't known into known."""
        if 2 * (len(self.known) + len(new)) > self.cache:
            self.known, self.old = {b"": b""}, self.known
            new.discard(b"")
        again = new - new.difference(self.old)  # not an operator: it would walk all of old
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = new - again
        letters = set(filter(bytes.isalpha, new))
        # The others with the punctuation behind them cut off; line ends are in no word.
        others = list(new - letters)
        stems, tails = zip(*_STEM.findall(b"\n".join(others)), strict=True) if others else ((), ())
        fresh = set(stems).difference(self.known, letters)
        plain = {w for w in fresh if w.isalpha() or self._is_latin(w.decode())}
        foreign = {w for w in fresh - plain if w.decode().lower().isalpha()}
        self._letters(sorted(letters | plain, key=bytes.isascii))  # most calls are of ASCII alone
        self._each([w for w in {*foreign, *set(tails).difference(self.known)} if w])
        parted = [stem in self.known for stem in stems]
        self._each([w for w, known in zip(others, parted, strict=True) if not known])
        known = self.known
        for word, stem, tail, ok in zip(others, stems, tails, parted, strict=True):
            if ok:
                known[word] = known[stem] + known[tail]

    @staticmethod
    def _is_latin(word: str) -> bool:
        """Whether a word is of letters that the tokenizer's normal form only lower-cases, one by one."""
        return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word

    def _each(self, words: list[bytes]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[word] = array("I", e.ids).tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Words of Latin letters alone: many at a time, parted at the tokens that end a word."""
        for at in range(0, len(words), 2000):
            own = words[at : at + 2000]
            body = b" ".join(own)
            text = body.decode() if body.isascii() else body.decode().lower().encode().decode("latin-1").translate(_BYTE_NAMES)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            assert len(stops) == len(own)
            data, start = ids.tobytes(), 0
            for word, stop in zip(own, (4 * stops).tolist(), strict=True):
                self.known[word] = data[start:stop]
                start = stop


PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, cache: int) -> Encoder:
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int, cache: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, cache)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for ident, ids in zip(part.column(0).to_pylist(), encoder([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += END
                for k, start in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[start : start + 4 * limit]
                    rows.append((ident, k, start // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def pack_group(lengths: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Bins of indexes into lengths (1 .. limit), by best-two-fit."""
    waiting = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append(i)
    have = mirror = 0  # bit n, and bit limit - n: a piece of length n waits
    for n in waiting:
        have |= 1 << n
        mirror |= 1 << (limit - n)

    def take(n: int) -> int:
        nonlocal have, mirror
        i = waiting[n].pop()
        if not waiting[n]:
            have ^= 1 << n
            mirror ^= 1 << (limit - n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal have, mirror
        if not waiting[n]:
            have |= 1 << n
            mirror |= 1 << (limit - n)
        waiting[n].append(i)

    bins = []
    while have:
        bin_, gap = [], limit
        while fits := have & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            bin_.append((n, take(n)))
            gap -= n
        if gap and len(bin_) > 1 and have:
            small, i = min(bin_)
            pair = _best_pair(have, mirror, waiting, gap + small, small, limit)
            if pair:
                bin_.remove((small, i))
                bin_ += [(n, take(n)) for n in pair]
                give(small, i)
        bins.append([i for _, i in bin_])
    return bins


def _best_pair(have: int, mirror: int, waiting: dict[int, list[int]], room: int, beat: int, limit: int) -> tuple[int, int] | None:
    """The two waiting lengths with the largest sum in (beat, room]."""
    for total in range(room, beat, -1):
        # Bit a is set if lengths a and total - a both wait.
        both = (mirror >> (limit - total)) & have & ((1 << total) - 2) if total <= limit else 0
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or len(waiting[a]) > 1:
                return a, total - a
            both ^= 1 << a
    return None


PLACED = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(key: tuple, data: pa.Table, limit: int) -> pa.Table:
    data = data.drop(["grp"]).sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    lengths = data.column("length").to_pylist()
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for k, bin_ in enumerate(pack_group(lengths, limit)):
        at = 0
        for i in bin_:
            sequence[i], offset[i] = (key[0].as_py() << 32) + k, at
            at += lengths[i]
    return data.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, limit: int = LIMIT, group: int = GROUP, cache: int = CACHE) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = project(df, id=df[id_col].cast("long"), text=text_col)
    pieces = materialize(rows.mapInArrow(lambda b: _pieces(b, tokenizer, limit, cache), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInArrow(lambda key, data: _pack(key, data, limit), PLACED)


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")
