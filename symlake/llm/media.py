"""Signature sniffing of media columns.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob. A format's
validator then walks its structure (chunks, segments, blocks, checksums where they are cheap) and
returns the length that the structure itself states, or None: text that merely contains a magic never counts. The
valid object at byte 0 gives the blob's true type, whatever was declared; valid objects further in are
carved out, the outermost first.

Edge cases: null or empty blobs have no type; an object that its blob cuts short is invalid; a null
declared type counts as wrong when a type is found; rows are independent of each other, so repeated rows give
equal results; an empty table gives no rows. A very long text is one blob of its length, and the bytes of a batch of blobs are
bounded. End markers are found in the same pass as magics, and chains are walked once however many magics lead into them, so the
work grows with the blob whatever it holds. Packed streams (gzip) and checksummed chunks (PNG) can't be shared that way: all of a blob's
may cost ``BUDGET`` times its size, and objects that come after that is spent are not recognised (32 streams inside each other still are).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import materialize, project, table

BLOCK = 64
RATE = 8000
#: Times its size that a blob's packed streams and checksummed chunks may cost, all together.
BUDGET = 32


class Blob:
    """A blob with the places of all magics and end markers, and what validators have found out about positions so far.

    Where a format is a chain (a position tells the next), what follows from a position doesn't depend on where a walk began, so it
    is kept: a walk that joins a known one ends there, and all walks together visit a position once.
    """

    def __init__(self, data: bytes, places: dict[bytes, list[int]]) -> None:
        self.data, self.places = data, places
        self.known: dict[str, dict] = {}
        #: Bytes that may still be unpacked or summed, for all objects of the blob together.
        self.budget = BUDGET * len(data) + (1 << 20)

    def facts(self, of: str) -> dict:
        return self.known.setdefault(of, {})

    def spend(self, n: int) -> bool:
        self.budget -= n
        return self.budget >= 0


def _followed(start: int, known: dict[int, tuple | None], step: Callable[[int], tuple[int | None, tuple | None]], join: Callable[[int, tuple], tuple] = lambda _, x: x) -> tuple | None:
    """What a chain leads to from a position. step gives the next position, or None and the result; join adds what a position itself tells."""
    way, p = [], start
    while p not in known:
        then, result = step(p)
        if then is None:
            known[p] = result
            break
        way.append(p)
        p = then
    result = known[p]
    for q in reversed(way):
        result = known[q] = None if result is None else join(q, result)
    return result


class Chunks:
    """All chunk chains of a blob's RIFF forms as one forest, in which a chunk's parent is the next one.

    A form is valid if its end is an ancestor of its first chunk; which kinds of chunks lie between is a difference of counts
    along the way up.
    """

    KINDS = (b"fmt ", b"data", b"LIST")

    def __init__(self, data: bytes, starts: list[int]) -> None:
        after: dict[int, int] = {}
        for at in starts:
            p = at + 12
            while p + 8 <= len(data) and p not in after:
                size = int.from_bytes(data[p + 4 : p + 8], "little")
                after[p] = p + 8 + size + (size & 1)
                p = after[p]
        below: dict[int, list[int]] = {}
        for p, q in after.items():
            below.setdefault(q, []).append(p)
        #: Of each position its number in pre-order, the last number below it, and the kinds from it upwards.
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.counts: dict[int, tuple[int, ...]] = {}
        for root in [q for q in below if q not in after]:
            todo = [(root, False)]
            while todo:
                p, left = todo.pop()
                if left:
                    self.last[p] = len(self.first)
                    continue
                self.first[p] = len(self.first)
                up = self.counts[after[p]] if p in after else (0,) * (len(self.KINDS) + 1)
                own = (*[int(data[p : p + 4] == k) for k in self.KINDS], 1) if p in after else (0,) * len(up)
                self.counts[p] = tuple(x + y for x, y in zip(up, own, strict=True))
                todo.append((p, True))
                todo += [(c, False) for c in below.get(p, ())]

    def leads(self, p: int, end: int) -> bool:
        return p in self.first and end in self.first and self.first[end] <= self.first[p] < self.last[end]

    def between(self, p: int, end: int) -> tuple[int, ...]:
        return tuple(x - y for x, y in zip(self.counts[p], self.counts[end], strict=True))


def _riff(form: bytes, *needed: bytes) -> Callable[[Blob, int], int | None]:
    def check(blob: Blob, at: int) -> int | None:
        data = blob.data
        if data[at + 8 : at + 12] != form:
            return None
        end, p = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12
        if end > len(data):
            return None
        facts = blob.facts("riff")
        if not facts:
            facts["chunks"] = Chunks(data, blob.places.get(b"RIFF", [at]))
        chunks: Chunks = facts["chunks"]
        # The last chunk may be padded beyond the end, but has its header before it.
        stop = end if chunks.leads(p, end) else end + 1 if chunks.leads(p, end + 1) and not chunks.leads(p, end - 7) else None
        if stop is None:
            return None
        *kinds, n = chunks.between(p, stop)
        return end - at if n and all(kinds[Chunks.KINDS.index(k)] for k in needed) else None

    return check


def _png(blob: Blob, at: int) -> int | None:
    data = blob.data

    def step(p: int) -> tuple[int | None, tuple | None]:
        if p + 12 > len(data):
            return None, None
        size = int.from_bytes(data[p : p + 4], "big")
        kind, end = data[p + 4 : p + 8], p + 12 + size
        if end > len(data) or kind == b"IHDR" or not blob.spend(size) or zlib.crc32(data[p + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None, None
        return (None, (end,)) if kind == b"IEND" else (end, None)

    # The header comes first and is of a fixed size.
    if data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR" or at + 33 > len(data) or zlib.crc32(data[at + 12 : at + 29]) != int.from_bytes(data[at + 29 : at + 33], "big"):
        return None
    found = _followed(at + 33, blob.facts("png"), step)
    return found[0] - at if found else None


def _gif(blob: Blob, at: int) -> int | None:
    data = blob.data
    if at + 13 > len(data):
        return None

    def skip(p: int) -> tuple[int | None, tuple | None]:
        """Over a run of sub-blocks."""
        return (p + 1 + data[p], None) if p < len(data) and data[p] else (None, (p + 1,))

    def block(p: int) -> tuple[int | None, tuple | None]:
        if p >= len(data):
            return None, None
        kind = data[p]
        if kind == 0x3B:
            return None, (p + 1, False)
        if kind == 0x21:
            q = p + 2
        elif kind == 0x2C and p + 10 < len(data):
            q = p + 11 + (3 << ((data[p + 9] & 7) + 1) if data[p + 9] & 128 else 0)
        else:
            return None, None
        return _followed(q, blob.facts("gif sub-blocks"), skip)[0], None

    p = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 128 else 0)
    found = _followed(p, blob.facts("gif"), block, lambda q, x: (x[0], x[1] or data[q] == 0x2C))
    return found[0] - at if found and found[1] else None


def _jpeg(blob: Blob, at: int) -> int | None:
    data, facts = blob.data, blob.facts("jpeg")
    if "marks" not in facts:
        # Markers that end entropy-coded data: neither stuffing nor restarts.
        raw = np.frombuffer(data, np.uint8)
        then = raw[1:]
        facts["marks"] = (np.flatnonzero((raw[:-1] == 0xFF) & (then != 0) & ~((then >= 0xD0) & (then <= 0xD7)))).tolist()
    marks = facts["marks"]

    def step(p: int) -> tuple[int | None, tuple | None]:
        if p + 4 > len(data) or data[p] != 0xFF or data[p + 1] == 0xD9:
            return None, None
        q = p + 2 + int.from_bytes(data[p + 2 : p + 4], "big")
        if data[p + 1] != 0xDA:
            return q, None
        k = bisect_left(marks, q)
        if k == len(marks):
            return None, None
        return (None, (marks[k] + 2,)) if data[marks[k] + 1] == 0xD9 else (marks[k], None)

    found = _followed(at + 2, blob.facts("jpeg segments"), step)
    return found[0] - at if found else None


def _bmp(blob: Blob, at: int) -> int | None:
    data = blob.data
    if at + 30 > len(data):
        return None
    size, _, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    ok = header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size and at + size <= len(data)
    return size if ok else None


def _zip(blob: Blob, at: int) -> int | None:
    facts = blob.facts("zip")
    if not facts:
        facts["ends"] = _zip_ends(blob.data, blob.places.get(b"PK\5\6", []))
    end = facts["ends"].get(at)
    return end - at if end is not None else None


def _zip_ends(data: bytes, marks: list[int]) -> dict[int, int]:
    """Where the archives of a blob end, by start: each end record tells its own archive's start."""
    out: dict[int, int] = {}
    for end in marks:
        if end + 22 <= len(data):
            size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
            start = end - size - offset
            if start >= 0 and data[end - size : end - size + 4] in (b"PK\1\2", b"PK\5\6") and end + 22 + comment <= len(data):
                out.setdefault(start, end + 22 + comment)
    return out


def _gzip(blob: Blob, at: int) -> int | None:
    """Unpacked to its end. All members of a blob share a budget, as one packed stream can pretend to begin at each of its bytes."""
    d = zlib.decompressobj(31)
    view, n = memoryview(blob.data), len(blob.data)
    p, step = at, 1 << 10
    try:
        while p < n:
            tail = view[p : p + step]
            while tail and not d.eof:  # a bounded output each time: a small blob can't fill the memory
                # Each byte read and each sixteen unpacked cost one.
                got = len(d.decompress(tail, 1 << 20))
                if not blob.spend(len(tail) - len(d.unconsumed_tail) - len(d.unused_data) + got // 16):
                    return None
                tail = d.unconsumed_tail
            p = min(p + step, n)
            if d.eof:
                return p - len(d.unused_data) - at
            step = min(2 * step, 1 << 16)
    except zlib.error:
        pass
    return None


def _ogg(blob: Blob, at: int) -> int | None:
    data = blob.data

    def step(p: int) -> tuple[int | None, tuple | None]:
        if data[p : p + 4] != b"OggS" or p + 27 > len(data) or data[p + 4]:
            return None, (p, None)  # no page: what came before ends here
        n = data[p + 26]
        end = p + 27 + n + sum(data[p + 27 : p + 27 + n])
        return (None, None) if p + 27 + n > len(data) or end > len(data) else (end, None)

    found = _followed(at, blob.facts("ogg"), step, lambda p, x: (x[0], data[p + 5] & 4 if x[1] is None else x[1]))
    # The first page begins a stream, the last one ends it.
    return found[0] - at if found and found[0] > at and found[1] and data[at + 5] & 2 else None


def _midi(blob: Blob, at: int) -> int | None:
    data, n = blob.data, int.from_bytes(blob.data[at + 10 : at + 12], "big")
    if data[at + 4 : at + 8] != b"\0\0\0\6" or not n:
        return None

    def after(p: int, k: int) -> int | None:
        """The place 2^k tracks on; each is looked up once."""
        known = blob.facts(f"midi {k}")
        if p not in known:
            if not k:
                known[p] = p + 8 + int.from_bytes(data[p + 4 : p + 8], "big") if data[p : p + 4] == b"MTrk" else None
            else:
                half = after(p, k - 1)
                known[p] = after(half, k - 1) if half is not None else None
        return known[p]

    p: int | None = at + 14
    for k in range(n.bit_length()):
        if n >> k & 1 and p is not None:
            p = after(p, k)
    return p - at if p is not None and p <= len(data) else None


def _au(blob: Blob, at: int) -> int | None:
    data = blob.data
    if at + 24 > len(data):
        return None
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", data, at + 4)
    ok = 24 <= offset <= 1024 and size != 0xFFFFFFFF and 1 <= encoding <= 27 and rate and 1 <= channels <= 64
    return offset + size if ok and at + offset + size <= len(data) else None


def _pdf(blob: Blob, at: int) -> int | None:
    data, ends = blob.data, blob.places.get(b"%%EOF", [])
    k = bisect_left(ends, at)
    if k == len(ends):
        return None
    end = ends[k]
    return end + 5 - at if b"startxref" in data[max(at, end - 64) : end] and data[at + 5 : at + 6].isdigit() else None


class Format(NamedTuple):
    kind: str
    magic: bytes
    check: Callable[[Blob, int], int | None]


#: Magic bytes (fixed values) and validators.
FORMATS = [
    Format("audio/wav", b"RIFF", _riff(b"WAVE", b"fmt ", b"data")),
    Format("video/avi", b"RIFF", _riff(b"AVI ", b"LIST")),
    Format("image/webp", b"RIFF", _riff(b"WEBP")),
    Format("image/png", b"\x89PNG\r\n\x1a\n", _png),
    Format("image/gif", b"GIF87a", _gif),
    Format("image/gif", b"GIF89a", _gif),
    Format("image/jpeg", b"\xff\xd8\xff", _jpeg),
    Format("image/bmp", b"BM", _bmp),
    Format("application/zip", b"PK\3\4", _zip),
    Format("application/gzip", b"\x1f\x8b\x08", _gzip),
    Format("audio/ogg", b"OggS", _ogg),
    Format("audio/midi", b"MThd", _midi),
    Format("audio/basic", b".snd", _au),
    Format("application/pdf", b"%PDF-", _pdf),
]
#: End markers that validators ask for (fixed values).
MARKERS = [b"PK\5\6", b"%%EOF"]


class Sniffer:
    """The automaton over all magics and end markers."""

    def __init__(self, formats: list[Format] = FORMATS) -> None:
        words: dict[bytes, list[Format]] = {w: [] for w in MARKERS}
        for f in formats:
            words.setdefault(f.magic, []).append(f)
        self.automaton = ahocorasick.Automaton()
        for word, own in words.items():
            self.automaton.add_word(word.decode("latin-1"), (word, own))
        self.automaton.make_automaton()

    def objects(self, data: bytes) -> list[tuple[str, int, int]]:
        """(type, offset, length) of all valid objects, nested ones too, by offset."""
        places: dict[bytes, list[int]] = {}
        starts = []
        for end, (word, formats) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1 - len(word)
            places.setdefault(word, []).append(at)
            if formats:
                starts.append((at, formats))
        blob, found = Blob(data, places), []
        for at, formats in starts:
            for f in formats:
                if (length := f.check(blob, at)) is not None:
                    found.append((f.kind, at, length))
                    break
        return found

    def sniff(self, data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The blob's own type (None unless a valid object starts at byte 0), and the objects within it."""
        found = self.objects(data)
        own = next((o for o in found if o[1] == 0), None)
        return (own[0] if own else None), [o for o in found if o is not own]


def outermost(objects: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without those that lie inside an earlier one."""
    kept, end = [], 0
    for o in sorted(objects, key=lambda o: (o[1], -o[2])):
        if o[1] >= end:
            kept.append(o)
            end = o[1] + o[2]
    return kept


_sniffer: list[Sniffer] = []


def sniffer() -> Sniffer:
    if not _sniffer:
        _sniffer.append(Sniffer())
    return _sniffer[0]


def correct_types(df: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """(id, declared, detected, corrected, size, embedded): detected is null for unknown blobs; embedded holds carved objects."""
    fields = "id long, declared string, detected string, corrected boolean, size long, embedded array<struct<type:string,offset:long,length:long,content:binary>>"
    embedded = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, blob, declared in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kind, inner = sniffer().sniff(blob or b"")
                cut = [{"type": t, "offset": at, "length": n, "content": blob[at : at + n]} for t, at, n in outermost(inner)]
                rows.append((ident, declared, kind, kind is not None and kind != declared, len(blob or b""), cut))
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), embedded]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "declared", "detected", "corrected", "size", "embedded"])

    return project(df, id=df[id_col].cast("long"), blob=df[blob_col].cast("binary"), declared=declared_col).mapInArrow(run, fields)


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file with one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_samples(data: bytes) -> tuple[int, int, bytes]:
    """(rate, channels, samples) of an 8-bit WAV file."""
    p, rate, channels = 12, 0, 0
    while p + 8 <= len(data):
        kind, size = data[p : p + 4], int.from_bytes(data[p + 4 : p + 8], "little")
        if kind == b"fmt ":
            _, channels, rate = struct.unpack_from("<HHI", data, p + 8)
        elif kind == b"data":
            return rate, channels, data[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


#: What the column of media is declared to hold; sniffing corrects it.
DECLARED = "application/octet-stream"
STORED = "id long, n_bytes long, declared string, media binary"
READ = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, n_carved long"
#: Bytes of media in one Arrow batch.
BATCH_BYTES = 16 << 20


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STORED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        rows, held = [], 0
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = (text.as_py() or "").encode()
            rows.append((ident, len(body), DECLARED, wav(body + bytes(-len(body) % BLOCK if body else BLOCK))))
            held += len(body)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for ident, n, declared, media in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            stored = media.as_buffer().to_pybytes()
            kind, inner = sniffer().sniff(stored)
            if kind != "audio/wav":
                raise ValueError(f"stored media of {ident} are {kind}")
            rate, channels, payload = wav_samples(stored)
            samples, carved = np.frombuffer(payload, np.uint8), outermost(inner)
            feature = f"{kind};rate={rate};channels={channels};frames={len(samples) // channels};sum={int(samples.sum())};peak={int(samples.max())};embedded={len(carved)}"
            rows.append((ident, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, declared, kind, len(carved)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def stored(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table (``STORED``) with each text as a media blob; null texts are empty."""
    return materialize(project(df, id=df[id_col].cast("long"), text=text_col).mapInArrow(_store, STORED), "media")


def store_and_read(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Store each text in a column of media, read that column back, sniff, correct its types, carve, and describe (``READ``)."""
    return stored(df, id_col, text_col).mapInArrow(_read, READ)


def op2_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), *[x.split()[0] for x in READ.split(", ")[1:]])


def _le(of: str) -> str:
    """DuckDB SQL: a number below 2^32 as eight hex digits, least byte first."""
    h = f"printf('%08x', {of})"
    return f"substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2)"


def sql() -> str:
    from symlake.llm.sharding import CRC_TABLE_SQL, crc_sql

    head = f"'52494646' || {_le('36 + octet_length(payload)')} || '57415645666d74201000000001000100' || '" + struct.pack("<IIHH", RATE, RATE, 1, 8).hex() + f"64617461' || {_le('octet_length(payload)')}"
    return f"""
{CRC_TABLE_SQL},
d AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
p AS (SELECT doc_id, octet_length(body) AS n_bytes, body || unhex(repeat('00', CASE WHEN octet_length(body) = 0 THEN {BLOCK} ELSE (-octet_length(body)) % {BLOCK} + CASE WHEN octet_length(body) % {BLOCK} = 0 THEN 0 ELSE {BLOCK} END END::INTEGER)) AS payload FROM d),
b AS (SELECT *, list_transform(range(0, octet_length(payload)), lambda i: ('0x' || substr(hex(payload), 2 * i + 1, 2))::BIGINT) AS bytes, unhex({head}) || payload AS media FROM p),
t AS (SELECT *, unhex(substr(hex(payload), 2 * octet_length(payload) - {2 * BLOCK - 1})) AS tail FROM b)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, {crc_sql('tail')} AS tail_crc32,
  octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
  'audio/wav;rate={RATE};channels=1;frames=' || octet_length(payload) || ';sum=' || list_sum(bytes)::BIGINT || ';peak=' || list_max(bytes) || ';embedded=0' AS feature,
  '{DECLARED}' AS declared, 'audio/wav' AS media_type, 0::BIGINT AS n_carved
FROM t, crc_table
"""
