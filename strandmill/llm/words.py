"""Words of Arrow text columns as flat numpy arrays: positions in the UTF-8 buffer and 64-bit hashes.

No Python object is made per word. A word's hash chains its bytes eight at a time through a bijective, non-linear mixer; long
ranges take BLAKE2b. Hashes only find candidates: what a result rests on is compared by bytes (``same``, ``clashes``).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes that one pass of the numpy code handles; a longer text is handled alone.
CHUNK = 512 << 10
#: Ranges of more bytes than this are hashed by BLAKE2b and compared as slices.
LONG = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inside(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = _inside([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: [^\x20\x09-\x0D]
SPACED = ~_inside([(0x20, 0x20), (0x09, 0x0D)])

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number, zeros after the last: a view that copies raw once."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", buffer=padded.data, strides=(1,))


#: What keeps the first 0 to 8 bytes of a number.
_FIRST = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)


def hashes(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal contents, equal hashes."""
    size = end - start
    h = mix(eight[start] & _FIRST[np.minimum(size, 8)] ^ size.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    rest, j = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rest):
        h[rest] = mix(h[rest] * U(0xC2B2AE3D27D4EB4F) ^ eight[start[rest] + j] & _FIRST[np.minimum(size[rest] - j, 8)])
        j += 8
        rest = rest[size[rest] > j]
    for i in np.flatnonzero(size > LONG).tolist():
        part = (eight[start[i] : end[i]] & U(0xFF)).astype(np.uint8)
        h[i] = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little")
    return h


def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``at`` on in a (of ``eights``) are those from ``bt`` on in b."""
    ok = np.ones(len(size), bool)
    rest, j = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(rest):
        equal = (a[at[rest] + j] ^ b[bt[rest] + j]) & _FIRST[np.minimum(size[rest] - j, 8)] == 0
        ok[rest[~equal]] = False
        rest = rest[equal]
        j += 8
        rest = rest[size[rest] > j]
    for i in np.flatnonzero(size > LONG).tolist():
        p, q, n = int(at[i]), int(bt[i]), int(size[i]) - 7
        ok[i] = np.array_equal(a[p : p + n], b[q : q + n])
    return ok


def firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, where each occurs first, and for each place the index of its hash."""
    return np.unique(h, return_index=True, return_inverse=True)


def clashes(eight: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The places whose bytes are not those of the first place with the same hash (``firsts``): empty but for collisions."""
    one = first[back]
    odd = (end - start) != (end - start)[one]
    odd[~odd] = ~same(eight, start[~odd], eight, start[one][~odd], (end - start)[~odd])
    return np.flatnonzero(odd)


@dataclass
class Words:
    data: np.ndarray  # the chunk's UTF-8 bytes
    texts: np.ndarray  # [d + 1] where each text starts in data
    start: np.ndarray  # [n] where each word starts in data
    end: np.ndarray
    hash: np.ndarray  # [n] uint64
    docs: np.ndarray  # [d + 1] each text's first word
    low: np.ndarray  # data, lower-cased if words are
    eight: np.ndarray  # eights() of low

    def count(self) -> np.ndarray:
        return np.diff(self.docs)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and d + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array, inside: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    """Words of a text column. inside: for each byte, whether it belongs to words; hashed: whether to hash them."""
    raw, at = buffer(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, at, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64), raw, eights(raw))
    mask = inside[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    edge = at[at < n]
    before[edge] = False
    start = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    edge = at[at > 0] - 1
    after[edge] = False
    end = np.flatnonzero(mask & ~after) + 1
    low = _LOWER[raw] if lower else raw
    eight = eights(low)
    return Words(raw, at, start, end, hashes(eight, start, end) if hashed else np.zeros(0, np.uint64), np.searchsorted(start, at).astype(np.int64), low, eight)


def joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words with one blank between those of a text, and where each word starts and ends in them."""
    size = w.end - w.start
    last = np.zeros(len(size), bool)
    last[w.docs[1:][w.count() > 0] - 1] = True
    room = size + ~last
    start = np.cumsum(room) - room
    flat = np.full(int(room.sum()), 0x20, np.uint8)
    keep = np.ones(len(flat), bool)
    keep[(start + size)[~last]] = False
    mask = np.zeros(len(w.low) + 1, np.int8)
    mask[w.start] += 1
    mask[w.end] -= 1
    flat[keep] = w.low[np.cumsum(mask[:-1], dtype=np.int8) > 0]
    return flat, start, start + size


def names(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[n, 2] the two longs of 128 bits of BLAKE2b of the byte ranges [start, end): equal names, equal bytes."""
    data = memoryview(np.ascontiguousarray(flat))
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def text_names(w: Words) -> np.ndarray:
    """[d, 2] ``names`` of each text's words, whatever stands between them; texts without words share one."""
    flat, start, end = joined(w)
    begins = np.append(start, len(flat))
    some = w.count() > 0
    a = np.where(some, begins[np.minimum(w.docs[:-1], len(start))], 0)
    b = np.where(some, end[np.maximum(w.docs[1:] - 1, 0)] if len(end) else 0, 0)
    return names(flat, a, b)


def collide(w: Words, k: int) -> bool:
    """Whether different words, or different sequences of k of them, have one hash: else their hashes are exact."""
    if not len(w.hash):
        return False
    _, first, back = firsts(w.hash)
    if len(clashes(w.eight, w.start, w.end, first, back)):
        return True
    h, at = runs(w.hash, w.docs, k)
    if not len(h):
        return False
    _, first, back = firsts(h)
    one = at[first][back]
    return any((w.hash[at + i] != w.hash[one + i]).any() for i in range(k))


def runs(h: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within one text, and the word where each starts."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s = mix(s * U(0xC2B2AE3D27D4EB4F) + h[i : n - k + 1 + i])
    s = mix(s + U(k))
    left = np.repeat(docs[1:], np.diff(docs))[: n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(left >= k)
    return s[at], at


def whole(h: np.ndarray, k: int) -> int:
    """The hash that stands for a sequence of fewer than k words."""
    s = np.array([len(h)], np.uint64)
    for i in range(len(h)):
        s = mix(s * U(0xC2B2AE3D27D4EB4F) + h[i : i + 1])
    return int(mix(s ^ U(0x9E3779B97F4A7C15))[0])


#: Tables that operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def give_back() -> None:
    """Return freed memory to the system: idle workers stay, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text comes alone.

    Tables that earlier tasks kept in this worker go first, unless ``keep``.
    """
    if not keep:
        for kept in KEPT:
            kept.clear()
    for b in batches:
        if not b.num_rows:
            continue
        _, at = buffer(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
    give_back()


def small_batches(df, rows: int = 1000):
    """Bound the rows that Spark puts into one Arrow batch; returns the frame itself."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def carried(df, keep: list[str] | None, own: str) -> tuple[list, list[str]]:
    """Columns of df to carry along, and their names in a result with the columns ``own`` (a schema, "text" reserved unless it
    is kept itself): one whose name is taken, in whatever case, comes back with "_in" behind it."""
    taken, columns, names = {x.split()[0].lower() for x in own.split(", ")}, [], []
    for c in keep or []:
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        columns.append(df[c].alias(name))
        names.append(name)
    return columns, names
