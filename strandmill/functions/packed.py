"""K-mers of at most 31 bases packed into longs, by numpy over Arrow batches.

A read's bytes become two-bit codes in alphabetical order, so the smaller of two packed k-mers is the smaller text, and all
windows of a batch are packed in a few whole-array steps. Windows that hold other letters keep their text beside the code -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.session import ship

#: Bases of a packed k-mer at most, and bytes of sequence that one pass handles; a longer one is handled alone.
MOST_BASES, CHUNK = 31, 1 << 20
_BASES = "ACGT"
_RC = str.maketrans("ACGT", "TGCA")
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(_BASES):
    _CODE[ord(_b)] = _i


def packed_windows(code: np.ndarray, k: int) -> np.ndarray:
    """The number of each window of k codes, first base most significant."""
    out, have = code.astype(np.int64), 1
    for bit in bin(k)[3:]:  # by doubling: windows of 2n from those of n, and one more base where the bit is set
        n = len(out) - have
        out = (out[:n] << 2 * have) | out[have : have + n]
        have *= 2
        if bit == "1":
            n = len(out) - 1
            out = (out[:n] << 2) | code[have : have + n]
            have += 1
    return out


def complement_windows(code: np.ndarray, k: int) -> np.ndarray:
    """The number of each window's reverse complement."""
    return packed_windows((3 - code.astype(np.int64))[::-1], k)[::-1]


def _odd(seq: str, k: int, errors: str, canonical: bool) -> set[str]:
    """The k-mers of a read that hold letters other than the four bases."""
    out, pieces = set(), [seq]
    for e in errors:
        pieces = [x for p in pieces for x in p.split(e)]
    for p in pieces:
        for s in (p,) if canonical else (p, p.translate(_RC)[::-1]):
            for w in (s[i : i + k] for i in range(len(s) - k + 1)):
                if w.strip(_BASES):
                    out.add(min(w, w.translate(_RC)[::-1]) if canonical else w)
    return out


#: Characters beyond ASCII whose lower case holds a letter of ASCII, in UTF-8.
_FOLDED = ("\u212a".encode(), "\u0130".encode())


def letter_codes(letters: str, bases: str) -> np.ndarray:
    """The code of each byte of a text whose letters, of either case, stand for bases; 4 for all else."""
    out = np.full(256, 4, np.uint8)
    for c, b in zip(letters, bases, strict=True):
        out[[ord(c.lower()), ord(c.upper())]] = _BASES.index(b)
    return out


def _kmers(seqs: pa.Array, ids: pa.Array, k: int, errors: str, canonical: bool, codes: np.ndarray | None = None, kept: Callable | None = None) -> pa.RecordBatch:
    """codes: of all bytes, where they are not those of the four bases; what has none is an error. kept: which packed k-mers are wanted."""
    raw = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    raw, at = raw[at[0] : at[-1]], at - at[0]
    if codes is not None and any(x in (own := raw.tobytes()) for x in _FOLDED) and any(x in own.decode() for x in "\u212a\u0130"):
        return _kmers(pa.array([x.lower() for x in seqs.to_pylist()], pa.large_string()), ids, k, errors, canonical, codes, kept)
    code = (_CODE if codes is None else codes)[raw]
    starts = np.zeros(0, np.int64)
    if len(raw) >= k:
        # a window is pure if no letter but a base, and no read's start, lies within it
        wall = np.concatenate([[0], np.cumsum(code == 4)])
        begin = np.zeros(len(raw) + 1, np.int64)
        np.add.at(begin, at[1:-1], 1)
        begin = np.cumsum(begin)
        starts = np.flatnonzero((wall[k:] == wall[:-k]) & (begin[k - 1 : -1] == begin[: len(raw) - k + 1]))
    forth = packed_windows(np.minimum(code, 3), k)[starts] if len(starts) else starts
    back = complement_windows(np.minimum(code, 3), k)[starts] if len(starts) else starts
    owner = np.searchsorted(at, starts, "right") - 1
    number = np.minimum(forth, back) if canonical else np.concatenate([forth, back])
    owner = owner if canonical else np.concatenate([owner, owner])
    if kept is not None:
        own = kept(number)
        number, owner = number[own], owner[own]
    if 2 * k + len(at).bit_length() < 64:  # read and k-mer in one number sort faster
        both = np.sort(owner << 2 * k | number)
        number, owner = both & (1 << 2 * k) - 1, both >> 2 * k
    else:
        order = np.lexsort((number, owner))
        number, owner = number[order], owner[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    number, owner, text = number[new], owner[new], []
    plain = np.zeros(256, bool)
    plain[[ord(c) for c in _BASES + errors if ord(c) < 128]] = True
    strange = np.unique(np.searchsorted(at, np.flatnonzero(~plain[raw]), "right") - 1) if codes is None else np.zeros(0, np.int64)
    for i in strange.tolist():
        own = sorted(_odd(seqs[i].as_py(), k, errors, canonical))
        text += own
        owner = np.append(owner, np.full(len(own), i))
    odd = pa.array([""] * len(number) + text, pa.string()) if text else pa.repeat(pa.scalar("", pa.string()), len(number))
    number = np.append(number, np.full(len(text), -1))
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), odd, ids.take(pa.array(owner))], ["code", "odd", "id"])


def kmer_batches(batches: Iterator[pa.RecordBatch], k: int, canonical: bool = True, errors: str = "N", codes: np.ndarray | None = None, kept: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Batches (code, odd, id) of batches (id, seq), none of whose seq is null."""
    for b in batches:
        seqs = b.column("seq").cast(pa.large_string())
        ends = np.cumsum(np.diff(np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1])) if len(seqs) else np.zeros(0)
        i = 0
        while i < len(seqs):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            yield _kmers(seqs.slice(i, j - i), b.column("id").slice(i, j - i), k, errors, canonical, codes, kept)
            i = j


#: Bases of a window of runs, and of the words by whose least one a k-mer goes to its part.
WINDOW, WORD = 32, 9


def _word_ranks() -> np.ndarray:
    """An order of words in which a word and its reverse complement are the same, and neighbours are far apart."""
    word = np.arange(1 << 2 * WORD, dtype=np.uint32)
    back = np.zeros_like(word)
    for i in range(WORD):
        back |= (3 - (word >> np.uint32(2 * i) & np.uint32(3))) << np.uint32(2 * (WORD - 1 - i))
    return np.minimum(word, back) * np.uint32(0x9E3779B1) & np.uint32((1 << 2 * WORD) - 1)


_RANK = _word_ranks()


def _runs_of(seqs: pa.Array, k: int, bits: int, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, window, n, read): runs of n k-mers that follow one another in a read and go to the same of 2**bits parts, by parts and then by reads; window: the bases
    from the first on, the others 0. A k-mer and its reverse complement go to the same part."""
    raw = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    raw, at = raw[at[0] : at[-1]], at - at[0]
    code = np.full(len(raw) + len(seqs) + WINDOW, 4, np.uint8)  # a wall after each read
    inside = np.ones(len(raw) + len(seqs), bool)
    inside[at[1:] + np.arange(len(seqs))] = False
    code[: len(inside)][inside] = (_CODE if codes is None else codes)[raw]
    wall = np.zeros(len(code) + 1, np.int32)
    np.cumsum(code == 4, out=wall[1:])
    n = len(code) - WINDOW
    pure = wall[k : k + n] == wall[:n]
    del wall, inside
    code = np.minimum(code, 3)
    eight = code.astype(np.uint16)
    for have in (1, 2, 4):
        eight = eight[:-have] << np.uint16(2 * have) | eight[have:]
    rank = _RANK[eight[: n + k - WORD].astype(np.uint32) << np.uint32(2) | code[8 : 8 + n + k - WORD]]
    words, have = k - WORD + 1, 1
    while 2 * have <= words:
        rank, have = np.minimum(rank[:-have], rank[have:]), 2 * have
    if have < words:
        rank = np.minimum(rank[: have - words], rank[words - have :])
    part = (rank[:n] * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)).astype(np.int32)
    part[~pure] = -1
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if n else np.zeros(0, np.int64)
    times = np.diff(np.append(first, n))
    times, first = times[part[first] >= 0], first[part[first] >= 0]
    most = WINDOW - k + 1
    pieces = -(-times // most)
    start = np.repeat(first, pieces) + most * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    times = np.minimum(np.repeat(first + times, pieces) - start, most)
    part = part[start].astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part, start, times = part[order], start[order], times[order]
    window = np.zeros(len(start), np.uint64)
    for i in range(0, WINDOW, 8):
        window = window << np.uint64(16) | eight[np.minimum(start + i, len(eight) - 1)]
    rest = (2 * (WINDOW - k + 1 - times)).astype(np.uint64)
    return part, window >> rest << rest, times.astype(np.uint8), np.searchsorted(at[1:] + np.arange(len(seqs)), start, "right")


def kmer_runs(batches: Iterator[pa.RecordBatch], k: int, bits: int, canonical: bool = True, errors: str = "N", codes: np.ndarray | None = None) -> Iterator[tuple]:
    """What ``_runs_of`` gives of batches (id, seq), none of whose seq is null, with the ids of reads in place of their numbers, and (k-mer, id) of k-mers with other letters."""
    plain = np.zeros(256, bool)
    plain[[ord(c) for c in _BASES + errors if ord(c) < 128]] = True
    for b in batches:
        seqs, ids = b.column("seq").cast(pa.large_string()), b.column("id").cast(pa.int64()).to_numpy()
        ends = np.cumsum(np.diff(np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1])) if len(seqs) else np.zeros(0)
        i = 0
        while i < len(seqs):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            own, odd = seqs.slice(i, j - i), []
            at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            if codes is not None:
                if any(x in (data := raw.tobytes()) for x in _FOLDED) and any(x in data.decode() for x in "\u212a\u0130"):
                    own = pa.array([x.lower() for x in own.to_pylist()], pa.large_string())
            else:
                strange = np.unique(np.searchsorted(at - at[0], np.flatnonzero(~plain[raw]), "right") - 1)
                odd = [(x, int(ids[i + r])) for r in strange.tolist() for x in sorted(_odd(own[r].as_py(), k, errors, canonical))]
            part, window, n, read = _runs_of(own, k, bits, codes)
            yield part, window, n, ids[i + read], odd
            i = j


def kmers_of_runs(window: np.ndarray, n: np.ndarray, read: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers, reads) of runs."""
    every = np.uint64(2 ** (2 * k) - 1)
    back = ~window
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        back = back >> np.uint64(shift) & np.uint64(mask) | (back & np.uint64(mask)) << np.uint64(shift)
    back = back.byteswap()
    times = n.astype(np.int64)
    by = (2 * (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times))).astype(np.uint64)
    back = np.repeat(back, times) >> by & every
    forth = np.repeat(window, times) >> np.uint64(2 * (WINDOW - k)) - by & every
    read = np.repeat(read, times)
    return (np.minimum(forth, back), read) if canonical else (np.concatenate([forth, back]), np.concatenate([read, read]))


def packed_kmers(reads: DataFrame, k: int, canonical: bool = True, errors: str = "N") -> DataFrame:
    """(code, odd, id): each k-mer of a read once, packed, or its text where it holds other letters (then code is -1)."""
    if not 1 <= k <= MOST_BASES:
        raise ValueError(f"a packed k-mer has 1 to {MOST_BASES} bases")
    ship(reads.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kmer_batches(batches, k, canonical, errors)

    kind = reads.schema["id"].dataType.simpleString()
    return reads.where(F.col("seq").isNotNull()).select("id", "seq").mapInArrow(task, f"code long, odd string, id {kind}")


#: Fixed by the codes: the four bases of each byte.
_FOURS = np.array([[_BASES[b >> s & 3] for s in (6, 4, 2, 0)] for b in range(256)])


def unpacked(rows: DataFrame, k: int) -> DataFrame:
    """rows with ``kmer``, the text of its packed k-mers, in place of code and odd."""
    letters = np.array([[ord(c) for c in x] for x in _FOURS], np.uint8)
    rest = [f for f in rows.schema if f.name not in ("code", "odd")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column("code").to_numpy()
            data = letters[code.astype(">i8").view(np.uint8)].reshape(len(code), 32)[:, 32 - k :]
            ends = np.arange(len(code) + 1, dtype=np.int32) * k
            text = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
            if (code < 0).any():
                text = pa.array([t if c < 0 else x for c, x, t in zip(code.tolist(), text.to_pylist(), b.column("odd").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text, *(b.column(f.name) for f in rest)], ["kmer", *(f.name for f in rest)])

    return rows.mapInArrow(task, "kmer string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest))
