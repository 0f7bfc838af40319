"""Token-id output in a packed binary format.

Every id takes the fewest bits that the vocabulary needs. A file holds, in ascending ``doc_id`` order:

    magic b"SMTB", version u16, bits u16, ids in a block u32, documents u64, ids u64, blocks u64   (40 bytes, little-endian)
    doc_ids i64[documents], flags u8[documents] (1: the id was null), offsets u64[documents + 1] (of a document's first id)
    block offsets u64[blocks + 1] (bytes from the start of the packed part), then the packed blocks

A block is unpacked by numpy in one step, and a document's ids need only the blocks that hold them, so reads are random
access. Files are written under a temporary name and renamed: a task that runs again writes the same bytes to the same
place. Null texts are empty; repeated and null doc_ids are kept (nulls first, ties by text); an empty table writes no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import pieces
from strandmill.llm.words import SPACED, small_batches, sliced, words
from strandmill.session import new_path, ship

MAGIC, HEAD = b"SMTB", struct.Struct("<4sHHIQQQ")
BLOCK = 1 << 13
#: Ids of one file; a task with more writes several.
FILE_IDS = 8 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids below 2**bits, little-endian bit order."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    low = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(low.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


def to_bytes(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    at = list(accumulate((len(x) for x in packed), initial=0))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, 1, bits, block, len(doc_ids), len(ids), len(packed)), doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), offsets.tobytes(), np.array(at, "<u8").tobytes(), *packed])


class Reader:
    """One file, open for random access. f: a seekable binary file."""

    def __init__(self, f) -> None:
        self.f = f
        magic, version, self.bits, self.block, docs, self.total, blocks = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        self.null = np.frombuffer(f.read(docs), np.uint8).astype(bool)
        self.offsets = np.frombuffer(f.read(8 * (docs + 1)), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.base = HEAD.size + 9 * docs + 8 * (docs + 1) + 8 * (blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at positions [start, end) of this file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.f.seek(self.base + int(self.blocks[first]))
        data = self.f.read(int(self.blocks[last + 1] - self.blocks[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.total - b * self.block)
            parts.append(unpack(data[int(self.blocks[b] - self.blocks[first]) : int(self.blocks[b + 1] - self.blocks[first])], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1]))


def encoded(column: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text, one text after another, each with end_id, and how many each has.

    White space always parts tokens of this vocabulary and yields none, so words are exact pieces; so are their parts, as a symbol
    of ``pieces.SYMBOLS`` after an ASCII letter or digit always begins another token.
    """
    w = words(column, SPACED, lower=False, hashed=False)
    start, end, docs = w.start, w.end, w.docs
    if len(w.data) > 1:
        cut = pieces.LETTERS_DIGITS[w.data[:-1]] & pieces.SYMBOLS[w.data[1:]]
        cut[w.texts[(w.texts > 0) & (w.texts < len(w.data))] - 1] = False  # texts part there already
        at = np.flatnonzero(cut) + 1
        start, end = (np.sort(np.concatenate([x, at]), kind="stable") for x in (start, end))
        docs = np.searchsorted(start, w.texts)
    encoder = pieces.encoder(path, "<|startoftext|>").ends_words("</w>")
    ids, size = encoder.ids(w.data.tobytes(), w.eight, start, end)
    count = np.diff(np.concatenate([[0], np.cumsum(size)])[docs])
    if end_id is None:
        return ids, count
    return np.insert(ids, np.cumsum(count), end_id), count + 1


FILES = "path string, part int, piece int, docs long, ids long"


def write(docs: DataFrame, to: str, tokenizer: str, vocabulary: int, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files under ``to``; a row for each file, in the order of the corpus.

    One range exchange brings the texts into ``doc_id`` order; ids are made after it, so they are never shuffled.
    """
    ship(docs.sparkSession)
    bits = bits_for(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(to)
        context, piece, held, n = TaskContext.get(), 0, [], 0

        def flush():
            nonlocal piece, held, n
            path = f"{root}/part-{context.partitionId():06d}-{piece:05d}.smtb"
            tmp = f"{root}/.part-{context.partitionId():06d}-{piece:05d}.{context.taskAttemptId()}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(tmp) as f:
                f.write(to_bytes(*(np.concatenate(x) for x in zip(*held, strict=True)), bits))
            store.move(tmp, path)
            row = {"path": path, "part": context.partitionId(), "piece": piece, "docs": sum(len(x[0]) for x in held), "ids": n}
            piece, held, n = piece + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for b in sliced(batches, "text", 2 << 20, keep=True):
            ids, count = encoded(b.column("text"), tokenizer, end_id)
            key = b.column("doc_id")
            held.append((key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), key.is_null().to_numpy(zero_copy_only=False), count, ids.astype(np.uint16 if bits <= 16 else np.uint32)))
            n += len(ids)
            if n >= FILE_IDS:
                yield flush()
        if held:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return small_batches(texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")).mapInArrow(task, FILES)


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_summary(files: DataFrame, to: str) -> DataFrame:
    """Read files (path, start) back: a row for each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(to)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    r = Reader(f)
                    lo = 0
                    while lo < len(r.doc_ids):  # about a million ids at a time
                        hi = max(lo + 1, int(np.searchsorted(r.offsets, r.offsets[lo] + (1 << 20), "right")) - 1)
                        ids = r.ids(int(r.offsets[lo]), int(r.offsets[hi])).astype("<u4").tobytes()
                        at = (4 * (r.offsets[lo : hi + 1] - r.offsets[lo])).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[lo:hi], mask=r.null[lo:hi]), pa.array(r.offsets[lo:hi] + start), pa.array(np.diff(r.offsets[lo : hi + 1])), pa.array([zlib.crc32(ids[p:q]) for p, q in zip(at, at[1:], strict=False)], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        lo = hi

    return files.mapInArrow(task, ROWS)


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int | None = 2) -> DataFrame:
    """Write token files and read them back: (doc_id, start, n_tokens, ids_crc32) of every document.

    The driver holds one row for each file written (8 million ids each), as any writer's commit does.
    """
    spark = docs.sparkSession
    to = new_path(spark, "tokens")
    made = sorted(write(docs, to, tokenizer, vocabulary, end_id).collect(), key=lambda r: (r.part, r.piece))
    starts = list(accumulate((r.ids for r in made), initial=0))
    files = spark.createDataFrame([(r.path, s) for r, s in zip(made, starts, strict=False)], "path string, start long")
    return read_summary(files.repartition(max(1, min(len(made), spark.sparkContext.defaultParallelism * 4))), to)
