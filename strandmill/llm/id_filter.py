"""Bounded filters of ids: they let through all ids put in, and a few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.words import U, small_batches
from strandmill.session import ship

#: Words of 64 bits in a filter at most: 4 MB.
FILTER_WORDS = 1 << 19


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids, of bounded size: what it lets through in error costs a shuffled text, no more."""
    ids = ids.select("id")
    size = 1 << 10
    n = ids.count()
    while size < min(FILTER_WORDS, n // 4):
        size *= 2
    bits = None
    for seed in (1, 2, 3):
        one = ids.select(F.xxhash64("id", F.lit(seed)).alias("h")).select(F.expr(f"pmod(h, {size})").cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(shiftright(h, 40), 64) as int))").alias("m"))
        bits = one if bits is None else bits.union(one)
    out = np.zeros(size, np.uint64)
    for r in bits.groupBy("w").agg(F.expr("bit_or(m)").alias("m")).collect():
        out[r.w] = r.m % 2**64
    return out


def maybe(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for seed in (1, 2, 3):
        h = xxhash64(ids, seed)
        ok &= filter_[h % len(filter_)] >> ((h >> 40) % 64).astype(np.uint64) & U(1) == 1
    return ok


def xxhash64(ids: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64(id long, seed int), vectorised; signed as in Spark."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << U(r)) | (x >> U(64 - r))

    def end(h):
        h = (h ^ (h >> U(33))) * p2
        h = (h ^ (h >> U(29))) * p3
        return h ^ (h >> U(32))

    with np.errstate(over="ignore"):
        h = np.full(len(ids), U(42), np.uint64) + p5 + U(8)
        h ^= rot(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = end(rot(h, 27) * p1 + p4)
        h = h + p5 + U(4)
        h ^= np.full(len(ids), U(seed), np.uint64) * p1
        h = end(rot(h, 23) * p2 + p3)
    return h.view(np.int64)


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: the rows whose doc_id a bounded filter takes for one of ``ids`` (doc_id), and the others."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids.select(F.col("doc_id").alias("id"))))

    def part(want: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                if t.num_rows:
                    key = t.column(t.schema.get_field_index("doc_id"))
                    there = maybe(sent.value, key.fill_null(0).to_numpy(zero_copy_only=False)) & ~key.is_null().to_numpy(zero_copy_only=False)
                    yield t.filter(pa.array(there == want))

        return small_batches(docs).mapInArrow(task, docs.schema)

    return part(True), part(False)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in ``gone`` (doc_id). Only rows that a bounded filter takes for gone are shuffled."""
    there, others = parted(docs, gone)
    return others.unionByName(there.join(gone, "doc_id", "left_anti").select(*docs.columns))


def single(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs with one row for each doc_id and text among the rows whose doc_id is in ``again`` (doc_id), that with the smallest
    other columns. Only rows that a bounded filter takes for those are shuffled; rows without a doc_id stay."""
    there, others = parted(docs, again)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = there.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    return others.unionByName(one.select("doc_id", "text", "_rest.*"))
