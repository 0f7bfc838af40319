"""Removal of long repeated passages, found by recompression.

Recompression rewrites each document's words in rounds. A run round names every maximal run of one symbol; a pair round
splits all symbols into left and right ones by a hash and names every adjacent (left, right) pair. Names are hashes of
contents, so all documents of all tasks agree on them without an exchange, and equal passages get equal symbols in their
interior. For each symbol the range of words that decided it is kept: a symbol whose range lies within a window of ``window``
words stands in every copy of that window.

1. Documents of one word sequence are one: all words of all but the smallest are in windows that repeat, and only the
   smallest goes on.
2. A window's landmark is its first symbol of the highest round that has one decided within the window; round 0 always has.
   Equal windows have equal landmarks. Consecutive windows of one landmark make a run. Spark counts documents by landmark:
   only runs of landmarks in several documents can lead to repeats.
3. Spark finds the smallest document of each run, named by 128 bits of BLAKE2b of all its words. In every larger one all
   windows of the run repeat, and they are in the smallest, too: only the runs of the smallest go on.
4. The windows of these are named likewise, and Spark finds the smallest document of each.

A name stands for the bytes of its words: what is removed does not rest on the hashes that symbols are named by, which differ
from a dealt number only in that tasks agree on them without an exchange of all symbols for each round.

Only landmarks, names and positions are shuffled, and the texts of documents with shared runs. Keys of many rows are
pre-aggregated, and joined back by a broadcast of bounded size.

A null text has no words; a document of fewer words than a window loses none. Rows whose doc_id is null are neither removed
from nor count as smaller. Repeated rows of one doc_id are each judged by their own text. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.id_filter import id_filter, maybe
from strandmill.llm.words import SPACED, U, joined, mix, names, sliced, small_batches, text_names, words
from strandmill.operators.joins import MOST_HEAVY, looked_up
from strandmill.session import cut, ship, uncut

WINDOW = 50
#: Rounds in order: r names runs, p names pairs.
ROUNDS = "rppprppppp"


class Level:
    """Symbols after a round, of all texts of a batch one after another."""

    def __init__(self, name: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.text, self.low, self.high = name, text, low, high  # [low, high): the words that decided the symbol


def _neighbours(s: Level, first: np.ndarray, last: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest deciding word of what stands before symbols ``first``, and the highest of what stands after ``last``; beyond
    the text where nothing does, as another copy of the passage may have a neighbour there."""
    before = np.maximum(first - 1, 0)
    low = np.where((first > 0) & (s.text[before] == s.text[first]), s.low[before], docs[s.text[first]] - 1)
    after = np.minimum(last + 1, len(s.name) - 1)
    high = np.where((last + 1 < len(s.name)) & (s.text[after] == s.text[last]), s.high[after], docs[s.text[last] + 1] + 1)
    return low, high


def run_round(s: Level, docs: np.ndarray) -> Level:
    n = len(s.name)
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size > 1, mix(s.name[first] * U(0xD1342543DE82EF95) + size), s.name[first])
    low, high = _neighbours(s, first, last, docs)
    return Level(name, s.text[first], low, high)


def pair_round(s: Level, docs: np.ndarray, turn: int) -> Level:
    n = len(s.name)
    right = mix(s.name ^ U(turn * 0x9E3779B97F4A7C15 % 2**64)) >> U(63) == 1
    starts = np.zeros(n, bool)
    starts[:-1] = ~right[:-1] & right[1:] & (s.text[:-1] == s.text[1:])
    ends = np.zeros(n, bool)
    ends[1:] = starts[:-1]
    every = np.arange(n)
    before, after = _neighbours(s, every, every, docs)
    # a left symbol was left alone because of what follows, a right one because of what precedes
    low = np.where(right & ~ends, np.minimum(s.low, before), s.low)
    high = np.where(~right & ~starts, np.maximum(s.high, after), s.high)
    keep = np.flatnonzero(~ends)
    paired = starts[keep]
    mate = np.minimum(keep + 1, n - 1)
    name = np.where(paired, mix(s.name[keep] * U(0xAF251AF3B0F025B5) + mix(s.name[mate] + U(1))), s.name[keep])
    return Level(name, s.text[keep], np.where(paired, s.low[keep], low[keep]), np.where(paired, s.high[mate], high[keep]))


def levels(h: np.ndarray, docs: np.ndarray, rounds: str = ROUNDS) -> list[Level]:
    at = np.arange(len(h))
    out = [Level(h, np.repeat(np.arange(len(docs) - 1), np.diff(docs)), at, at + 1)]
    for i, kind in enumerate(rounds):
        out.append(run_round(out[-1], docs) if kind == "r" else pair_round(out[-1], docs, i + 1))
    return out


def window_starts(docs: np.ndarray, window: int) -> np.ndarray:
    n = int(docs[-1])
    left = np.repeat(docs[1:], np.diff(docs)) - np.arange(n)
    return np.flatnonzero(left >= window)


def landmarks(h: np.ndarray, docs: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The landmark of the windows that start at words ``at``."""
    out = np.zeros(len(at), np.uint64)
    left = np.arange(len(at))
    steps = levels(h, docs)
    for k in range(len(steps) - 1, -1, -1):
        s = steps[k]
        i = np.minimum(np.searchsorted(s.low, at[left]), len(s.low) - 1)
        ok = (s.low[i] >= at[left]) & (s.high[i] <= at[left] + window)
        out[left[ok]] = mix(s.name[i[ok]] + U(k))
        left = left[~ok]
        if not len(left):
            break
    return out


def _own(docs: DataFrame) -> DataFrame:
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


RUN = "mark:long,k1:long,k2:long,start:int,n:int"


def _parsed(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n1, n2, runs) of every document with a window: names of its whole text, and its runs of n windows each with
    their landmark, name and first word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            w = words(b.column("text"), SPACED, lower=False)
            at = window_starts(w.docs, window)
            if not len(at):
                continue
            m = landmarks(w.hash, w.docs, at, window)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            at, m = at[first], m[first]
            doc = np.searchsorted(w.docs, at, "right") - 1
            flat, start, end = joined(w)
            k = names(flat, start[at], end[at + n + window - 2])
            own, begins = np.unique(doc, return_index=True)
            whole = text_names(w)[own]
            runs = pa.StructArray.from_arrays([pa.array(m.view(np.int64)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array((at - w.docs[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["mark", "k1", "k2", "start", "n"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), runs)], ["doc_id", "n1", "n2", "runs"])

    return _own(docs.where("doc_id is not null")).mapInArrow(task, f"doc_id long, n1 long, n2 long, runs array<struct<{RUN}>>")


def _in_filter(parsed: DataFrame, marks: DataFrame) -> DataFrame:
    """(mark, k1, k2, doc_id, place, n) of the runs whose landmark a bounded filter of ``marks`` lets through. A place is a
    word's, with 32 bits of the text's name above it."""
    sent = parsed.sparkSession.sparkContext.broadcast(id_filter(marks.select(F.col("mark").alias("id"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column("runs")
                flat = lists.flatten()
                owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                ok = np.flatnonzero(maybe(sent.value, flat.field("mark").to_numpy()))
                flat, owner = flat.take(pa.array(ok)), owner[ok]
                place = _above(b.column("n1").to_numpy())[owner] | flat.field("start").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("mark", "k1", "k2")), b.column("doc_id").take(pa.array(owner)), pa.array(place), flat.field("n")], ["mark", "k1", "k2", "doc_id", "place", "n"])

    return parsed.select("doc_id", "n1", "runs").mapInArrow(task, "mark long, k1 long, k2 long, doc_id long, place long, n int")


def _above(n1: np.ndarray) -> np.ndarray:
    """The upper 32 bits of texts' names."""
    return n1 >> 32 << 32


def _some(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs parted by a bounded filter of ids: those in ids with a few others, and the rest. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def part(want: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    key = b.column(0)
                    in_ = maybe(sent.value, key.fill_null(0).to_numpy(zero_copy_only=False)) & ~key.is_null().to_numpy(zero_copy_only=False)
                    yield b.filter(pa.array(in_ == want))

        return _own(docs).mapInArrow(task, "doc_id long, text string")

    return part(True), part(False)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, doc_id, place, n = 1) of the windows of the row's runs (places and ns)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            w = words(b.column("text"), SPACED, lower=False)
            flat, start, end = joined(w)
            key, count = _above(text_names(w)[:, 0]), w.count()
            for i, runs in enumerate(b.column("runs").to_pylist()):
                at = np.array([(r["place"], r["n"]) for r in runs], np.int64).reshape(-1, 2)
                at = at[at[:, 0] >> 32 == key[i] >> 32]
                first, n = at[:, 0] & 0xFFFFFFFF, at[:, 1]
                for j in range(0, len(first), 1 << 14):
                    size = n[j : j + (1 << 14)]
                    p = np.repeat(first[j : j + (1 << 14)] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    p = p[p + window <= count[i]]
                    k = names(flat, start[w.docs[i] + p], end[w.docs[i] + p + window - 1])
                    yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), b.column("doc_id").take(pa.array(np.full(len(p), i))), pa.array(key[i] | p), pa.array(np.ones(len(p), np.int32))], ["k1", "k2", "doc_id", "place", "n"])

    return small_batches(docs).mapInArrow(task, "k1 long, k2 long, doc_id long, place long, n int")


#: The number of windows that stands for all of a text, and rows of a broadcast table of copies (16 MB).
ALL, MOST_COPIES = 0, 1 << 18
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(texts: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """texts: doc_id, text and the runs of windows to be removed (null: none)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            w = words(b.column("text"), SPACED, lower=False)
            delta = np.zeros(len(w.hash) + 1, np.int64)
            lists = b.column("gone").to_pylist()
            key = _above(text_names(w)[:, 0]) if any(lists) else None
            for i, x in enumerate(lists):
                if x:
                    at = np.array([(r["place"], r["n"]) for r in x], np.int64)
                    at = at[at[:, 0] >> 32 == key[i] >> 32]
                    first, n = w.docs[i] + (at[:, 0] & 0xFFFFFFFF), at[:, 1]
                    np.add.at(delta, first, 1)
                    np.add.at(delta, np.where(n == ALL, w.docs[i + 1], np.minimum(first + n - 1 + window, w.docs[i + 1])), -1)
            gone = np.cumsum(delta[:-1]) > 0
            data, texts_ = w.data.tobytes(), []
            start, end = w.start[~gone].tolist(), w.end[~gone].tolist()
            left = np.concatenate([[0], np.cumsum(~gone)])[w.docs].tolist()
            for a, z in zip(left, left[1:], strict=False):
                texts_.append(b" ".join([data[p:q] for p, q in zip(start[a:z], end[a:z], strict=True)]))
            count = w.count()
            columns = [b.column("doc_id"), pa.array(count, pa.int64()), pa.array(count - np.diff(left), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts_], pa.string())]
            own = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([x.decode() for x in texts_], pa.string()))
                own.append("kept")
            yield pa.RecordBatch.from_arrays(columns, own)

    return small_batches(texts).mapInArrow(task, KEPT + ", kept string" * keep_text)


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows (k1, k2, doc_id, place, n) with ``lo``, the smallest document of the same name, and whether they are the ``first``
    of their name, by doc_id and place.

    Rows are shuffled once and ranked within their name. Names that a sample shows to hold more than a share of about
    1 / MOST_HEAVY of all rows, 2 * MOST_HEAVY at most, are aggregated first and joined back by broadcast instead.
    """
    keys, share = ["k1", "k2"], min(1.0, 200_000 / max(1, total))
    least = max(20.0, share * max(1000, total // MOST_HEAVY) / 2)
    counted = rows.sample(fraction=share, seed=7).groupBy(*keys).agg(F.count("*").alias("times")).where(F.col("times") > least)
    heavy = rows.sparkSession.createDataFrame(counted.orderBy(F.col("times").desc()).limit(2 * MOST_HEAVY).select(*keys).collect(), "k1 long, k2 long")
    by = Window.partitionBy(*keys).orderBy("doc_id", "place")
    ranked = lambda x: x.select("doc_id", "place", "n", F.first("doc_id").over(by).alias("lo"), (F.row_number().over(by) == 1).alias("first"))
    if heavy.isEmpty():
        return ranked(rows)
    hot = rows.join(F.broadcast(heavy), keys, "left_semi")
    least_of = hot.groupBy(*keys).agg(F.min(F.struct("doc_id", "place")).alias("least"))
    joined_ = hot.join(F.broadcast(least_of), keys).select("doc_id", "place", "n", F.col("least.doc_id").alias("lo"), (F.struct("doc_id", "place") == F.col("least")).alias("first"))
    return ranked(rows.join(F.broadcast(heavy), keys, "left_anti")).union(joined_)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with keep_text, the kept words joined by spaces too."""
    ship(docs.sparkSession)
    parsed = cut(_parsed(docs, window), "parsed")
    texts = parsed.select("doc_id", "n1", "n2")
    # copies of a whole text: all their windows start in its smallest document
    lowest = texts.groupBy("n1", "n2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("times")).where("lo < hi").select("n1", "n2", "lo", "times")
    copies = cut(looked_up(texts, lowest, ["n1", "n2"], texts.count()).where("doc_id > lo").select("doc_id", "n1", "n2").distinct(), "copies")
    gone_by = copies if copies.count() > MOST_COPIES else F.broadcast(copies)
    own = parsed.join(gone_by, ["doc_id", "n1", "n2"], "left_anti").select("doc_id", "n1", "runs")
    # a document's marks are distinct, so a mark that counts twice is in several (or in repeated rows, which costs time only)
    marks = own.select(F.explode(F.array_distinct(F.transform("runs", lambda r: r["mark"]))).alias("mark"))
    shared = cut(marks.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    near = cut(_in_filter(own, shared), "near")
    uncut(parsed)
    runs = cut(looked_up(near, shared, ["mark"], near.count()).select("k1", "k2", "doc_id", "place", "n"), "runs")
    for done in (shared, near):
        uncut(done)
    ranked = cut(_ranked(runs, runs.count()), "ranked")
    uncut(runs)
    lists = cut(ranked.where("first").groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("runs")), "lists")
    some, _ = _some(docs, lists.select(F.col("doc_id").alias("id")))
    found = cut(_windows(some.join(lists, "doc_id").select("doc_id", "text", "runs"), window), "windows")
    uncut(lists)
    whole = copies.select("doc_id", F.expr("shiftleft(shiftright(n1, 32), 32)").alias("place"), F.lit(ALL).alias("n"))
    later = ranked.union(_ranked(found, found.count())).where("doc_id > lo").select("doc_id", "place", "n")
    gone = cut(later.union(whole).groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("gone")), "gone")
    for done in (ranked, found, copies):
        uncut(done)
    some, rest = _some(docs, gone.select(F.col("doc_id").alias("id")))
    hit = some.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    none = F.lit(None).cast("array<struct<place:long,n:int>>")
    return _kept(hit, window, keep_text).union(_kept(rest.withColumn("gone", none), window, keep_text))
