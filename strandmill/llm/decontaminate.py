"""Benchmark decontamination by a prefix-filtered join of documents with item windows.

A window is ``size`` consecutive words of an item, or all words of an item with fewer. Its set is its word shingles
(``shingle`` words each; a shorter window is one shingle). Shingles are ordered by rarity, that is by how often they occur in
all documents. Since a window must be contained whole, its prefix of one token, the rarest shingle, suffices: a document
that lacks it cannot contain the window. Where a document has a prefix token, the token's place within the window fixes where
the window would start (the positional bound); it must lie within the document (the length bound), and then all its words are
compared.

The benchmark is taken in blocks of about ``block_bytes`` of text, measured before anything is sent out: an index takes some
20 bytes for each of them, 60 where words are single letters. Documents are read twice for each block, and with one block they
are never shuffled. What is hit depends on a text alone, so the hits of several blocks are written down by the SHA-256 of
texts, one block after the other, and joined to the documents: several blocks give the same rows as one. An item longer than
a block makes a block by itself.

Nulls have no words: a null text has no hits, a null item none either. An item or a document without words is not
contaminated. Repeated items hit like single ones, each under its own id; repeated documents are kept, and so are those
without an id. Empty tables give no rows, or no hits. Other columns are ignored; of those in ``keep``, one with a name of the
result's own comes back with "_in" behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.pieces import take
from strandmill.llm.words import ALNUM, carried, firsts, mix, runs, same, sliced, small_batches, words
from strandmill.session import cut, ship

SIZE, SHINGLE, BLOCK_BYTES = 13, 5, 4 << 20


class Windows:
    """The distinct windows of a block of items: their words, their owners and the shingles within them."""

    def __init__(self, items: pa.Table, size: int, shingle: int) -> None:
        w = words(items.column("text").combine_chunks(), ALNUM, lower=True)
        self.hash, self.start, self.end, self.eight = w.hash, w.start, w.end, w.eight
        self.names = [str(x) for x in items.column("item_id").to_pylist()]
        count = w.count()
        each = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
        item = np.repeat(np.arange(len(count)), each)
        first = np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each) + w.docs[item]
        length = np.minimum(count[item], size)
        name = length.astype(np.uint64)
        for i in range(size):  # the hash of a window's words
            more = np.flatnonzero(length > i)
            name[more] = mix(name[more] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[first[more] + i])
        _, one, back = firsts(name)
        one = one[back]  # the first window with the same hash; its words decide
        alike = (length == length[one]) & _same_words(self, first, self, first[one], np.where(length == length[one], length, 0))
        key = np.where(alike, one, np.arange(len(one)))
        self.window, back = np.unique(key, return_inverse=True)
        self.first, self.length = first[self.window], length[self.window]
        pairs = np.unique(np.stack([back, item], axis=1), axis=0) if len(back) else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.window) + 1))
        # shingle length -> (hashes, the words where they start); windows shorter than a shingle are one
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.kind = np.minimum(self.length, shingle)
        for k in np.unique(self.kind).tolist():
            h, at = runs(w.hash, w.docs, k)
            if k < shingle:
                own = np.isin(at, self.first[self.length == k])
                h, at = h[own], at[own]
            self.shingles[k] = (h, at)


def _same_words(a, at: np.ndarray, b, bt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from ``at`` on in a are, byte by byte, those from ``bt`` on in b."""
    ok = np.ones(len(n), bool)
    for i in range(int(n.max(initial=0))):
        rest = np.flatnonzero(ok & (n > i))
        p, q = at[rest] + i, bt[rest] + i
        size = a.end[p] - a.start[p]
        equal = (a.hash[p] == b.hash[q]) & (size == b.end[q] - b.start[q])
        equal[equal] = same(a.eight, a.start[p[equal]], b.eight, b.start[q[equal]], size[equal])
        ok[rest[~equal]] = False
    return ok


class Keys:
    """Membership of shingle hashes: a bit table first, then a binary search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sorted >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are members, and each one's index."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        i = np.minimum(np.searchsorted(self.sorted, h[at]), max(0, len(self.sorted) - 1))
        ok = self.sorted[i] == h[at] if len(self.sorted) else np.zeros(0, bool)
        return at[ok], i[ok]


def counts(docs: DataFrame, keys: dict[int, Keys]) -> dict[int, np.ndarray]:
    """How often the benchmark's shingles occur in all documents; as many rows as the block has shingles at most."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(x.sorted), np.int64) for k, x in sent.value.items()}
        for b in sliced(batches, "text"):
            w = words(b.column(0), ALNUM, lower=True)
            for k, x in sent.value.items():
                h, _ = runs(w.hash, w.docs, k)
                total[k] += np.bincount(x.find(h)[1], minlength=len(x.sorted))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["kind", "at", "n"])

    rows = small_batches(docs.select("text")).mapInArrow(task, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    kind, at, n = (rows.column(c).to_numpy() for c in ("kind", "at", "n"))
    out = {k: np.zeros(len(x.sorted), np.int64) for k, x in keys.items()}
    for k in out:
        out[k][at[kind == k]] = n[kind == k]
    return out


class Index:
    """Each window's prefix token: where it leads."""

    def __init__(self, w: Windows, keys: dict[int, Keys], seen: dict[int, np.ndarray]) -> None:
        self.w = w
        self.by: dict[int, tuple[Keys, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (h, at) in w.shingles.items():
            rarity = seen[k][np.searchsorted(keys[k].sorted, h)]
            own = np.flatnonzero(w.kind == k)
            if not len(own):
                continue
            # the rarest shingle of each window comes first, of these the one with the smallest hash
            place = np.searchsorted(at, w.first[own])
            best, offset = place.copy(), np.zeros(len(own), np.int64)
            for o in range(1, int(w.length[own].max()) - k + 1):
                there = np.flatnonzero(w.length[own] - k >= o)
                x, y = place[there] + o, best[there]
                better = (rarity[x] < rarity[y]) | ((rarity[x] == rarity[y]) & (h[x] < h[y]))
                best[there[better]], offset[there[better]] = x[better], o
            # a window whose rarest shingle occurs nowhere is contained nowhere
            live = rarity[best] > 0
            own, offset, token = own[live], offset[live], h[best[live]]
            order = np.argsort(token, kind="stable")
            x = Keys(token)
            start = np.searchsorted(token[order], x.sorted)
            self.by[k] = (x, start, np.diff(np.append(start, len(own))), own[order], offset[order])

    def hits(self, t, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window within a document of the words t."""
        w, out = self.w, []
        doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
        for k, (keys, at, size, own, offset) in self.by.items():
            s, place = runs(t.hash, docs, k)
            here, which = keys.find(s)
            for i in range(0, len(here), 1 << 16):
                found, entry_of = here[i : i + (1 << 16)], which[i : i + (1 << 16)]
                entry, n = take(np.arange(len(own)), at[entry_of], size[entry_of])
                token = np.repeat(place[found], n)
                window = own[entry]
                start = token - offset[entry]
                fits = (start >= docs[doc[token]]) & (start + w.length[window] <= docs[doc[token] + 1])
                start, window = start[fits], window[fits]
                equal = _same_words(t, start, w, w.first[window], w.length[window])
                out.append((start[equal], window[equal]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
#: The names of the result and of what is made on the way.
OWN = "doc_id, n_words, n_hit, n_items, items, spans, contaminated, _text, _text_key"


def _indexed(docs: DataFrame, items: pa.Table, size: int, shingle: int) -> Index:
    w = Windows(items, size, shingle)
    keys = {k: Keys(h) for k, (h, _) in w.shingles.items()}
    return Index(w, keys, counts(docs, keys) if keys else {})


def hits(docs: DataFrame, items: pa.Table, size: int = SIZE, shingle: int = SHINGLE, keep: list[str] | None = None, by_text: bool = False) -> DataFrame:
    """For each document: its words, the word ranges hit (apart from one another, in order), and the items found, sorted as
    strings. keep: other columns to carry along. by_text: a row for each text that is hit, named by its SHA-256, instead."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_indexed(docs, items, size, shingle))
    columns, names = carried(docs, keep, OWN)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        own = index.w
        for b in sliced(batches, "_text"):
            t = words(b.column("_text"), ALNUM, lower=True)
            n = b.num_rows
            start, window = index.hits(t, t.docs)
            delta = np.zeros(len(t.hash) + 1, np.int64)
            np.add.at(delta, start, 1)
            np.add.at(delta, start + own.length[window], -1)
            hit = np.zeros(len(t.hash) + 2, bool)
            hit[1:-1] = np.cumsum(delta[:-1]) > 0
            begins, ends = np.flatnonzero(hit[1:-1] & ~hit[:-2]), np.flatnonzero(hit[1:-1] & ~hit[2:]) + 1
            # adjacent documents may both be hit where they meet
            inner = t.docs[1:-1]
            inner = inner[(inner > 0) & (inner < len(t.hash))]
            inner = np.unique(inner[hit[inner] & hit[inner + 1]])
            begins, ends = np.union1d(begins, inner), np.union1d(ends, inner)
            owner = np.searchsorted(t.docs, begins, "right") - 1
            base = t.docs[owner]
            span_at = np.searchsorted(begins, t.docs).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(span_at), pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"]))
            doc = np.searchsorted(t.docs, start, "right") - 1
            item, size_ = take(own.owner, own.owners[window], np.diff(own.owners)[window])
            pairs = np.unique(np.stack([np.repeat(doc, size_), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
            found: list[set] = [set() for _ in range(n)]
            for d, i in pairs.tolist():
                found[d].add(own.names[i])
            items_ = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
            if by_text:
                some = np.unique(owner)
                keys = [hashlib.sha256(x.encode()).hexdigest() for x in b.column("_text").take(pa.array(some)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), spans.take(pa.array(some)), items_.take(pa.array(some))], ["_text_key", "spans", "items"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t.count(), pa.int64()), spans, items_, *(b.column(c) for c in names)], ["doc_id", "n_words", "spans", "items", *names])

    if by_text:
        found = small_batches(docs.select(F.col("text").alias("_text"))).mapInArrow(task, "_text_key string, spans array<struct<start:long,end:long>>, items array<string>")
        found._strandmill_sent = sent
        return found
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *columns)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    return small_batches(source).mapInArrow(task, HITS + kinds)


def _counted(docs: DataFrame, keep: list[str] | None) -> DataFrame:
    """doc_id, n_words, the name of the text, and what ``keep`` names."""
    columns, names = carried(docs, keep, OWN)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text"):
            n = words(b.column("_text"), ALNUM, lower=True).count()
            keys = [None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), *(b.column(c) for c in names)], ["doc_id", "n_words", "_text_key", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *columns)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    return small_batches(source).mapInArrow(task, "doc_id long, n_words long, _text_key string" + kinds)


def _merged(parts: DataFrame) -> DataFrame:
    """Hits of one text in several blocks as one row: ranges that overlap or touch are one, items sorted as strings."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lists, items in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
                out: list[dict] = []
                for s in sorted((s for x in lists for s in x), key=lambda s: (s["start"], s["end"])):
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(s)
                rows.append((out, sorted({i for x in items for i in x})))
            yield pa.RecordBatch.from_arrays([b.column("_text_key"), pa.array([r[0] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["_text_key", "spans", "items"])

    every = parts.groupBy("_text_key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return every.mapInArrow(task, "_text_key string, spans array<struct<start:long,end:long>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), spans, contaminated; a row for each row of docs.

    keep carries other columns of docs along.
    """
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    if blocks == 1:
        found = hits(docs, items.toArrow(), size, shingle, keep)
        names = found.columns[4:]
    else:
        ship(docs.sparkSession)
        more = None
        for i in range(blocks):
            block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toArrow()
            # equal texts have equal hits
            part = hits(docs, block, size, shingle, by_text=True)
            kept = cut(part.groupBy("_text_key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")
            part._strandmill_sent.destroy()  # one index in memory at a time
            more = kept if more is None else more.unionByName(kept)
        every = _counted(docs, keep)
        names = every.columns[3:]
        none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), F.expr("cast(array() as array<string>)")
        found = every.join(cut(_merged(more), "hits"), "_text_key", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"), *names)
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *names)
