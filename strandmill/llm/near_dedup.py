"""Near-duplicate documents by HyperMinHash registers, banding, and verification on full shingle sets.

1. A document's set holds the hashes of its distinct word shingles. Documents of one word sequence, told by 128 bits of
   BLAKE2b, form a class; its smallest doc_id represents it, so copies are never compared with one another.
2. A sketch of ``REGISTERS`` registers: a shingle's hash picks a register, and a register keeps the smallest hash that falls
   on it as its count of leading zeros (6 bits) and the 10 bits that follow. Registers still empty take hashes of further
   rounds, so short documents have full sketches too, and two registers agree with the sets' Jaccard similarity as chance.
3. Bands of ``ROWS`` registers are hashed to buckets. Sets of similarity 0.8 share no bucket with a chance of
   (1 - 0.8**4)**32, below 1e-7.
4. A shingle that only one of the sets in shared buckets has can be in no intersection, so the others (``able`` of ``n``) bound
   a set's similarity to any partner, as a whole and in each of ``PARTS`` parts that shingles fall into by hash. Sets that cannot reach the limit with anyone go, which empties large groups of copies
   that are each too far from all others.
5. In each bucket all sets are tied to its smallest one and to the one with the largest able share: in a group of noisy
   copies that is the cleanest copy, which links with nearly all that link at all. A set keeps the ``HUBS`` partners that it
   meets in most of its buckets; those pairs are verified, and components of the links are found by star rounds.
6. Where a bucket still holds several components, every pair of sets from different ones that the bound admits is verified,
   once each: in the first bucket that the two share. Few are left by then; this step is there so that no link is lost, and it
   has no cap.

A pair is verified in two steps: the similarity estimated from the registers and corrected for their chance agreement must
reach ``LEAST_ESTIMATE`` (8 standard deviations under 0.8: a chance below 1e-12 to lose a pair); then the full shingle sets of
both texts decide. The words and shingles behind equal hashes are compared there; texts in which two different ones have one
hash are compared as sets of words instead. Partners of one set are dealt into groups of about the square root of their
number, and a group's text of that set is sent once, so no task gets all pairs of a hub.

Null, empty and blank texts have empty sets and are linked with nothing, not even with each other. A text of fewer words than
a shingle has its whole sequence as one. Repeated rows of a document count as exact copies of it; a doc_id with several texts
is one document, linked by any of them. A row whose doc_id is null stands for itself (its component_id is null). Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.id_filter import id_filter, maybe
from strandmill.llm.words import SPACED, U, collide, mix, runs, sliced, small_batches, text_names, whole, words
from strandmill.operators.components import components
from strandmill.operators.joins import looked_up
from strandmill.session import cut, ship, uncut

REGISTERS, ROWS, LEAST_ESTIMATE, HUBS = 128, 4, 0.5, 4
#: Partners of a set from which on they are dealt into groups, and rows of a broadcast table of such sets (2 MB).
MANY, MOST_HUBS = 32, 1 << 17
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Chance that registers of different minima agree: about a third for the leading zeros, 2**-10 for the rest.
AGREE = 2**-10 / 3


def shingle_sets(w, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text of words, one text after another, and d + 1 offsets."""
    h, at = runs(w.hash, w.docs, shingle)
    count = w.count()
    short = np.flatnonzero((count > 0) & (count < shingle))
    bounds = np.searchsorted(at, w.docs)
    if len(short):
        h = np.insert(h, bounds[short], np.array([whole(w.hash[w.docs[i] : w.docs[i + 1]], shingle) for i in short.tolist()], np.uint64))
        extra = np.zeros(len(bounds), np.int64)
        extra[short + 1] = 1
        bounds = bounds + np.cumsum(extra)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[bounds < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sketches(h: np.ndarray, at: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """[d, registers] uint16; rows of empty sets mean nothing."""
    d, bits = len(at) - 1, registers.bit_length() - 1
    doc = np.repeat(np.arange(d), np.diff(at))
    best = np.full(d * registers, _EMPTY, np.uint64)
    turn = np.zeros(d * registers, np.uint16)
    live = np.arange(len(h))
    for r in range(2 * registers):
        if not len(live):
            break
        x = mix(h[live] + U((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        # after as many rounds as there are registers, each further round fills one of them for certain
        slot = doc[live] * registers + ((x >> U(64 - bits)).astype(np.int64) if r < registers else r - registers)
        low = np.full(d * registers, _EMPTY, np.uint64) if r < 4 else None
        if low is None:
            order = np.lexsort((x << U(bits), slot))
            s = slot[order]
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            slots, values = s[first], (x << U(bits))[order][first]
        else:
            np.minimum.at(low, slot, x << U(bits))
            slots = np.flatnonzero(low != _EMPTY)
            values = low[slots]
        free = best[slots] == _EMPTY
        best[slots[free]] = values[free]
        turn[slots[free]] = r
        full = (best.reshape(d, registers) != _EMPTY).all(axis=1)
        live = live[~full[doc[live]]]
    zeros = np.minimum(64 - np.frexp(best.astype(float))[1], 63).astype(np.uint64)
    rest = (best << (zeros + U(1))) >> U(54)
    return ((zeros << U(10) | rest).astype(np.uint16) + turn * np.uint16(40503)).reshape(d, registers)


def band_hashes(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """[d, registers / rows] bucket names, different for each band."""
    groups = np.ascontiguousarray(sketch).view(np.uint16).reshape(len(sketch), -1, rows).astype(np.uint64)
    h = np.full(groups.shape[:2], U(0), np.uint64) + np.arange(groups.shape[1], dtype=np.uint64) * U(0xA24BAED4963EE407)
    for i in range(rows):
        h = mix(h ^ groups[:, :, i]) + U(0x9E3779B97F4A7C15)
    return mix(h)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two arrays of sketches, corrected for chance agreement."""
    return ((a == b).mean(axis=1) - AGREE) / (1 - AGREE)


#: Parts into which hashes of shingles fall for the bound on intersections.
PARTS = 64
SIGNED = "doc_id long, n long, k1 long, k2 long, bands array<long>, parts array<int>"


def signed(docs: DataFrame, shingle: int, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            w = words(b.column("text"), SPACED, lower=True)
            h, at = shingle_sets(w, shingle)
            n, name = np.diff(at), text_names(w)
            s = sketches(h, at, registers)
            bands = band_hashes(s, rows)
            d, width = bands.shape
            parts = np.bincount(np.repeat(np.arange(d), n) * PARTS + (h % U(PARTS)).astype(np.int64), minlength=d * PARTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * width), pa.array(bands.reshape(-1).view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * PARTS), pa.array(parts))],
                ["doc_id", "n", "k1", "k2", "bands", "parts"],
            )

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(task, SIGNED)


def _dealt(pairs: DataFrame) -> DataFrame:
    """(a, b, part): pairs in groups by a and part, none with all partners of a set that has many."""
    many = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("a", F.ceil(F.sqrt("n")).cast("int").alias("groups")), "many")
    if many.count() <= MOST_HUBS:
        many = F.broadcast(many)
    return pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).cast("int").alias("part"))


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, least: float = LEAST_ESTIMATE) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union|: estimated from sketches first, then from the full sets of
    both texts. Only texts that a bounded filter of the pairs' ids lets through are shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id"))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                yield t.filter(pa.array(maybe(sent.value, t.column(0).to_numpy())))

    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).where("doc is not null")
    texts = small_batches(own).mapInArrow(some, "doc long, text string")
    dealt = _dealt(pairs)
    side = lambda c, i: dealt.select(F.col(c).alias("doc"), "a", "part", F.lit(i).alias("side"))
    rows = texts.join(side("a", 0).distinct().union(side("b", 1)), "doc")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side", "doc")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, []  # the group that was not at its end, and the texts of its a
        for t in sliced(batches, "text"):
            column = pa.concat_arrays([pa.array(hub, pa.string()), t.column("text").cast(pa.string())])
            w = words(column, SPACED, lower=True)
            h, at = shingle_sets(w, shingle)
            exact = not collide(w, shingle)
            s = sketches(h, at)
            of, open_, two = group, list(range(len(hub))), []
            for i, (a, part, one) in enumerate(zip(t.column("a").to_pylist(), t.column("part").to_pylist(), t.column("side").to_pylist(), strict=True)):
                if (a, part) != of:
                    of, open_ = (a, part), []
                if one == 0:
                    if column[len(hub) + i] not in [column[j] for j in open_]:
                        open_.append(len(hub) + i)
                else:
                    two += [(j, len(hub) + i) for j in open_]
            if two:
                x, y = np.array(two).T
                near = estimate(s[x], s[y]) >= least
                near &= (np.diff(at)[x] > 0) & (np.diff(at)[y] > 0)
                for k in np.flatnonzero(near).tolist():
                    if exact:
                        u, v = h[at[x[k]] : at[x[k] + 1]], h[at[y[k]] : at[y[k] + 1]]
                        n, m, both = len(u), len(v), _common(u, v)
                    else:
                        u, v = (_word_set(w, i, shingle) for i in (x[k], y[k]))
                        n, m, both = len(u), len(v), len(u & v)
                    near[k] = 100 * both >= percent * (n + m - both)
                yield t.select(["a", "doc"]).take(pa.array(np.unique(y[near]) - len(hub))).rename_columns(["a", "b"])
            group, hub = of, [column[j].as_py() for j in open_]

    return rows.select("a", "part", "side", "doc", "text").mapInArrow(task, "a long, b long").distinct()


def _word_set(w, i: int, shingle: int) -> set:
    data = w.low.tobytes()
    own = [data[p:q] for p, q in zip(w.start[w.docs[i] : w.docs[i + 1]].tolist(), w.end[w.docs[i] : w.docs[i + 1]].tolist(), strict=True)]
    return {tuple(own[j : j + shingle]) for j in range(max(1, len(own) - shingle + 1))} if own else set()


def _common(u: np.ndarray, v: np.ndarray) -> int:
    if not len(u) or not len(v):
        return 0
    i = np.minimum(np.searchsorted(u, v), len(u) - 1)
    return int(np.count_nonzero(u[i] == v))


def _able(reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """rep, n (the size of its set), able (how many of its shingles another of reps has too) and lone (the parts of the others)."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(reps.select(F.col("rep").alias("id"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                for b in sliced(iter([t.filter(pa.array(maybe(sent.value, t.column(0).to_numpy())))])):
                    h, at = shingle_sets(words(b.column(1), SPACED, lower=True), shingle)
                    n = np.diff(at)
                    owner = np.repeat(np.arange(b.num_rows), n)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(n[owner]), pa.array(h.view(np.int64))], ["rep", "n", "shingle"])

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # what the filter lets through in error only makes shingles look shared, which admits more
    each = small_batches(own).mapInArrow(task, "rep long, n long, shingle long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("times"), F.min("rep").alias("rep"), F.min("n").alias("n")).where("times = 1")
    lone = alone.groupBy("rep", "n").agg(F.collect_list(F.pmod("shingle", F.lit(PARTS)).cast("byte")).alias("lone"))
    return reps.join(lone, ["rep", "n"], "left").select("rep", "n", (F.col("n") - F.coalesce(F.size("lone"), F.lit(0))).alias("able"), "lone")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents linked by a Jaccard similarity of at least ``percent``."""
    ship(docs.sparkSession)
    every = cut(signed(docs, shingle), "signed")
    real = every.where("n > 0 and doc_id is not null")
    classes = cut(real.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands", "parts")).alias("least"), F.count("*").alias("times")).select("k1", "k2", F.col("least.doc_id").alias("rep"), "least.n", "least.bands", "least.parts", "times"), "classes")
    exploded = classes.select("rep", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("times")).where("lo <> hi").select("key", "times")
    met = cut(looked_up(exploded, cut(shared, "shared"), ["key"], (REGISTERS // ROWS) * classes.count()), "members")
    able = _able(classes.select("rep", "n").join(met.select("rep").distinct(), "rep"), docs, shingle)
    able = cut(able.where(100 * F.col("able") >= percent * F.col("n")), "able")
    members = cut(met.join(able.drop("lone"), "rep"), "members")
    uncut(met)
    hubs = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max(F.struct((F.col("able") / F.col("n")).alias("share"), "rep")).alias("best"), F.count("*").alias("times")).select("key", F.array_distinct(F.array("lo", "best.rep")).alias("hubs"), "times")
    met = looked_up(members, cut(hubs, "hubs"), ["key"], members.count()).select("rep", F.explode("hubs").alias("hub")).where("rep <> hub").groupBy("rep").agg(F.collect_list("hub").alias("met"))
    ranked = F.expr(f"slice(array_sort(transform(array_distinct(met), h -> struct(-size(filter(met, x -> x = h)) as times, h as hub))), 1, {HUBS})")
    first = cut(met.select("rep", F.explode(ranked).alias("x")).select(F.least("rep", "x.hub").alias("a"), F.greatest("rep", "x.hub").alias("b")).distinct(), "pairs")
    # a doc_id with several texts ties their classes together
    several = real.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where("lo <> hi").select("doc_id")
    tied = real.join(several, "doc_id").select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))
    found = cut(_confirmed(first, docs, shingle, percent).union(tied), "links")
    label = cut(components(found), "labels")
    # what is left: pairs of different components that share a bucket
    named = members.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    open_ = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    still = cut(named.join(open_, "key"), "open")
    uncut(members)
    if not still.isEmpty():
        # how many shared shingles of each set fall into each part: part by part, an intersection has at most the smaller number
        shares = F.expr("transform(parts, (p, i) -> p - if(lone is null, 0, size(filter(lone, x -> x = pmod(i, 64)))))")
        sides = cut(classes.select("rep", "bands", "parts").join(still.select("rep").distinct(), "rep").join(able.select("rep", "lone"), "rep").select("rep", "bands", shares.alias("shares")), "sides")
        full = still.join(sides, "rep")
        one, two = (full.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "comp", "n", "able", "bands", "shares")]) for x in "ab")
        here = F.expr("element_at(filter(zip_with(bands_a, bands_b, (x, y) -> if(x = y, x, null)), x -> x is not null), 1)")
        admitted = (100 + percent) * F.least("able_a", "able_b") >= percent * (F.col("n_a") + F.col("n_b"))
        common = F.expr(f"{100 + percent} * aggregate(zip_with(shares_a, shares_b, (x, y) -> least(x, y)), 0, (t, x) -> t + x) >= {percent} * (n_a + n_b)")
        pairs = one.join(two, "key").where("comp_a < comp_b").where(admitted).where(here == F.col("key")).where(common).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
        pairs = cut(pairs.join(first, ["a", "b"], "left_anti"), "pairs")
        more = cut(_confirmed(pairs, docs, shingle, percent), "links")
        if not more.isEmpty():
            label = cut(components(found.union(more)), "labels")
        for done in (sides, pairs, more):
            uncut(done)
    for done in (still, first, found, able):
        uncut(done)
    named = classes.select("k1", "k2", "rep", "times").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", "times", F.coalesce("component", "rep").alias("component_id"))
    slim = every.select("doc_id", "n", "k1", "k2")
    linked = looked_up(slim.where("n > 0 and doc_id is not null"), cut(named, "named"), ["k1", "k2"], every.count()).select("doc_id", "n", "component_id")
    alone = slim.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
