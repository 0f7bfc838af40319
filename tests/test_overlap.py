import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from strandmill.functions import packed
from strandmill.operators import label_rounds, overlap, pair_counts
from strandmill.sources import readers, sinks


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", "ACGTACGGTNACCA"), (2, "b", "ACGTACGG"), (3, "c", "TTTTTTTT"), (4, "d", None), (5, "e", ""), (6, "f", "CCGTACGT")]
    return rows, spark.createDataFrame(rows, "id long, header string, seq string")


def model(rows, k):
    out = set()
    for i, _, s in rows:
        for p in (s or "").split("N"):
            out |= {(min(p[j : j + k], rc(p[j : j + k])), i) for j in range(len(p) - k + 1)}
    return out


def test_counts_map_and_edges(small):
    rows, df = small
    pairs = model(rows, 4)
    assert {(r.kmer, r.cnt) for r in overlap.kmer_counts(df, 4).collect()} == set(Counter(k for k, _ in pairs).items())
    by = defaultdict(list)
    for k, i in sorted(pairs):
        by[k].append(i)
    assert {r.kmer: r.reads for r in overlap.kmer_read_map(df, 4).collect()} == {k: v for k, v in by.items() if len(v) > 1}
    edges = Counter(p for v in by.values() for p in combinations(sorted(v), 2))
    got = overlap.read_edges(overlap.read_kmers(df, 4))
    assert {(r.src, r.dst): r.w for r in got.collect()} == edges
    parts = [overlap.edge_part(got, i, 3).count() for i in range(3)]
    assert sum(parts) == len(edges)


def test_degree_cap_is_bounded_and_repeatable(spark):
    pairs = spark.range(400).selectExpr("'k' as kmer", "id")
    a = {tuple(r) for r in overlap.read_edges(pairs, max_degree=20, seed=5).collect()}
    b = {tuple(r) for r in overlap.read_edges(pairs.repartition(3), max_degree=20, seed=5).collect()}
    assert a == b and 0 < len(a) < 400 * 20


def test_top_and_normalized(spark):
    e = spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0), (2, 3, 4.0), (2, 1, 1.0)], "src long, dst long, w double")
    top = {(r.node, r.nbr) for r in overlap.top_neighbours(e.limit(3), 1).collect()}
    assert top == {(1, 2), (2, 1), (3, 2)}
    got = {(r.src, r.dst): r.w for r in overlap.normalized_weights(e).collect()}
    assert got == {(1, 2): 1.2, (1, 3): 0.6, (2, 3): 1.2}


def propagate(edges, rounds, mode):
    nbrs = defaultdict(list)
    for a, b in edges:
        nbrs[a].append(b)
        nbrs[b].append(a)
    label, changed = {n: n for n in nbrs}, set(nbrs)
    for _ in range(rounds):
        new = {}
        for n in changed if mode == "as_written" else nbrs:
            votes = Counter(label[m] for m in nbrs[n])
            votes[label[n]] += 1
            top = max(votes.values())
            new[n] = min(x for x, c in votes.items() if c == top)
        changed = {n for n, x in new.items() if x != label[n]}
        label |= new
        if not changed:
            break
    return label


@pytest.mark.parametrize("mode", ["sync", "as_written"])
def test_label_propagation(spark, mode):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (7, 8)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double")
    got = {r.node: r.label for r in overlap.label_propagation(df, 10, mode=mode).collect()}
    assert got == propagate(edges, 10, mode)


@pytest.fixture(scope="module")
def sample():
    """300 reads of 203 bases, each with an N, cut from a made genome so that they overlap."""
    rng = random.Random(300)
    genome = "".join(rng.choice("ACGT") for _ in range(9000))
    out = []
    for i in range(1, 301):
        at = rng.randrange(len(genome) - 202)
        s = genome[at : at + 101] + "N" + genome[at + 101 : at + 202]
        out.append((i, f"r{i}", s if i % 2 else rc(s.replace("N", "-")).replace("-", "N")))
    return out


@pytest.mark.parametrize("k", [5, 11, 25])
def test_sample_counts(spark, tmp_path, sample, k):
    for part in range(10):
        (tmp_path / f"part_{part:02d}").write_text("".join(f"{i}\t{h}\t{s}\n" for i, h, s in sample[part::10]))
    r = readers.reads(spark, str(tmp_path))
    assert r.count() == 300
    counted = {x.kmer: x.cnt for x in overlap.kmer_counts(r, k).collect()}
    want = Counter(kmer for kmer, _ in model(sample, k))
    assert counted == want and (k > 5 or len(want) == 512)


def test_sample_clusters(spark, tmp_path, sample):
    r = spark.createDataFrame(sample, "id long, header string, seq string")
    sinks.kmer_map(overlap.kmer_read_map(r, 11), str(tmp_path / "map"), gzip=True)
    edges = overlap.read_edges(readers.kmer_maps(spark, str(tmp_path / "map"))).cache()
    by = defaultdict(list)
    for kmer, i in model(sample, 11):
        by[kmer].append(i)
    want = Counter(p for v in by.values() for p in combinations(sorted(v), 2))
    assert {(e.src, e.dst): e.w for e in edges.collect()} == want
    got = {x.node: x.label for x in overlap.label_propagation(edges, mode="as_written").collect()}
    assert got == propagate(list(want), 300, "as_written")


@pytest.mark.parametrize(("k", "canonical"), [(1, True), (2, True), (4, False), (7, True), (16, True), (31, True), (31, False)])
def test_packed_kmers(spark, k, canonical):
    """Packed or not, k-mers are the same: with other letters, errors, characters of several bytes, nulls and long reads."""
    rng = random.Random(k)
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    seqs = ["ACGTACGTNNACGTTGCA" * 3, long, long[100:700] + "N" + rc(long[:500]), "ACRYGTACGTacgtACGT" * 4, "é" * 5 + long[:80] + "🎉" + long[80:160], "N", "", None, "A" * 100]
    df = spark.createDataFrame([(i, "", s) for i, s in enumerate(seqs)], "id long, header string, seq string")
    plain = overlap.read_kmers(df, k, canonical).groupBy("kmer").count()
    assert {(r.kmer, r.cnt) for r in overlap.kmer_counts(df, k, canonical).collect()} == {tuple(r) for r in plain.collect()}
    maps = {r.kmer: r.reads for r in overlap.kmer_read_map(df, k, canonical).collect()}
    by = defaultdict(list)
    for r in overlap.read_kmers(df, k, canonical).collect():
        by[r.kmer].append(r.id)
    assert maps == {x: sorted(v) for x, v in by.items() if len(v) > 1}
    one, two = overlap.shared_by_reads(df, k, canonical=canonical), overlap.read_edges(overlap.read_kmers(df, k, canonical))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_longer_kmers_stay_text(spark, small):
    rows, df = small
    assert overlap.kmer_counts(df, 40).count() == 0
    with pytest.raises(ValueError, match="positive"):
        overlap.kmer_counts(df, 0)


def alike(seed):
    """Reads with passages and lines that several share, copies, other letters, nulls and ids below zero."""
    rng = random.Random(seed)
    made = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    lines = [made(60) for _ in range(6)]
    out = [(i * 7 - 50, "", "N".join([made(rng.randrange(5, 80)), *rng.sample(lines, rng.randrange(4))])) for i in range(40)]
    return [*out, *[(1000 + i, "", out[3][2]) for i in range(5)], *[(2000 + i, "", out[5][2] + "RYACGTACGTACGT") for i in range(6)], (3000, "", None), (3001, "", "")]


@pytest.mark.parametrize(("k", "cap", "least"), [(11, 2**31 - 1, 1), (11, 2**31 - 1, 40), (17, 2**31 - 1, 60), (31, 2**31 - 1, 20), (11, 4, 1), (17, 3, 2)])
def test_pairs_counted_in_parts(spark, monkeypatch, k, cap, least):
    """No row for each k-mer and pair is shuffled, and the pairs and counts are those of the plain join."""
    monkeypatch.setattr(pair_counts, "FREQUENT", 3)
    df = spark.createDataFrame(alike(k), "id long, header string, seq string").repartition(5)
    got = overlap.shared_by_reads(df, k, cap, least, seed=3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = overlap.read_edges(overlap.packed_kmers(df, k), cap, least, 3)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) > 10 and got.dtypes == want.dtypes


def test_pairs_of_a_read_come_once(monkeypatch):
    """In steps smaller than one read's pairs, too, and through the packed form."""
    monkeypatch.setattr(pair_counts, "AT_ONCE", 5)
    rng = random.Random(5)
    groups = [sorted(rng.sample(range(30), rng.randrange(2, 20))) for _ in range(40)]
    read, n = np.array([r for g in groups for r in g], np.uint32), np.array([len(g) for g in groups])
    want = Counter(p for g in groups for p in combinations(g, 2))
    made = [(int(p) >> 32, int(p) & 2**32 - 1, int(c)) for pairs, counts in pair_counts._counted(read, n) for p, c in zip(pairs, counts, strict=True)]
    assert len(made) == len(want) and {(a, b): c for a, b, c in made} == want
    back = Counter()
    for _, *packed, counts in pair_counts._sent(pair_counts._counted(read, n), 4):
        src, dst = pair_counts._unpacked(*packed, np.uint32)
        back.update({(int(a), int(b)): int(c) for a, b, c in zip(src, dst, pair_counts._numbers(counts, len(src), np.uint32), strict=True)})
    assert back == want


@pytest.mark.parametrize("mode", ["sync", "as_written"])
@pytest.mark.parametrize("rounds", [1, 2, 7, 40, 301])
def test_label_rounds_in_one_task(mode, rounds):
    """As by plain rounds, also where a graph does not come to rest: stars and rings swap labels for ever."""
    rng = random.Random(rounds)
    edges = [(i, (i + 1) % 8) for i in range(8)] + [(20, 30 + i) for i in range(5)] + [(-50, -51), (-51, -52)]
    edges += [(rng.randrange(100, 160), rng.randrange(160, 200)) for _ in range(90)]
    src, dst = np.array(edges).T
    nodes, label, _ = label_rounds.rounds(src, dst, rounds, 2**32 - 1, mode, True)
    assert dict(zip(nodes.tolist(), label.tolist(), strict=True)) == propagate(edges, rounds, mode)


def test_label_rounds_are_no_jobs(spark):
    """A graph that never comes to rest takes as many jobs as one that does."""
    edges = [(0, 10), (1, 10), (0, 11), (1, 11), (2, 12)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double")
    got = overlap.label_propagation(df, 300, mode="sync", smin=11, keep_lonely=False)
    plain = overlap.label_propagation(df, 6, mode="sync", smin=11, keep_lonely=False, weighted=True)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("node", "label").collect())) == sorted(map(tuple, plain.select("node", "label").collect()))


def test_counters_are_never_below_the_counts():
    """The table bounds every pair's count, and stays where it is full."""
    rng = random.Random(7)
    groups = [sorted(rng.sample(range(40), rng.randrange(2, 20))) for _ in range(60)] + [[3, 9]] * 300
    read, n = np.array([r for g in groups for r in g], np.uint32), np.array([len(g) for g in groups])
    table = np.zeros(1 << 6, np.uint8)
    pair_counts._count_in(table, 6, read, n)
    pair_counts._count_in(table, 6, read, n)
    pairs, counts = (np.concatenate(x) for x in zip(*pair_counts._counted(read, n), strict=True))
    at = pair_counts._counter(pairs, 6)
    assert (table[at] >= np.minimum(2 * counts, 255)).all() and table[pair_counts._counter(np.array([3 << 32 | 9], np.uint64), 6)] == 255


def test_pairs_bounded_by_frequent_kmers(spark, monkeypatch):
    """With frequent k-mers beside the table the edges are those of the plain join, and reads are bounded by classes of such k-mers."""
    monkeypatch.setattr(pair_counts, "FREQUENT", 8)
    rng = random.Random(11)
    words = ["".join(rng.choice("ACGT") for _ in range(25)) for _ in range(150)]
    rows = [(i, "", "N".join(rng.sample(words, 12))) for i in range(60)]
    rows += [(100 + i, "", rows[i][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, header string, seq string")
    got = overlap.shared_by_reads(df, 17, 2**31 - 1, 60)
    want = overlap.read_edges(overlap.packed_kmers(df, 17), 2**31 - 1, 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    frequent = pair_counts._Frequent([pair_counts._Frequent.of(np.array(x, np.uint32)) for x in ([1, 2, 5], [2, 5, 9], [2, 9])])
    at = frequent.place(np.array([1, 2, 5, 9, 4], np.uint32))
    assert frequent.bound(at[[0, 1, 1, 4]], at[[1, 2, 3, 1]]).tolist() == [1, 2, 2, 0]


@pytest.mark.parametrize(("cap", "least"), [(2**31 - 1, 30), (2**31 - 1, 3), (4, 1)])
def test_letters_dealt_onto_bases_in_turns(spark, monkeypatch, cap, least):
    """Texts of either case with other characters give the edges of their sequences, whose k-mers are shuffled a few at once, and whose pairs come in turns;
    what was shuffled for them is gone."""
    monkeypatch.setattr(pair_counts, "FREQUENT", 8)
    monkeypatch.setattr(pair_counts, "ONCE", 4000)
    monkeypatch.setattr(pair_counts, "ROW", 50)
    monkeypatch.setattr(pair_counts, "PER_COUNTER", 0.002)
    monkeypatch.setattr(pair_counts, "SENT", 40)
    letters, bases = "abcdefgh ", "ACGTACGTA"
    rng = random.Random(23)
    words = ["".join(rng.choice(letters + "ABCDEFGH") for _ in range(30)) for _ in range(60)]
    rows = [(i, rng.choice(["-", "\u00e9", "\u212a\u0130", "\U0001f389x"]).join(rng.sample(words, 8))) for i in range(60)] + [(70, None), (71, "")]
    rows += [(100 + i, rows[i][1].swapcase() if i % 2 else rows[i][1]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    asked = []
    monkeypatch.setattr(pair_counts, "_forgotten", lambda s, f=pair_counts._forgotten: (asked.append(1), f(s)))
    got = sorted(map(tuple, overlap.shared_by_reads(df, 11, cap, least, seed=3, letters=(letters, bases)).collect()))
    plain = df.withColumn("seq", overlap.in_bases("seq", letters, bases))
    want = overlap.read_edges(overlap.packed_kmers(plain, 11), cap, least, 3)
    assert got == sorted(map(tuple, want.collect())) and len(got) > 10
    assert len(asked) > 3


def test_most_frequent_kmer_makes_no_pairs_in_its_part():
    """Also where it alone has more rows than a part may broadcast."""
    n = np.array([9, 70, 5, 60, 8])
    assert pair_counts._frequent(n, 50, 8).tolist() == [False, True, False, False, False]
    assert pair_counts._frequent(n, 131, 8).tolist() == [True, True, False, True, False]


@pytest.mark.parametrize(("rows", "pairs", "turns"), [(4500, 0.004, 1), (1000, 0.2, None)])
def test_frequent_kmers_are_chosen_over_all_parts(spark, monkeypatch, rows, pairs, turns):
    """Parts with many frequent k-mers leave none to pairs where all have room; what has no room makes pairs, and the edges are those of the plain join."""
    assert pair_counts._chosen([(7, np.array([90, 80, 70])), (8, np.array([20])), (9, np.array([85, 12]))], 330, 8) == {7: 3, 8: 1, 9: 1}
    for name, value in (("FREQUENT", 8), ("BROADCAST", rows), ("ROW", 50), ("PER_COUNTER", pairs)):
        monkeypatch.setattr(pair_counts, name, value)
    rng = random.Random(41)
    words = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(24)]
    own = [(i, "", "N".join([*rng.sample(words, 18), "".join(rng.choice("ACGT") for _ in range(40))])) for i in range(60)]
    df = spark.createDataFrame(own, "id long, header string, seq string")
    asked = []
    monkeypatch.setattr(pair_counts, "_forgotten", lambda s, f=pair_counts._forgotten: (asked.append(1), f(s)))
    got = sorted(map(tuple, overlap.shared_by_reads(df, 17, 2**31 - 1, 50).collect()))
    want = overlap.read_edges(overlap.packed_kmers(df, 17), 2**31 - 1, 50)
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    assert len(asked) == 1 + turns if turns else len(asked) >= 2  # of the postings, and of each turn of pairs


def test_pairs_of_capped_kmers_are_not_shuffled(spark, monkeypatch):
    """Tasks read the postings for the pairs of their own reads, bring them together in steps, and give the edges of the plain join."""
    for name, value in (("ROW", 50), ("HELD", 150), ("GATHERED", 20), ("ESTIMATED", 400), ("RANGES", 4), ("AT_ONCE", 30)):
        monkeypatch.setattr(pair_counts, name, value)
    df = spark.createDataFrame(alike(11), "id long, header string, seq string").repartition(3)
    got = overlap.shared_by_reads(df, 11, 5, 2, seed=3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, overlap.read_edges(overlap.packed_kmers(df, 11), 5, 2, 3).collect())) and len(rows) > 100


@pytest.mark.parametrize("letters", [None, ("abcdefgh ", "ACGTACGTA")])
def test_equal_texts_make_their_pairs_once(spark, monkeypatch, letters):
    """Of equal texts one has postings, and all have the edges of the plain join, among them too."""
    rng = random.Random(53)
    words = ["".join(rng.choice("ACGT" if letters is None else "abcdefgh ") for _ in range(24)) for _ in range(30)]
    texts = [("N" if letters is None else "-").join(rng.sample(words, 9)) for _ in range(20)]
    rows = [(i * 7 % 101, texts[i % 20]) for i in range(60)] + [(200, None), (201, None), (202, ""), (203, ""), (204, words[0]), (205, words[0])]
    df = spark.createDataFrame(rows, "id int, seq string").repartition(3)
    seen = []
    monkeypatch.setattr(pair_counts, "_counts", lambda own, *a, f=pair_counts._counts: (seen.append(own.count()), f(own, *a))[1])
    plain = df if letters is None else df.withColumn("seq", overlap.in_bases("seq", *letters))
    for least, copies in ((40, 1 << 22), (6, 0)):
        monkeypatch.setattr(pair_counts, "COPIES", copies)
        got = overlap.shared_by_reads(df, 17, 2**31 - 1, least, letters=letters)
        want = sorted(map(tuple, overlap.read_edges(overlap.packed_kmers(plain, 17), 2**31 - 1, least).collect()))
        assert sorted(map(tuple, got.collect())) == want and len(want) > 60
        assert [t for _, t in got.dtypes] == ["int", "int", "bigint"]
    assert seen == [24, 24]  # texts that differ, and the two nulls


def test_pairs_known_by_frequent_kmers():
    """Pairs are known where they share enough frequent k-mers without bits, or reach the least count; all others share fewer than ``rest`` says."""
    rng = random.Random(61)
    lists = [sorted(rng.sample(range(40), rng.randrange(3, 36))) for _ in range(60)]
    weight = [rng.randrange(1, 4) for _ in lists]
    frequent = pair_counts._Frequent([pair_counts._Frequent.of(np.array(x, np.uint32)) for x in lists], weight, 15, 24)
    assert 0 < frequent.used <= 15 and 0 < frequent.top.sum() < 15
    whole, part = Counter(), Counter()
    for x, w, top in zip(lists, weight, frequent.top.tolist(), strict=True):
        for p in combinations(x, 2):
            whole[p] += w
            part[p] += 0 if top else w
    got = {(int(p) >> 32, int(p) & 2**32 - 1): int(c) for share in range(2) for pairs, counts in frequent.alone(share, 2, 40, 24) for p, c in zip(pairs, counts, strict=True)}
    assert got == {p: part[p] for p in whole if part[p] >= 24 or whole[p] >= 40} and 0 < len(got) < len(whole)
    pairs = sorted(whole)
    src, dst = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    a, b = frequent.place(src), frequent.place(dst)
    bits = np.bitwise_count(frequent.tops[a] & frequent.tops[b])
    assert bits.tolist() == [whole[p] - part[p] for p in pairs]
    most = bits + np.minimum(frequent.rest[a], frequent.rest[b])
    assert all(p in got or whole[p] <= m for p, m in zip(pairs, most.tolist(), strict=True))
    known = np.array([p in got for p in pairs])
    w = np.array([2 + got.get(p, 0) for p in pairs])
    out = {(int(x), int(y)): int(z) for x, y, z in zip(*frequent.added(src, dst, w, 30, known), strict=True) if z >= 30}
    assert out == {p: n + 2 for p, n in whole.items() if n + 2 >= 30} and len(out) > 3


def test_groups_of_the_same_reads_are_one():
    """K-mers of the same reads make their pairs once, with their number; the counts stay."""
    rng = random.Random(31)
    some = [sorted(rng.sample(range(30), rng.randrange(2, 9))) for _ in range(12)]
    groups = [rng.choice(some) for _ in range(200)]
    read, n = np.array([r for g in groups for r in g], np.uint32), np.array([len(g) for g in groups])
    own, m, weight = pair_counts._alike(read, n)
    ends = np.cumsum(m)
    got = Counter({tuple(own[e - k : e].tolist()): int(w) for e, k, w in zip(ends, m, weight, strict=True)})
    assert got == Counter(map(tuple, groups)) and len(m) == len(got)
    want = Counter(p for g in groups for p in combinations(g, 2))
    assert {(int(p) >> 32, int(p) & 2**32 - 1): int(c) for pairs, counts in pair_counts._counted(own, m, weight=weight) for p, c in zip(pairs, counts, strict=True)} == want
    frequent = pair_counts._Frequent([pair_counts._Frequent.of(own[e - k : e]) for e, k in zip(ends, m, strict=True)], weight.tolist())
    alone = [int(p) for share in range(3) for pairs, _ in frequent.alone(share, 3, 40) for p in pairs]
    assert sorted(alone) == sorted(a << 32 | b for (a, b), c in want.items() if c >= 40) and len(alone) > 3


@pytest.mark.parametrize(("k", "canonical"), [(9, True), (11, False), (17, True), (31, True)])
def test_kmers_of_runs(k, canonical):
    """Runs of k-mers hold the k-mers of their reads, and a k-mer goes to one part whichever strand it is on."""
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT" * 9 + "N") for _ in range(rng.randrange(300))) for _ in range(40)]
    seqs += [rc(s) for s in seqs[:10]] + ["", "A" * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs)], ["id", "seq"])
    ((part, window, n, read, odd),) = packed.kmer_runs(iter([batch]), k, 4, canonical)
    code, own = packed.kmers_of_runs(window, n, read, k, canonical)
    ((want, ids),) = [(b.column("code").to_pylist(), b.column("id").to_pylist()) for b in packed.kmer_batches(iter([batch]), k, canonical)]
    assert set(zip(code.tolist(), own.tolist(), strict=True)) == set(zip(want, ids, strict=True)) and not odd
    parts = np.repeat(part, n.astype(int)) if canonical else np.tile(np.repeat(part, n.astype(int)), 2)
    assert len(set(zip(code.tolist(), parts.tolist(), strict=True))) == len(set(code.tolist())) and len(n) < len(code) / (1 if k == 9 else 1.2)


@pytest.mark.parametrize("least", [1, 9])
def test_pairs_counted_in_blocks(monkeypatch, least):
    """Each pair of reads of two classes, or of one, comes once with its whole count, however lists, steps and known bits fall."""
    for name, value in (("SHORT", 6), ("LISTS", 7), ("GIVEN", 10), ("KNOWN", 4)):
        monkeypatch.setattr(pair_counts, name, value)
    rng = random.Random(71)
    pieces = [[sorted(rng.sample(range(2**31, 2**31 + 50), rng.randrange(2, 30))) for _ in range(20)] for _ in range(4)]
    weights = [[rng.choice([1, 1, 2, 3, 7]) for _ in own] for own in pieces]
    want = Counter()
    for own, w in zip(pieces, weights, strict=True):
        for g, v in zip(own, w, strict=True):
            want.update({p: v for p in combinations(g, 2)})
    rows = [(pair_counts._squeezed(np.array(w, np.uint32)), *pair_counts._columns(np.array([r for g in own for r in g], np.uint32), np.array([len(g) for g in own]), 3)) for own, w in zip(pieces, weights, strict=True)]
    got = []
    for i in range(3):
        for j in range(i, 3):
            block = pair_counts._Block(i == j)
            for times, *columns in rows:
                block.add(columns[i], columns[j], times)
            got += [(int(a), int(b), int(c)) for found in block.pairs(least) for a, b, c in zip(*found, strict=True)]
    assert len(got) == len({x[:2] for x in got}) and {(a, b): c for a, b, c in got} == {p: c for p, c in want.items() if c >= least}
    assert not list(pair_counts._Block(False).pairs(least))
