"""Reads to k-mers to the read-overlap graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.packed import MOST_BASES, packed_kmers, unpacked
from strandmill.functions.sequence import generate_kmers, in_bases
from strandmill.operators import label_rounds
from strandmill.operators.pair_counts import shared_counts


def spread(reads: DataFrame) -> DataFrame:
    """The same rows over all cores. A file is one row group or a gzip stream at worst, and so one task, while its k-mers are
    many times its size; tables of enough partitions are left as they are."""
    cores = reads.sparkSession.sparkContext.defaultParallelism
    return reads.repartition(2 * cores) if reads.rdd.getNumPartitions() < 2 * cores else reads


def _positive(k: int) -> int:
    if k < 1:
        raise ValueError("k must be positive")
    return k


def read_kmers(reads: DataFrame, k: int, canonical: bool = True, errors: str = "N") -> DataFrame:
    """(kmer, id): each k-mer of a read once. Sets are made within rows, so no shuffle is needed for it."""
    _positive(k)
    if not reads.isStreaming:
        reads = spread(reads)
    return reads.select("id", F.explode(generate_kmers("seq", k, errors, canonical)).alias("kmer")).select("kmer", "id")


def kmer_counts(reads: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(kmer, cnt): in how many reads each k-mer occurs. K-mers that fit a long are packed while they are shuffled."""
    if _positive(k) > MOST_BASES or reads.isStreaming:
        return read_kmers(reads, k, canonical).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return unpacked(packed_kmers(spread(reads), k, canonical).groupBy("code", "odd").agg(F.count("*").alias("cnt")), k)


def kmer_read_map(reads: DataFrame, k: int, canonical: bool = True, least: int = 2) -> DataFrame:
    """(kmer, reads): the sorted ids of the reads of each k-mer that at least ``least`` reads share."""
    if _positive(k) > MOST_BASES or reads.isStreaming:
        return read_kmers(reads, k, canonical).groupBy("kmer").agg(F.array_sort(F.collect_set("id")).alias("reads")).where(F.size("reads") >= least)
    kept = packed_kmers(spread(reads), k, canonical).groupBy("code", "odd").agg(F.collect_set("id").alias("reads")).where(F.size("reads") >= least)
    return unpacked(kept.withColumn("reads", F.array_sort("reads")), k)


def shared_by_reads(reads: DataFrame, k: int, max_degree: int = 100, min_shared: int = 1, seed: int = 0, canonical: bool = True, letters: tuple[str, str] | None = None) -> DataFrame:
    """``read_edges`` of reads. K-mers that fit a long are packed, and their pairs counted where the k-mers are. letters: (letters of ASCII, a base for each)
    where ``seq`` is a text whose letters, of either case, stand for bases, and all else for N."""
    if _positive(k) <= MOST_BASES and (made := shared_counts(spread(reads), k, max_degree, min_shared, seed, canonical, letters)) is not None:
        return made
    if letters:
        reads = reads.withColumn("seq", in_bases("seq", *letters))
    pairs = read_kmers(reads, k, canonical) if _positive(k) > MOST_BASES else packed_kmers(spread(reads), k, canonical)
    return read_edges(pairs, max_degree, min_shared, seed)


def read_edges(pairs: DataFrame, max_degree: int = 100, min_shared: int = 1, seed: int = 0) -> DataFrame:
    """(src, dst, w): pairs of reads, src < dst, with the k-mers that they share.

    pairs: (kmer, id) or packed (code, odd, id), each once. A k-mer of at most ``max_degree`` reads pairs all of them. A more
    frequent one deals its reads into groups of about max_degree by the MD5 of k-mer, read and seed, and pairs within the groups, about max_degree / 2 pairs a read: the result does not depend on order or partitioning, and no k-mer, however
    frequent, makes a square of its reads.
    """
    keys = [c for c in pairs.columns if c != "id"]
    times = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(" ", *[F.col(c).cast("string") for c in [*keys, "id"]], F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
    group = F.when(F.col("n") <= max_degree, F.lit(0)).otherwise(F.pmod(drawn, F.ceil(F.col("n") / max_degree))).cast("int")
    dealt = pairs.join(times, keys).select(*keys, "id", group.alias("part"))
    a, b = dealt.select(*keys, "part", F.col("id").alias("src")), dealt.select(*keys, "part", F.col("id").alias("dst"))
    return a.join(b, [*keys, "part"]).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("w")).where(F.col("w") >= min_shared)


def edge_part(edges: DataFrame, i: int, n: int) -> DataFrame:
    """Part i of n of an edge table, by the sum of the ends modulo n in unsigned 32 bits."""
    return edges.where(F.pmod(F.pmod(F.col("src") + F.col("dst"), F.lit(2**32)), F.lit(n)) == i)


def merge_counts(*parts: DataFrame, key: str = "kmer", count: str = "cnt") -> DataFrame:
    """Partial counts brought together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum(count).alias(count))


def merge_maps(*parts: DataFrame) -> DataFrame:
    """Partial k-mer to reads maps brought together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kmer").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reads")))).alias("reads"))


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """(kmer, reads) of (kmer, id) rows of any number of partial maps."""
    return pairs.groupBy("kmer").agg(F.array_sort(F.collect_set("id")).alias("reads"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, nbr, w) of each edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), "w"), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), "w"))).alias("e")).select("e.*")


def top_neighbours(edges: DataFrame, k: int = 100) -> DataFrame:
    """(node, nbr, w, rank): the k heaviest neighbours of each node, ties by the smaller id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("w").desc(), "nbr"))
    return both_ways(edges).withColumn("rank", rank).where(F.col("rank") <= k)


def normalized_weights(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Weights divided by their mean over distinct undirected edges. order: columns that say which of several rows of an edge
    is the last, which counts; without it the largest weight does."""
    last = F.max_by("w", F.struct(*order)) if order else F.max("w")
    own = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(last.alias("w"))
    mean = own.agg(F.avg("w").alias("mean"))
    return own.crossJoin(F.broadcast(mean)).select("src", "dst", (F.col("w") / F.col("mean")).alias("w"))


def label_step(both: DataFrame, labels: DataFrame, smin: int = 2**32 - 1, mode: str = "sync", keep_lonely: bool = True) -> DataFrame:
    """One synchronous round: every node takes the label with the largest summed weight among its neighbours and, with the
    mean weight of its voting neighbours, its own; ties go to the smaller label. Labels from ``smin`` on do not vote.

    mode "as_written": only nodes that changed in the round before are looked at again. keep_lonely: a node without voting
    neighbours keeps its label; else it takes 0.
    """
    votes = both.join(labels.select(F.col("node").alias("nbr"), F.col("label").alias("vote")), "nbr").where(F.col("vote") < smin)
    if mode == "as_written":
        votes = votes.join(labels.where("changed").select("node"), "node", "left_semi")
    sums = votes.groupBy("node", F.col("vote").alias("label")).agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    own = sums.groupBy("node").agg((F.sum("s") / F.sum("n")).alias("s")).join(labels.select("node", "label"), "node").select("node", "label", "s")
    best = sums.select("node", "label", "s").unionByName(own).groupBy("node", "label").agg(F.sum("s").alias("s")).groupBy("node").agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("best"))
    after = labels.join(best, "node", "left")
    alone = F.col("label") if keep_lonely or mode == "as_written" else F.lit(0).cast("long")
    now = F.coalesce("best", alone)
    return after.select("node", now.alias("label"), (now != F.col("label")).alias("changed"))


def label_propagation(edges: DataFrame, most_rounds: int = 300, smin: int = 2**32 - 1, weighted: bool = False, mode: str = "sync", keep_lonely: bool = True) -> DataFrame:
    """(node, label, changed): clusters of the read graph. Rounds end when nothing changes, or after most_rounds: weighted graphs
    need not come to rest. An unweighted graph of at most ``label_rounds.WHOLE`` edges goes through all its rounds in one task; for others
    each round is a job, and lineage is cut by a table in the shared folder."""
    from strandmill.session import cut, uncut

    if mode not in ("sync", "as_written"):
        raise ValueError(f"no such mode: {mode}")
    if not weighted and dict(edges.dtypes)["src"] in ("bigint", "int"):
        edges = cut(edges.select("src", "dst"), "edges")
        if edges.where("src is null or dst is null").isEmpty() and edges.count() <= label_rounds.WHOLE:
            return label_rounds.propagated(edges, most_rounds, smin, mode, keep_lonely)
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    both = cut(both_ways(edges.select("src", "dst", w.alias("w"))).repartition("nbr"), "edges")
    labels = cut(both.select("node").distinct().select("node", F.col("node").alias("label"), F.lit(True).alias("changed")), "labels")
    for _ in range(most_rounds):
        after = cut(label_step(both, labels, smin, mode, keep_lonely), "labels")
        uncut(labels)
        labels = after
        if labels.where("changed").isEmpty():
            break
    return labels
