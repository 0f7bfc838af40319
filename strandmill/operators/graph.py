"""The graph commands: degrees, neighbours, triangles, independent sets, shortest paths, ranks.

Edge tables have vi, vj (long) and perhaps w. Where a command asks for an undirected simple graph, apply ``edge_upper`` first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.edges import to_vertices, upper
from strandmill.functions.text import vertex_random
from strandmill.operators.components import components
from strandmill.session import cut, uncut


def edge_upper(edges: DataFrame) -> DataFrame:
    """Undirected simple edges, vi < vj."""
    return upper(edges.select("vi", "vj")).distinct()


def vertex_extract(edges: DataFrame) -> DataFrame:
    return to_vertices(edges).distinct()


def degree(edges: DataFrame, first_only: bool = False) -> DataFrame:
    """(v, degree): edges at each vertex, repeats counted; first_only: at first ends alone."""
    ends = edges.select(F.col("vi").alias("v")) if first_only else to_vertices(edges)
    return ends.groupBy("v").agg(F.count("*").alias("degree"))


def histogram(counted: DataFrame, column: str) -> DataFrame:
    """How many rows have each value of a count."""
    return counted.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def degree_stats(edges: DataFrame, first_only: bool = False) -> DataFrame:
    return histogram(degree(edges, first_only), "degree").toDF("degree", "vertices")


def degree_weight(edges: DataFrame) -> DataFrame:
    """(vi, vj, w): w is 1 / the number of edges that start at vi."""
    out = degree(edges, first_only=True).select(F.col("v").alias("vi"), "degree")
    return edges.join(out, "vi").select("vi", "vj", (1 / F.col("degree")).alias("w"))


def histo(rows: DataFrame, key: str) -> DataFrame:
    """Count of counts of a key."""
    return histogram(rows.groupBy(key).agg(F.count("*").alias("n")), "n").toDF("times", "keys")


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): how often each key occurs."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


def cc_totals(zones: DataFrame) -> DataFrame:
    """(components, vertices) of all zones."""
    return zones.groupBy("zone").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"))


def cc_find(edges: DataFrame) -> DataFrame:
    """(v, zone): the smallest vertex of each vertex's component."""
    return components(edges, "vi", "vj").toDF("v", "zone")


def cc_stats(zones: DataFrame) -> DataFrame:
    """(size, zones): how many components have each size."""
    return histogram(zones.groupBy("zone").agg(F.count("*").alias("n")), "n").toDF("size", "zones")


def neighbors(edges: DataFrame) -> DataFrame:
    """(v, nbrs): adjacency lists, sorted."""
    both = edges.select(F.explode(F.array(F.struct(F.col("vi").alias("v"), F.col("vj").alias("u")), F.struct(F.col("vj").alias("v"), F.col("vi").alias("u")))).alias("e")).select("e.*")
    return both.groupBy("v").agg(F.array_sort(F.collect_list("u")).alias("nbrs"))


def triangles(edges: DataFrame) -> DataFrame:
    """(vi, vj, vk): every triangle once; vi has the lowest (degree, id), and vj < vk.

    Edges point from the end of lower degree to the other, so a vertex opens at most the square root of the edges in angles:
    hubs open none towards their leaves. edges: simple and undirected.
    """
    d = degree(edges)
    with_degrees = edges.join(d.toDF("vi", "di"), "vi").join(d.toDF("vj", "dj"), "vj")
    up = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("vi") < F.col("vj")))
    turned = with_degrees.select(F.when(up, F.col("vi")).otherwise(F.col("vj")).alias("low"), F.when(up, F.col("vj")).otherwise(F.col("vi")).alias("high"))
    angles = turned.select("low", F.col("high").alias("vj")).join(turned.select("low", F.col("high").alias("vk")), "low").where("vj < vk")
    ends = edges.select(F.least("vi", "vj").alias("vj"), F.greatest("vi", "vj").alias("vk"))
    return angles.join(ends, ["vj", "vk"], "left_semi").select(F.col("low").alias("vi"), "vj", "vk")


def neighbors_with_triangles(edges: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    """(v, a, b): for each vertex its own edges (v, u) and the opposite edge of each of its triangles."""
    tri = triangles(edges) if tri is None else tri
    own = edges.select(F.col("vi").alias("v"), F.col("vi").alias("a"), F.col("vj").alias("b")).union(edges.select("vj", "vj", "vi"))
    far = tri.select(F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.least(y, z).alias("a"), F.greatest(y, z).alias("b")) for x, y, z in (("vi", "vj", "vk"), ("vj", "vi", "vk"), ("vk", "vi", "vj"))])).alias("t")).select("t.*")
    return own.union(far)


def luby(edges: DataFrame, seed: int, most_rounds: int = 100) -> DataFrame:
    """(v): a maximal independent set. In each round the vertices whose random value is the smallest among their neighbours
    (ties: the smaller id) join the set, and they and their neighbours leave the graph; a vertex that is left alone by that
    joins too. Vertices without any edge are not in the table. edges: simple and undirected."""
    left = cut(edges.select("vi", "vj").where("vi <> vj"), "luby")
    chosen = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        r = lambda v: F.struct(vertex_random(v, seed).alias("r"), F.col(v).alias("v"))
        ranked = left.select("vi", "vj", r("vi").alias("ri"), r("vj").alias("rj"))
        # a vertex that loses an edge is no winner
        losers = ranked.select(F.when(F.col("ri") < F.col("rj"), F.col("vj")).otherwise(F.col("vi")).alias("v")).distinct()
        won = cut(vertex_extract(left).join(losers, "v", "left_anti"), "won")
        chosen = won if chosen is None else chosen.union(won)
        beside = left.join(won.toDF("vi"), "vi", "left_semi").select(F.col("vj").alias("v")).union(left.join(won.toDF("vj"), "vj", "left_semi").select(F.col("vi").alias("v")))
        gone = cut(won.union(beside).distinct(), "gone")
        after = cut(left.join(gone.toDF("vi"), "vi", "left_anti").join(gone.toDF("vj"), "vj", "left_anti"), "luby")
        # a vertex that stays while all its neighbours leave has no edge any more: nothing in the set is beside it
        free = cut(vertex_extract(left).join(gone, "v", "left_anti").join(vertex_extract(after), "v", "left_anti"), "free")
        chosen = chosen.union(free)
        uncut(gone)
        uncut(left)
        left = after
    else:
        raise RuntimeError("the graph is not used up")
    return chosen if chosen is not None else left.select(F.col("vi").alias("v"))


def relaxed(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One round of relaxation of (v, dist, pred) along directed weighted edges."""
    step = state.join(edges, state.v == edges.vi).select(F.col("vj").alias("v"), (F.col("dist") + F.col("w")).alias("dist"), F.col("vi").alias("pred"))
    return state.unionByName(step).groupBy("v").agg(F.min(F.struct("dist", "pred")).alias("m")).select("v", "m.dist", "m.pred")


def sources(edges: DataFrame, n: int, seed: int) -> list[int]:
    """n vertices of edges (vi, vj) drawn by the seed, all of them if there are fewer: those with the smallest MD5 of vertex and seed."""
    every = edges.select(F.col("vi").alias("v")).union(edges.select(F.col("vj").alias("v"))).distinct()
    drawn = [r.v for r in every.orderBy(F.md5(F.concat_ws(" ", F.col("v").cast("string"), F.lit(str(seed))).cast("binary")), "v").limit(n).collect()]
    if not drawn:
        raise ValueError("no sources: the graph is empty or n is not positive")
    return drawn


def sssp(edges: DataFrame, source: int, most_rounds: int = 10_000) -> DataFrame:
    """(v, dist, pred) of all vertices that directed edges (vi, vj, w >= 0) reach from a source. Ties: the smaller predecessor.

    Only vertices that came closer in the last round are relaxed in the next.
    """
    spark = edges.sparkSession
    state = cut(spark.createDataFrame([(source, 0.0, None)], "v long, dist double, pred long"), "sssp")
    front = state
    for _ in range(most_rounds):
        step = front.join(edges, front.v == edges.vi).groupBy(F.col("vj").alias("v")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("vi").alias("pred"))).alias("m")).select("v", F.col("m.dist").alias("d2"), F.col("m.pred").alias("p2"))
        better = F.col("dist").isNull() | (F.col("d2") < F.col("dist")) | ((F.col("d2") == F.col("dist")) & (F.col("p2") < F.col("pred")))
        both = state.join(step, "v", "full").select("v", F.when(F.col("d2").isNotNull() & better, F.struct(F.col("d2").alias("dist"), F.col("p2").alias("pred"), F.lit(True).alias("moved"))).otherwise(F.struct("dist", "pred", F.lit(False).alias("moved"))).alias("s")).select("v", "s.*")
        after = cut(both, "sssp")
        uncut(state)
        state, front = after.select("v", "dist", "pred"), after.where("moved").select("v", "dist", "pred")
        state._strandmill_path = after._strandmill_path
        if front.isEmpty():
            return state
    raise RuntimeError(f"not at rest within {most_rounds} rounds")


def pagerank(edges: DataFrame, rounds: int = 20, alpha: float = 0.85, tolerance: float = 0.0) -> DataFrame:
    """(v, rank): PageRank over directed edges (vi, vj, w), ranks summing to 1. Vertices without out-edges spread theirs over all.

    An extension: the command this stands for only passes its input on.
    """
    from pyspark.sql import Window

    own = cut(edges.groupBy("vi", "vj").agg(F.sum("w").alias("w")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("vi"))), "links")
    vertices = cut(vertex_extract(own), "vertices")
    n = vertices.count()
    rank = cut(vertices.withColumn("rank", F.lit(1.0 / max(1, n))), "rank")
    starts = own.select(F.col("vi").alias("v")).distinct()
    for _ in range(rounds):
        loose = rank.join(starts, "v", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        flow = rank.join(own, rank.v == own.vi).groupBy(F.col("vj").alias("v")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        after = cut(rank.withColumnRenamed("rank", "old").join(flow, "v", "left").crossJoin(F.broadcast(loose)).select("v", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"), "old"), "rank")
        uncut(rank)
        rank = after.select("v", "rank")
        rank._strandmill_path = after._strandmill_path
        if tolerance and (after.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    return rank


def rmat(spark, levels: int, per_vertex: int, a: float, b: float, c: float, d: float, fraction: float, seed: int, most_rounds: int = 200) -> DataFrame:
    """(vi, vj): 2**levels * per_vertex distinct directed edges of a recursive-matrix graph; rounds of new draws until there
    are enough. Deterministic for a seed, however rows are dealt."""
    if abs(a + b + c + d - 1) > 1e-12 or fraction >= 1:
        raise ValueError("a + b + c + d must be 1, and fraction below 1")
    import numpy as np
    import pandas as pd

    def drawn(turn: int):
        def uniform(ids: np.ndarray, level: int, what: int) -> np.ndarray:
            x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x1000193 + turn * 0x10001 + level * 8 + what) % 2**64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            return (x ^ (x >> np.uint64(31))) / 2.0**64

        def run(batches):
            for b in batches:
                ids = b["id"].to_numpy()
                vi, vj = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                p = np.tile(np.array([a, b_, c, d], float)[:, None], len(ids))
                for level in range(levels):
                    r, bit = uniform(ids, level, 0), 1 << (levels - 1 - level)
                    ends = np.cumsum(p, axis=0)
                    quadrant = (r >= ends[0]).astype(int) + (r >= ends[1]) + (r >= ends[2])
                    vi += bit * (quadrant >= 2)
                    vj += bit * (quadrant % 2)
                    if fraction > 0:
                        p *= 1 + fraction * (np.stack([uniform(ids, level, k + 1) for k in range(4)]) - 0.5)
                        p /= p.sum(axis=0)
                yield pd.DataFrame({"vi": vi, "vj": vj})

        return run

    want, have, n, b_ = (1 << levels) * per_vertex, None, 0, b
    for turn in range(most_rounds):
        new = spark.range(want - n).mapInPandas(drawn(turn), "vi long, vj long").distinct()
        before, have = have, cut(new if have is None else have.union(new.join(have, ["vi", "vj"], "left_anti")), "rmat")
        if before is not None:
            uncut(before)
        n = have.count()
        if n >= want:
            return have
    raise RuntimeError("the graph has too few distinct edges")
