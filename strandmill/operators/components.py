"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two joins, so a vertex that holds most of the edges is no
bottleneck: its minimum is pre-aggregated, and joined back by broadcast where it has many edges. Long chains need a number of
rounds logarithmic in their length. Lineage is cut by a Parquet table in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.joins import looked_up
from strandmill.session import cut, uncut


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("times"))
    return looked_up(both.where("b > a"), least, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times"))
    moved = looked_up(down, least, ["a"], total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = least.drop("times")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, component) of every vertex that has an edge; a component is named by its smallest vertex.

    Edges may repeat and may be loops; rows with a null end are left out.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    now = cut(pairs.distinct(), "components")
    loops = now.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    first = now
    for _ in range(most_rounds):
        far = cut(_large_star(now, now.count()), "components")
        after = cut(_small_star(far, far.count()), "components")
        uncut(far)
        if now is not first:
            uncut(now)
        now = after
        # done once no vertex that others point to points on, and each points to one
        onward = now.select(F.col("b").alias("a")).distinct().join(now, "a", "left_semi")
        if onward.isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"no star forest within {most_rounds} rounds")
    # now is a forest of stars: each vertex but the smallest points to the smallest
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return members.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
