"""The registered queries over the driver's tables, with their SQL.

Reads are made of whole document texts: letters and the blank are dealt onto the four bases in turn, all else becomes N.
Graphs are the read-overlap graph of those reads, and the graph of parts that follow one another within an order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import edges, sequence, text
from strandmill.operators import graph, overlap, wordfreq
from strandmill.plans.mr import KV
from strandmill.session import cut, new_path, table
from strandmill.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K, SHARED = 17, 100
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACA"
NO_CAP = 2**31 - 1


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("header"), sequence.in_bases("text", LETTERS, BASES).alias("seq"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reads`` whose letters are dealt onto the bases where the k-mers are made."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read-overlap graph without a degree cap: pairs that share SHARED k-mers."""
    return overlap.shared_by_reads(_texts(spark, sf_dir), K, NO_CAP, SHARED, letters=(LETTERS, BASES))


def part_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vi, vj, w): from each line's part to the next line's part of the order; w is the smallest quantity."""
    line = table(spark, sf_dir, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return line.select(F.col("l_partkey").alias("vi"), after.alias("vj"), F.col("l_quantity").alias("w")).where("vj is not null and vi <> vj").groupBy("vi", "vj").agg(F.min("w").alias("w"))


_READS = f"reads AS (SELECT doc_id AS id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') AS seq FROM documents), pieces AS (SELECT id, unnest(string_split(seq, 'N')) AS p FROM reads), wins AS (SELECT id, p, unnest(range(1, length(p) - {K} + 2)) AS i FROM pieces WHERE length(p) >= {K}), fwd AS (SELECT id, substr(p, i, {K}) AS f FROM wins), "
_KMERS = _READS + "km AS (SELECT DISTINCT id, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM fwd), "
_EDGES = _KMERS + f"e AS (SELECT a.id AS src, b.id AS dst, count(*) AS w FROM km a JOIN km b ON a.kmer = b.kmer AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= {SHARED}), "
_STEPS = "st AS (SELECT vi, vj, min(w) AS w FROM (SELECT l_partkey AS vi, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS vj, l_quantity AS w FROM lineitem) WHERE vj IS NOT NULL AND vi <> vj GROUP BY 1, 2), up AS (SELECT DISTINCT least(vi, vj) AS vi, greatest(vi, vj) AS vj FROM st), "


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.rstrip(', ')} {select}"


# k-mers


@query(_with(_KMERS, "SELECT kmer, count(*) AS cnt FROM km GROUP BY kmer"))
def kmer_count(spark, sf_dir):
    return overlap.kmer_counts(reads(spark, sf_dir), K)


@query(_with(_READS, "SELECT kmer, count(*) AS cnt FROM (SELECT DISTINCT id, unnest([f, reverse(translate(f, 'ACGT', 'TGCA'))]) AS kmer FROM fwd) GROUP BY kmer"))
def kmer_count_both_strands(spark, sf_dir):
    return overlap.kmer_counts(reads(spark, sf_dir), K, canonical=False)


@query(_with(_KMERS, f"SELECT CAST(list_sum(list_transform(range(1, {K} + 1), lambda i: (strpos('CTAG', substr(kmer, i, 1)) - 1) * CAST(4 AS BIGINT) ** ({K} - i))) AS BIGINT) AS number, kmer, kmer AS back FROM (SELECT DISTINCT kmer FROM km)"))
def kmer_number(spark, sf_dir):
    every = overlap.read_kmers(reads(spark, sf_dir), K).select("kmer").distinct()
    return every.select(sequence.kmer_to_number("kmer").alias("number"), "kmer", sequence.number_to_kmer(sequence.kmer_to_number("kmer"), K).alias("back"))


@query(_with(_KMERS, f"SELECT kmer, to_base64(unhex(array_to_string(list_transform(range(0, {(K + 3) // 4}), lambda j: printf('%02X', CAST(list_sum(list_transform(range(0, 4), lambda i: greatest(strpos('ATCG', substr(rpad(kmer, {(K + 3) // 4 * 4}, 'A'), j * 4 + i + 1, 1)) - 1, 0) * CAST(4 AS BIGINT) ** (3 - i))) AS INTEGER))), ''))) AS code FROM (SELECT DISTINCT kmer FROM km)"))
def kmer_base64(spark, sf_dir):
    return overlap.read_kmers(reads(spark, sf_dir), K).select("kmer").distinct().select("kmer", sequence.kmer_to_base64("kmer").alias("code"))


@query(_with(_READS, "SELECT f AS kmer, count(*) AS cnt FROM fwd GROUP BY f"))
def windows_in_order(spark, sf_dir):
    made = reads(spark, sf_dir).select(F.explode(sequence.generate_kmers_in_order("seq", K, canonical=False)).alias("kmer"))
    return made.groupBy("kmer").agg(F.count("*").alias("cnt"))


@query(_with(_KMERS, "SELECT kmer, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS reads FROM km GROUP BY kmer HAVING count(*) >= 2"))
def kmer_read_map(spark, sf_dir):
    return overlap.kmer_read_map(reads(spark, sf_dir), K).select("kmer", F.array_join(F.transform("reads", lambda x: x.cast("string")), " ").alias("reads"))


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc, least(upper(p_name), reverse(translate(upper(p_name), 'ACGT', 'TGCA'))) AS canonical FROM part")
def reverse_complements(spark, sf_dir):
    own = table(spark, sf_dir, "part").withColumn("s", F.upper("p_name"))
    return own.select("p_partkey", sequence.reverse_complement("s").alias("rc"), sequence.canonical_kmer("s").alias("canonical"))


@query(_with(_READS, f"SELECT id, CASE WHEN length(seq) > {K} THEN substr(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END, CAST(('0x' || substr(h, 1, 8))::BIGINT % (length(seq) - {K}) AS INTEGER) + 1, {K}) END AS kmer FROM (SELECT id, seq, md5('7 ' || seq) AS h FROM reads)"))
def random_kmers(spark, sf_dir):
    return reads(spark, sf_dir).select("id", sequence.random_kmer("seq", K, 7).alias("kmer"))


# the read graph


@query(_with(_EDGES, "SELECT src, dst, w FROM e"))
def read_edges(spark, sf_dir):
    return document_edges(spark, sf_dir)


_CODE = f"CAST(list_sum(list_transform(range(1, {K} + 1), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * CAST(4 AS BIGINT) ** ({K} - i))) AS BIGINT)"


@query(
    _with(
        _KMERS + "t AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer HAVING count(*) > 1), few AS (SELECT km.kmer, id, 0 AS part FROM km JOIN t ON t.kmer = km.kmer WHERE n <= 100), "
        f"codes AS (SELECT kmer, n, {_CODE} AS code FROM t WHERE n > 100), many AS (SELECT km.kmer, id, CAST(('0x' || substr(md5(code || '  ' || id || ' 1'), 1, 8))::BIGINT % CAST(ceil(n / 100) AS BIGINT) AS INTEGER) AS part FROM km JOIN codes ON codes.kmer = km.kmer), dealt AS (SELECT * FROM few UNION ALL SELECT * FROM many), ",
        "SELECT a.id AS src, b.id AS dst, count(*) AS w FROM dealt a JOIN dealt b ON b.kmer = a.kmer AND b.part = a.part AND a.id < b.id GROUP BY 1, 2",
    )
)
def read_edges_capped(spark, sf_dir):
    return overlap.shared_by_reads(_texts(spark, sf_dir), K, 100, 1, seed=1, letters=(LETTERS, BASES))


@query(_with(_EDGES, "SELECT CAST((src + dst) % 4 AS BIGINT) AS part, src, dst, w FROM e"))
def read_edge_parts(spark, sf_dir):
    own = cut(document_edges(spark, sf_dir), "edges")
    parts = [overlap.edge_part(own, i, 4).select(F.lit(i).cast("long").alias("part"), "src", "dst", "w") for i in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(_with(_EDGES, "SELECT node, nbr, w, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, nbr) AS rank FROM (SELECT src AS node, dst AS nbr, w FROM e UNION ALL SELECT dst, src, w FROM e)) WHERE rank <= 5"))
def top_neighbors(spark, sf_dir):
    return overlap.top_neighbours(document_edges(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))


@query(_with(_EDGES, "SELECT src, dst, round(w / avg(w) OVER (), 9) AS w FROM e"))
def edge_normalize(spark, sf_dir):
    return overlap.normalized_weights(document_edges(spark, sf_dir)).select("src", "dst", F.round("w", 9).alias("w"))


def _label_sql(rounds: int) -> str:
    ctes = _EDGES + "b AS (SELECT src AS node, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT DISTINCT node, node AS label FROM b), "
    for i in range(rounds):
        ctes += (
            f"v{i} AS (SELECT b.node, l{i}.label, count(*) AS s FROM b JOIN l{i} ON l{i}.node = b.nbr GROUP BY 1, 2), "
            f"s{i} AS (SELECT node, label, sum(s) AS s FROM (SELECT node, label, s FROM v{i} UNION ALL SELECT node, label, 1 FROM l{i}) GROUP BY 1, 2), "
            f"l{i + 1} AS (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY s DESC, label) AS r FROM s{i}) WHERE r = 1), "
        )
    return _with(ctes, f"SELECT node, label FROM l{rounds}")


@query(_label_sql(3))
def label_rounds(spark, sf_dir):
    """Three rounds of label propagation."""
    return overlap.label_propagation(document_edges(spark, sf_dir), most_rounds=3).select("node", "label")


def _rest_sql(rounds: int) -> str:
    """Label propagation where only nodes that changed are looked at again; at rest within so many rounds on the oracle's tables."""
    ctes = _EDGES.replace("e AS (", "e AS MATERIALIZED (") + "b AS MATERIALIZED (SELECT src AS node, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e), l0 AS MATERIALIZED (SELECT DISTINCT node, node AS label, true AS changed FROM b), "
    for i in range(rounds):
        ctes += (
            f"s{i} AS (SELECT node, label, sum(s) AS s FROM (SELECT b.node, n.label, 1 AS s FROM b JOIN l{i} n ON n.node = b.nbr JOIN l{i} o ON o.node = b.node AND o.changed UNION ALL SELECT node, label, 1 FROM l{i} WHERE changed) GROUP BY 1, 2), "
            f"w{i} AS (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY s DESC, label) AS r FROM s{i}) WHERE r = 1), "
            f"l{i + 1} AS MATERIALIZED (SELECT l.node, coalesce(w.label, l.label) AS label, coalesce(w.label <> l.label, false) AS changed FROM l{i} l LEFT JOIN w{i} w ON w.node = l.node), "
        )
    return _with(ctes, f"SELECT node, label FROM l{rounds}")


@query(_rest_sql(40))
def label_propagation(spark, sf_dir):
    return overlap.label_propagation(document_edges(spark, sf_dir), mode="as_written").select("node", "label")


_ZONES = _EDGES + "b AS (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT DISTINCT v, v AS z FROM b UNION SELECT b.u, r.z FROM r JOIN b ON b.v = r.v WHERE r.z < b.u), zones AS (SELECT v, min(z) AS zone FROM r GROUP BY v), "


def _zones(spark, sf_dir):
    return graph.cc_find(document_edges(spark, sf_dir).select(F.col("src").alias("vi"), F.col("dst").alias("vj")))


@query(_with(_ZONES, "SELECT v, zone FROM zones", recursive=True))
def connected_components(spark, sf_dir):
    return _zones(spark, sf_dir)


@query(_with(_ZONES, "SELECT size, count(*) AS zones FROM (SELECT count(*) AS size FROM zones GROUP BY zone) GROUP BY size", recursive=True))
def component_stats(spark, sf_dir):
    return graph.cc_stats(_zones(spark, sf_dir))


# the graph of parts


@query(_with(_STEPS, "SELECT vi, vj FROM up"))
def edge_upper(spark, sf_dir):
    return graph.edge_upper(part_steps(spark, sf_dir))


@query(_with(_STEPS, "SELECT v, count(*) AS degree FROM (SELECT vi AS v FROM st UNION ALL SELECT vj FROM st) GROUP BY v"))
def degree(spark, sf_dir):
    return graph.degree(part_steps(spark, sf_dir))


@query(_with(_STEPS, "SELECT vi AS v, count(*) AS degree FROM st GROUP BY vi"))
def degree_first(spark, sf_dir):
    return graph.degree(part_steps(spark, sf_dir), first_only=True)


@query(_with(_STEPS, "SELECT degree, count(*) AS vertices FROM (SELECT v, count(*) AS degree FROM (SELECT vi AS v FROM st UNION ALL SELECT vj FROM st) GROUP BY v) GROUP BY degree"))
def degree_stats(spark, sf_dir):
    return graph.degree_stats(part_steps(spark, sf_dir))


@query(_with(_STEPS, "SELECT st.vi, vj, 1 / d AS w FROM st JOIN (SELECT vi, CAST(count(*) AS DOUBLE) AS d FROM st GROUP BY vi) x ON x.vi = st.vi"))
def degree_weight(spark, sf_dir):
    return graph.degree_weight(part_steps(spark, sf_dir))


@query(_with(_STEPS, "SELECT vi AS v FROM st UNION SELECT vj FROM st"))
def vertex_extract(spark, sf_dir):
    return graph.vertex_extract(part_steps(spark, sf_dir))


@query(_with(_STEPS, "SELECT v, string_agg(CAST(u AS VARCHAR), ' ' ORDER BY u) AS nbrs FROM (SELECT vi AS v, vj AS u FROM up UNION ALL SELECT vj, vi FROM up) GROUP BY v"))
def neighbor_lists(spark, sf_dir):
    return graph.neighbors(graph.edge_upper(part_steps(spark, sf_dir))).select("v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


_TRI = _STEPS + "dg AS (SELECT v, count(*) AS d FROM (SELECT vi AS v FROM up UNION ALL SELECT vj FROM up) GROUP BY v), tri AS (SELECT a.vi AS x, a.vj AS y, b.vj AS z FROM up a JOIN up b ON b.vi = a.vj JOIN up c ON c.vi = a.vi AND c.vj = b.vj), ranked AS (SELECT x, y, z, CASE WHEN dx.d <= dy.d AND dx.d <= dz.d THEN x WHEN dy.d <= dz.d THEN y ELSE z END AS vi FROM tri JOIN dg dx ON dx.v = x JOIN dg dy ON dy.v = y JOIN dg dz ON dz.v = z), t AS (SELECT vi, CASE WHEN vi = x THEN y ELSE x END AS vj, CASE WHEN vi = z THEN y ELSE z END AS vk FROM ranked), "


@query(_with(_TRI, "SELECT vi, vj, vk FROM t"))
def triangles(spark, sf_dir):
    return graph.triangles(cut(graph.edge_upper(part_steps(spark, sf_dir)), "upper"))


@query(_with(_TRI, "SELECT vi AS v, vi AS a, vj AS b FROM up UNION ALL SELECT vj, vj, vi FROM up UNION ALL SELECT x, y, z FROM tri UNION ALL SELECT y, x, z FROM tri UNION ALL SELECT z, x, y FROM tri"))
def neighbors_with_triangles(spark, sf_dir):
    return graph.neighbors_with_triangles(cut(graph.edge_upper(part_steps(spark, sf_dir)), "upper"))


_DRAW = "CAST(((25214903917::HUGEINT * (((v + 12345) % 4294967296)::HUGEINT * 65536 + 13070) + 11) % 281474976710656) AS DOUBLE) / 281474976710656.0::DOUBLE"


def _set_sql(rounds: int) -> str:
    """Vertices that have the smallest draw among those left around them join, and leave with their neighbours."""
    ctes = _STEPS.replace("up AS (", "up AS MATERIALIZED (") + "b AS MATERIALIZED (SELECT vi AS v, vj AS u FROM up UNION ALL SELECT vj, vi FROM up), " + f"a0 AS MATERIALIZED (SELECT v, {_DRAW} AS r FROM (SELECT DISTINCT v FROM b)), "
    for i in range(rounds):
        ctes += (
            f"w{i} AS MATERIALIZED (SELECT v FROM a{i} WHERE v NOT IN (SELECT x.v FROM a{i} x JOIN b ON b.v = x.v JOIN a{i} y ON y.v = b.u WHERE (y.r, y.v) < (x.r, x.v))), "
            f"a{i + 1} AS MATERIALIZED (SELECT * FROM a{i} WHERE v NOT IN (SELECT v FROM w{i}) AND v NOT IN (SELECT b.u FROM b JOIN w{i} ON w{i}.v = b.v)), "
        )
    return _with(ctes, " UNION ALL ".join(f"SELECT v FROM w{i}" for i in range(rounds)))


@query(_set_sql(25))
def independent_set(spark, sf_dir):
    return graph.luby(graph.edge_upper(part_steps(spark, sf_dir)), 12345)


def _relax_sql(rounds: int, materialized: bool = False, source: str = "SELECT CAST(1 AS BIGINT) AS v") -> str:
    kept = "AS MATERIALIZED (" if materialized else "AS ("
    ctes = _STEPS.replace("st AS (", f"st {kept}") + f"d0 {kept}SELECT v, CAST(0 AS DOUBLE) AS dist, CAST(NULL AS BIGINT) AS pred FROM ({source})), "
    for i in range(rounds):
        ctes += f"d{i + 1} {kept}SELECT v, dist, pred FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY dist, pred NULLS FIRST) AS r FROM (SELECT v, dist, pred FROM d{i} UNION ALL SELECT st.vj, d.dist + st.w, st.vi FROM d{i} d JOIN st ON st.vi = d.v)) WHERE r = 1), "
    return _with(ctes, f"SELECT v, dist, coalesce(pred, -1) AS pred FROM d{rounds}")


@query(_relax_sql(3))
def shortest_paths_rounds(spark, sf_dir):
    """Three rounds of relaxation from part 1."""
    steps = cut(part_steps(spark, sf_dir), "steps")
    state = spark.createDataFrame([(1, 0.0, None)], "v long, dist double, pred long")
    for _ in range(3):
        state = graph.relaxed(state, steps)
    return state.select("v", "dist", F.coalesce("pred", F.lit(-1)).alias("pred"))


@query(_relax_sql(40, materialized=True))
def shortest_paths(spark, sf_dir):
    return graph.sssp(cut(part_steps(spark, sf_dir), "steps"), 1).select("v", "dist", F.coalesce("pred", F.lit(-1)).alias("pred"))


def _rank_sql(rounds: int) -> str:
    ctes = _STEPS + "sh AS (SELECT vi, vj, w / sum(w) OVER (PARTITION BY vi) AS share FROM st), vs AS (SELECT vi AS v FROM st UNION SELECT vj FROM st), r0 AS (SELECT v, 1.0::DOUBLE / count(*) OVER () AS rank FROM vs), "
    for i in range(rounds):
        ctes += f"f{i} AS (SELECT sh.vj AS v, sum(r.rank * sh.share) AS got FROM r{i} r JOIN sh ON sh.vi = r.v GROUP BY 1), o{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{i} WHERE v NOT IN (SELECT vi FROM st)), r{i + 1} AS (SELECT vs.v, 0.15::DOUBLE / (SELECT count(*) FROM vs) + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT loose FROM o{i}) / (SELECT count(*) FROM vs)) AS rank FROM vs LEFT JOIN f{i} ON f{i}.v = vs.v), "
    return _with(ctes, f"SELECT v, round(rank, 10) AS rank FROM r{rounds}")


@query(_rank_sql(5))
def pagerank(spark, sf_dir):
    return graph.pagerank(part_steps(spark, sf_dir), rounds=5).select("v", F.round("rank", 10).alias("rank"))


@query("SELECT CAST(8192 AS BIGINT) AS edges, CAST(8192 AS BIGINT) AS distinct_edges, CAST(0 AS BIGINT) AS outside")
def rmat(spark, sf_dir):
    """What must hold of a generated graph: as many distinct edges as asked for, all between its vertices."""
    made = graph.rmat(spark, 10, 8, 0.25, 0.25, 0.25, 0.25, 0.1, 12345)
    inside = F.col("vi").between(0, 1023) & F.col("vj").between(0, 1023)
    return made.agg(F.count("*").alias("edges"), F.count_distinct("vi", "vj").alias("distinct_edges"), F.count_if(~inside).alias("outside"))


@query()
def rmat_edges(spark, sf_dir):
    return graph.rmat(spark, 10, 8, 0.4, 0.2, 0.2, 0.2, 0.1, 12345)


# words and keys

_WORDS = "wd AS (SELECT unnest(string_split_regex(text, '[ \\t\\n\\f\\r]+')) AS word FROM documents), "


@query(_with(_WORDS, "SELECT word, count(*) AS cnt FROM wd WHERE word <> '' GROUP BY word"))
def word_freq(spark, sf_dir):
    return wordfreq.word_counts(table(spark, sf_dir, "documents"), "text")


@query(_with(_WORDS, "SELECT word, count(*) AS cnt FROM wd WHERE word <> '' GROUP BY word ORDER BY cnt DESC, word LIMIT 20"))
def word_top(spark, sf_dir):
    return wordfreq.top_words(table(spark, sf_dir, "documents"), 20, "text")


@query("SELECT times, count(*) AS keys FROM (SELECT count(*) AS times FROM events GROUP BY user_id) GROUP BY times")
def histo(spark, sf_dir):
    return graph.histo(table(spark, sf_dir, "events"), "user_id")


def _events(spark, sf_dir):
    return KV(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value")))


@query("SELECT event_type AS key, string_agg(CAST(user_id AS VARCHAR), ' ' ORDER BY user_id) AS value FROM events GROUP BY event_type")
def kv_group(spark, sf_dir):
    made = _events(spark, sf_dir).collate().sort_multivalues()
    return made.rows.select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value"))


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
def kv_count(spark, sf_dir):
    return _events(spark, sf_dir).count().rows


@query("SELECT event_type AS key, min(user_id) AS value FROM events GROUP BY event_type")
def kv_cull(spark, sf_dir):
    return _events(spark, sf_dir).cull().rows


@query("SELECT event_type AS key, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY event_type")
def kv_sum(spark, sf_dir):
    return _events(spark, sf_dir).summed().rows


@query("SELECT event_type AS key, user_id AS value FROM events UNION ALL SELECT event_type, user_id FROM events")
def kv_union(spark, sf_dir):
    own = _events(spark, sf_dir)
    return own.add(own.copy()).rows


@query("SELECT event_type AS key, CAST(max(user_id) - min(user_id) AS BIGINT) AS value FROM events GROUP BY event_type")
def kv_reduce(spark, sf_dir):
    """A reduce callback."""
    import pandas as pd

    def spread(key, rows):
        return pd.DataFrame({"key": [key], "value": [int(rows["value"].max() - rows["value"].min())]})

    return _events(spark, sf_dir).reduce(spread, "key string, value long").rows


_SUMS = "SELECT event_type AS key, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY event_type"


def _summed(key, rows):
    import pandas as pd

    return pd.DataFrame({"key": [key], "value": [int(rows["value"].sum())]})


@query(_SUMS)
def kv_compress(spark, sf_dir):
    """Partial sums before the shuffle, then whole ones."""
    return _events(spark, sf_dir).compress(_summed, "key string, value long").reduce(_summed, "key string, value long").rows


@query(_SUMS)
def kv_convert(spark, sf_dir):
    """Groups within partitions, once equal keys are in one."""
    grouped = _events(spark, sf_dir).aggregate(n=8).convert()
    return grouped.rows.select("key", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("value"))


@query(_SUMS)
def kv_blocks(spark, sf_dir):
    """Blocks of at most 100 values, summed apart and then together."""
    blocks = _events(spark, sf_dir).blocks(100)
    return KV(blocks.select("key", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("value"))).summed().rows


@query("SELECT event_type AS key, CAST(1 AS BIGINT) AS value FROM events")
def kv_clone(spark, sf_dir):
    return _events(spark, sf_dir).clone().count().rows


@query("SELECT 'all' AS key, count(*) AS value FROM events")
def kv_scrunch(spark, sf_dir):
    return _events(spark, sf_dir).scrunch(1, F.lit("all")).count().rows


@query("SELECT CAST(range AS VARCHAR) AS key, range * range AS value FROM range(100)")
def kv_tasks(spark, sf_dir):
    import pandas as pd

    return KV.tasks(spark, 100, lambda i: pd.DataFrame({"key": [str(i)], "value": [i * i]}), "key string, value long").rows


@query("SELECT event_type AS key, user_id + 1 AS value FROM events UNION ALL SELECT CAST(user_id AS VARCHAR), strlen(event_type) FROM events WHERE user_id % 2 = 0")
def kv_two_outputs(spark, sf_dir):
    """A map callback with a second output."""
    import pandas as pd

    def both(rows):
        even = rows[rows["value"] % 2 == 0]
        return pd.DataFrame({"key": rows["key"], "value": rows["value"] + 1}), pd.DataFrame({"key": even["value"].astype(str), "value": even["key"].str.len()})

    first, second = _events(spark, sf_dir).map_two(both, "key string, value long", "key string, value long")
    return first.add(second).rows


@query("SELECT event_type AS key, string_agg(CAST(user_id AS VARCHAR), ' ' ORDER BY user_id DESC) AS value FROM events GROUP BY event_type")
def kv_group_descending(spark, sf_dir):
    made = _events(spark, sf_dir).collate().sort_multivalues(compare=lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return made.rows.select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS value FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def sort_texts_as_numbers(spark, sf_dir):
    """Keys that are texts, in the order of the numbers they spell."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("value"))
    return KV(own).sort_keys(ascending=False, whole=True, order="uint64").rows.limit(50)


@query("SELECT event_type AS key, user_id AS value, r FROM (SELECT event_type, user_id, count(*) AS r FROM events GROUP BY 1, 2)")
def kv_looked_up(spark, sf_dir):
    """Each pair with its count, by a replicated table of distinct pairs."""
    own = _events(spark, sf_dir)
    counts = KV(own.rows.groupBy("key", "value").agg(F.count("*").alias("r")).select(F.struct("key", "value").alias("key"), F.col("r").alias("value"))).broadcast()
    return own.rows.distinct().join(counts.rows.select("key.key", F.col("key.value").alias("value"), F.col("value").alias("r")), ["key", "value"])


@query("SELECT l_orderkey AS key, max(l_quantity) AS value FROM lineitem GROUP BY l_orderkey ORDER BY key DESC LIMIT 50")
def sort_keys_top(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_quantity").alias("value"))
    return KV(own).sort_keys(ascending=False, whole=True).rows.limit(50)


@query("SELECT count(*) AS keys, count(user_id) AS \"values\", CAST(sum(strlen(event_type)) AS BIGINT) AS key_bytes, CAST(sum(strlen(CAST(user_id AS VARCHAR))) AS BIGINT) AS value_bytes FROM events")
def kv_stats(spark, sf_dir):
    return _events(spark, sf_dir).stats()


# scalar functions


@query("SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c))) AS BIGINT) AS total FROM part")
def hash_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sequence.hash_string("p_name").cast("long").alias("total"))


@query(f"SELECT o_orderkey AS n, coalesce(nullif(ltrim(array_to_string(list_transform(range(0, 11), lambda i: substr('{sequence.BASE64}', CAST((o_orderkey >> CAST(60 - 6 * i AS BIGINT)) % 64 AS INTEGER) + 1, 1)), ''), 'A'), ''), 'A') AS code, o_orderkey AS back FROM orders")
def base64_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), sequence.long_to_base64("o_orderkey").alias("code"), sequence.base64_to_long(sequence.long_to_base64("o_orderkey")).cast("long").alias("back"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[ ,.]'), lambda x: x <> '')) AS fields, regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS trimmed FROM documents")
def split_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.split("text", " ,.")).cast("long").alias("fields"), text.trim("text").alias("trimmed"))


@query("SELECT v, CAST(((25214903917::HUGEINT * (((v + 12345) % 4294967296)::HUGEINT * 65536 + 13070) + 11) % 281474976710656) AS DOUBLE) / 281474976710656.0::DOUBLE AS r FROM (SELECT DISTINCT l_partkey AS v FROM lineitem)")
def vertex_randoms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v")).distinct().select("v", text.vertex_random("v", 12345).alias("r"))


@query("SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, round(log10(abs(c_acctbal) + 1), 6) AS lg, round(ln(abs(c_acctbal) + 1), 6) AS nat, ceil(c_acctbal)::BIGINT AS up, floor(c_acctbal)::BIGINT AS down FROM customer")
def script_math(spark, sf_dir):
    b, m = F.abs("c_acctbal"), text.MATH
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(m["sqrt"](b), 6).alias("root"), F.round(m["log"](b + 1), 6).alias("lg"), F.round(m["ln"](b + 1), 6).alias("nat"), m["ceil"]("c_acctbal").cast("long").alias("up"), m["floor"]("c_acctbal").cast("long").alias("down"))


@query("SELECT c_custkey, round(exp(x), 9) AS e, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(tan(x), 9) AS t, round(asin(x), 9) AS a_s, round(acos(x), 9) AS a_c, round(atan(x), 9) AS a_t, round(atan2(x, 2.0), 9) AS a_2, round(c_acctbal)::BIGINT AS near FROM (SELECT c_custkey, c_acctbal, c_acctbal / 20000 AS x FROM customer)")
def script_trigonometry(spark, sf_dir):
    m, x = text.MATH, F.col("c_acctbal") / 20000
    one = {"e": "exp", "s": "sin", "c": "cos", "t": "tan", "a_s": "asin", "a_c": "acos", "a_t": "atan"}
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.round(m[f](x), 9).alias(c) for c, f in one.items()], F.round(m["atan2"](x, F.lit(2.0)), 9).alias("a_2"), m["round"]("c_acctbal").cast("long").alias("near"))


@query("SELECT c_custkey, c_nationkey + c_custkey AS plus, c_nationkey - c_custkey AS minus, c_nationkey * c_custkey AS times, round(c_nationkey / (c_custkey + 1), 9) AS ratio, round(pow(c_nationkey, 2)) AS square, -c_custkey AS negative, c_nationkey = 3 AS eq, c_nationkey <> 3 AS ne, c_nationkey < 3 AS lt, c_nationkey <= 3 AS le, c_nationkey > 3 AS gt, c_nationkey >= 3 AS ge, c_nationkey > 3 AND c_custkey > 9 AS both_, c_nationkey > 3 OR c_custkey > 9 AS either, NOT c_nationkey > 3 AS inverse FROM customer")
def script_operators(spark, sf_dir):
    o, n, k, three, nine = text.OPERATORS, F.col("c_nationkey"), F.col("c_custkey"), F.lit(3), F.lit(9)
    tests = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    made = [o["+"](n, k).alias("plus"), o["-"](n, k).alias("minus"), o["*"](n, k).alias("times"), F.round(o["/"](n, k + 1), 9).alias("ratio"), F.round(o["^"](n, F.lit(2))).alias("square"), o["neg"](k).alias("negative")]
    made += [o[f](n, three).alias(c) for c, f in tests.items()]
    big, late = o[">"](n, three), o[">"](k, nine)
    return table(spark, sf_dir, "customer").select("c_custkey", *made, o["&&"](big, late).alias("both_"), o["||"](big, late).alias("either"), o["!"](big).alias("inverse"))


@query("SELECT p_partkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296)::BIGINT AS hash FROM part")
def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sequence.fnv_hash("p_name").alias("hash"))


@query("SELECT p_partkey, to_base64(encode(p_name)) AS code, ((strlen(p_name) + 2) // 3 * 4 + 1)::BIGINT AS size FROM part")
def base64_texts(spark, sf_dir):
    code = sequence.base64_encode("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), (F.length(code) + 1).cast("long").alias("size"))


@query("SELECT p_partkey, i AS piece, i * (length(p_name) // 3) AS \"offset\", CASE WHEN i = 2 THEN substr(p_name, i * (length(p_name) // 3) + 1) ELSE substr(p_name, i * (length(p_name) // 3) + 1, length(p_name) // 3) END AS value FROM part, range(3) r(i)")
def even_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(sequence.split_evenly("p_name", 3)).alias("piece", "x"))
    return rows.select("p_partkey", F.col("piece").cast("long").alias("piece"), F.col("x.offset").cast("long").alias("offset"), F.col("x.piece").alias("value"))


@query("SELECT c_custkey, ends_with(c_name, '1') AS ends, CAST(c_nationkey AS VARCHAR) AS written, TRY_CAST(right(c_name, 4) AS INTEGER)::BIGINT AS number, regexp_replace(' ' || c_name, '^[ ]+', '') AS cut FROM customer")
def string_helpers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.endswith("c_name", "1").alias("ends"), text.int_to_string("c_nationkey").alias("written"), text.string_to_int(F.expr("right(c_name, 4)")).cast("long").alias("number"), text.ltrim(F.concat(F.lit(" "), "c_name")).alias("cut"))


@query(_with(_STEPS, "SELECT 'vertex' AS kind, vi AS a, -1 AS b FROM st UNION ALL SELECT 'pair', vi, vj FROM st UNION ALL SELECT 'both', vi, -1 FROM st UNION ALL SELECT 'both', vj, -1 FROM st UNION ALL SELECT 'upper', least(vi, vj), greatest(vi, vj) FROM st UNION ALL SELECT 'inverse', vj, vi FROM st UNION ALL SELECT 'label', vi, 1 FROM st UNION ALL SELECT 'weight', vi, 1 FROM st"))
def edge_callbacks(spark, sf_dir):
    st = cut(part_steps(spark, sf_dir), "steps")
    made = {
        "vertex": edges.to_vertex(st).select("v", F.lit(-1)), "pair": edges.to_vertex_pair(st).select("v", "u"), "both": edges.to_vertices(st).select("v", F.lit(-1)),
        "upper": edges.upper(st).select("vi", "vj"), "inverse": edges.invert(st.select(F.col("vi").alias("key"), F.col("vj").alias("value"))).select("key", "value"),
        "label": edges.add_label(st).select("vi", "label"), "weight": edges.add_weight(st).select("vi", "w"),
    }
    rows = [x.toDF("a", "b").select(F.lit(k).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")) for k, x in made.items()]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT l_orderkey, least(a.l_linenumber, b.l_linenumber)::BIGINT AS a, greatest(a.l_linenumber, b.l_linenumber)::BIGINT AS b FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber")
def pairs_of_lists(spark, sf_dir):
    """All unordered pairs of short lists: an order's line numbers."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long"))).alias("n"))
    return lists.select("l_orderkey", F.explode(sequence.read_pairs("n", 100)).alias("p")).select("l_orderkey", "p.a", "p.b")


@query(_with(_STEPS, "SELECT '%%MatrixMarket matrix coordinate real general' AS line UNION ALL SELECT '%' UNION ALL SELECT '1000000 1000000 ' || count(*) FROM st"))
def matrix_market_head(spark, sf_dir):
    to = new_path(spark, "matrix")
    sinks.matrix_market(part_steps(spark, sf_dir), to, 1_000_000)
    return readers.lines(spark, f"{to}.header").select(F.col("value").alias("line"))


# text files: tables written by the sinks and read back by the readers


@query(_with(_READS, "SELECT id, '' AS header, seq FROM reads WHERE seq IS NOT NULL"))
def text_reads(spark, sf_dir):
    to = new_path(spark, "reads")
    sinks.reads(reads(spark, sf_dir).where("seq is not null"), to, gzip=True)
    return readers.reads(spark, to)


@query(_with(_KMERS, "SELECT km.kmer, id FROM km JOIN (SELECT kmer FROM km GROUP BY kmer HAVING count(*) >= 2) x ON x.kmer = km.kmer"))
def text_kmer_map(spark, sf_dir):
    to = new_path(spark, "map")
    sinks.kmer_map(overlap.kmer_read_map(reads(spark, sf_dir), K), to, gzip=True)
    return readers.kmer_maps(spark, to)


@query(_with(_KMERS, "SELECT kmer, count(*) AS cnt FROM km GROUP BY kmer"))
def text_counts_merged(spark, sf_dir):
    """Counts of two halves of the reads, written apart and merged."""
    parts = [new_path(spark, "counts") for _ in range(2)]
    for i, to in enumerate(parts):
        sinks.pairs(overlap.kmer_counts(reads(spark, sf_dir).where(F.pmod("id", F.lit(2)) == i), K), to, "kmer", "cnt")
    return overlap.merge_counts(*[readers.kmer_counts(spark, to) for to in parts])


@query(_with(_EDGES, "SELECT src, dst, CAST(w AS DOUBLE) AS w FROM e"))
def text_edges(spark, sf_dir):
    to = new_path(spark, "edges")
    sinks.edge_lines(document_edges(spark, sf_dir), to, gzip=True)
    return readers.edge_list(spark, to, weighted=True)


@query(_with(_EDGES, "SELECT node AS vi, nbr AS vj, CAST(w AS DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, nbr) AS rank FROM (SELECT src AS node, dst AS nbr, w FROM e UNION ALL SELECT dst, src, w FROM e)) WHERE rank <= 5"))
def text_top_neighbors(spark, sf_dir):
    to = new_path(spark, "top")
    sinks.top_neighbours(overlap.top_neighbours(document_edges(spark, sf_dir), 5), to)
    return readers.weighted_edges(spark, to)


@query(_with(_EDGES, "SELECT src AS vi, dst AS vj, CAST(printf('%.6f', w / avg(w) OVER ()) AS DOUBLE) AS w FROM e"))
def text_normalized(spark, sf_dir):
    to = new_path(spark, "normalized")
    sinks.normalized(overlap.normalized_weights(document_edges(spark, sf_dir)), to)
    return readers.weighted_edges(spark, to)


@query(_with(_ZONES, "SELECT v, zone FROM zones", recursive=True))
def text_zones(spark, sf_dir):
    to = new_path(spark, "zones")
    sinks.fields(_zones(spark, sf_dir), to)
    return readers.zones(spark, to)


@query(_with(_ZONES, "SELECT count(DISTINCT zone) AS components, count(*) AS vertices FROM zones", recursive=True))
def component_totals(spark, sf_dir):
    return graph.cc_totals(_zones(spark, sf_dir))


@query(_with(_TRI, "SELECT vi, vj, vk FROM t"))
def text_triangles(spark, sf_dir):
    to = new_path(spark, "triangles")
    sinks.fields(graph.triangles(cut(graph.edge_upper(part_steps(spark, sf_dir)), "upper")), to)
    return readers.triangle_list(spark, to)


@query(_with(_STEPS, "SELECT v, string_agg(CAST(u AS VARCHAR), ' ' ORDER BY u) AS nbrs FROM (SELECT vi AS v, vj AS u FROM up UNION ALL SELECT vj, vi FROM up) GROUP BY v"))
def text_neighbors(spark, sf_dir):
    to = new_path(spark, "neighbors")
    lists = graph.neighbors(graph.edge_upper(part_steps(spark, sf_dir)))
    sinks.pairs(lists, to, "v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " "), separator=" ")
    return readers.neighbour_lists(spark, to).select("v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query(_with(_WORDS, "SELECT word, count(*) AS cnt FROM wd WHERE word <> '' GROUP BY word"))
def text_words(spark, sf_dir):
    to = new_path(spark, "words")
    table(spark, sf_dir, "documents").where("text is not null").select("text").write.text(to)
    return wordfreq.word_counts(readers.lines(spark, to))


@query(_with(_READS, "SELECT row_number() OVER (ORDER BY id) AS id, 'r' || id AS header, regexp_replace(upper(seq), '[^ACGT]', 'N', 'g') AS seq FROM reads WHERE seq IS NOT NULL"))
def text_fastq(spark, sf_dir):
    """Reads as four-line records of one file, and back."""
    to = new_path(spark, "fastq")
    own = reads(spark, sf_dir).where("seq is not null")
    record = F.concat(F.lit("@r"), F.col("id").cast("string"), F.lit(" x\n"), F.lower("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    own.orderBy("id").coalesce(1).select(record.alias("value")).write.text(to)
    return readers.fastq(spark, to)


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id")
def histo_keys(spark, sf_dir):
    return graph.key_counts(table(spark, sf_dir, "events"), "user_id")


@query(_relax_sql(60, materialized=True, source="SELECT v FROM (SELECT v, row_number() OVER (ORDER BY md5(v || ' 12345'), v) AS r FROM (SELECT vi AS v FROM st UNION SELECT vj FROM st)) WHERE r = 10"))
def sssp_of_sources(spark, sf_dir):
    """The command: ten sources drawn by the seed, the paths of the last."""
    steps = cut(part_steps(spark, sf_dir), "steps")
    return graph.sssp(steps, graph.sources(steps, 10, 12345)[-1]).select("v", "dist", F.coalesce("pred", F.lit(-1)).alias("pred"))
