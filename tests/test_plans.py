import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill.operators.wordfreq import top_words, word_counts
from strandmill.plans.commands import Workspace, main
from strandmill.plans.mr import KV, ORDERS, callback, cumulative_stats, prefix, settings
from strandmill.sources import readers, sinks


@pytest.fixture()
def pairs(spark):
    return KV(spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("c", 2)], "key string, value long"))


@callback
def total(key, rows):
    return pd.DataFrame({"key": [key], "value": [int(rows["value"].sum())]})


def as_dict(kv):
    return {r.key: r[1] for r in kv.rows.collect()}


def test_reducers(pairs):
    assert as_dict(pairs.count()) == {"a": 2, "b": 1, "c": 1}
    assert as_dict(pairs.cull()) == {"a": 1, "b": 1, "c": 2}
    assert as_dict(pairs.summed()) == as_dict(pairs.reduce("total", "key string, value long")) == {"a": 4, "b": 1, "c": 2}
    assert as_dict(pairs.collate().sort_multivalues(ascending=False)) == {"a": [3, 1], "b": [1], "c": [2]}
    assert as_dict(pairs.gather(1).convert().count()) == {"a": 2, "b": 1, "c": 1}
    assert as_dict(pairs.gather(1).compress("total", "key string, value long").summed()) == {"a": 4, "b": 1, "c": 2}


def test_moves(pairs, spark):
    assert pairs.add(pairs.copy()).rows.count() == 8
    assert pairs.scrunch(1, F.lit("all")).rows.first()["values"].__len__() == 4
    assert [r.key for r in pairs.sort_keys(ascending=False, whole=True).rows.collect()] == ["c", "b", "a", "a"]
    assert pairs.collate().blocks(1).count() == 4
    assert tuple(pairs.stats().first()) == (4, 4, 4, 4)
    assert pairs.clone().grouped and pairs.aggregate().rows.count() == 4
    made = KV.tasks(spark, 3, lambda i: pd.DataFrame({"key": [str(i)], "value": [i]}), "key string, value long")
    assert as_dict(made) == {"0": 0, "1": 1, "2": 2}
    with pytest.raises(ValueError, match="pairs"):
        pairs.collate().collate()


def test_orders(spark):
    keys = lambda *rows: KV(spark.createDataFrame([(k, 0) for k in rows], "key string, value long"))
    sort = lambda kv, **how: [r.key for r in kv.sort_keys(whole=True, **how).rows.collect()]
    assert sort(keys("10", "9", "100")) == ["10", "100", "9"]
    assert sort(keys("10", "9", "100"), order="int") == ["9", "10", "100"]
    assert sort(keys("1.5", "-2", "1.25"), order="double", ascending=False) == ["1.5", "1.25", "-2"]
    assert sort(keys("-1", "5", str(2**63)), order="uint64") == ["5", str(2**63), "-1"]
    cut_short = KV(spark.createDataFrame([("abz",), ("aba",), ("aaz",)], "key string").withColumn("value", F.lit(0)))
    assert sort(cut_short, order=prefix(2))[0] == "aaz"
    assert ORDERS.keys() == {"int", "uint64", "float", "double", "str"}


def test_second_output_blocks_and_settings(pairs, spark):
    def both(rows):
        return rows.assign(value=rows["value"] * 2), pd.DataFrame({"key": rows["value"], "value": [None] * len(rows)})

    first, second = pairs.map_two(both, "key string, value long", "key long, value string")
    assert sorted(tuple(r) for r in first.rows.collect()) == [("a", 2), ("a", 6), ("b", 2), ("c", 4)]
    assert sorted(r.key for r in second.rows.collect()) == [1, 1, 2, 3] and second.rows.where("value is not null").isEmpty()
    hot = KV(spark.range(0, 1000, 1, 4).select((F.col("id") % 2 * 0).alias("key"), F.col("id").alias("value")))
    blocks = hot.blocks(30).collect()
    assert max(len(r["values"]) for r in blocks) == 30 and sorted(v for r in blocks for v in r["values"]) == list(range(1000))
    assert len({r.block for r in blocks}) == len(blocks)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    settings(spark, memsize=64, mapstyle=2, verbosity=0)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "64m"
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    with pytest.raises(ValueError, match="cannot set"):
        settings(spark, fpath="/tmp")
    stats = cumulative_stats(spark)
    assert stats["tasks"] > 0 and stats["shuffle_write_bytes"] > 0


def test_named_inputs(spark, tmp_path):
    for i in (1, 2, 3):
        (tmp_path / f"e{i}.txt").write_text(f"{i} {i + 1}\n")
    w = Workspace(spark, prepend=str(tmp_path), multi=2)
    assert w.run("edge_upper", i=["e%.txt"]).count() == 2
    w.variables["all"] = ["e1.txt", "e2.txt", "e3.txt"]
    assert w.run("edge_upper", i=["v_all"]).count() == 3
    w.set("e1.txt", spark.createDataFrame([(7, 8), (8, 7)], "vi long, vj long"))
    assert [tuple(r) for r in w.run("edge_upper", i=["e1.txt"]).collect()] == [(7, 8)]
    with pytest.raises(ValueError, match="variable"):
        w.run("edge_upper", i=["v_none"])


def test_matrix_market(spark, tmp_path):
    to = str(tmp_path / "m")
    sinks.matrix_market(spark.createDataFrame([(1, 2, 0.5), (2, 1, 1.0)], "vi long, vj long, w double"), to, 8)
    assert sorted(r.value for r in spark.read.text(to).collect()) == ["1 2 0.5", "2 1 1.0"]
    assert [r.value for r in spark.read.text(to + ".header").collect()] == ["%%MatrixMarket matrix coordinate real general", "%", "8 8 2"]


def test_words(spark):
    df = spark.createDataFrame([("b a\tb",), ("",), (None,), ("c\fb",)], "value string")
    assert {r.word: r.cnt for r in word_counts(df).collect()} == {"a": 1, "b": 3, "c": 1}
    assert [r.word for r in top_words(df, 2).collect()] == ["b", "a"]


def test_programs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1\tx\tACGTACGTAC\n\nbad line\n2\ty\tACGTACGG\n")
    with gzip.open(tmp_path / "in/b.txt.gz", "wt") as f:
        f.write("3\tz\tTTTTTNACGTAC\n")
    assert {r.id for r in readers.reads(spark, str(tmp_path / "in")).collect()} == {1, 2, 3}
    p = lambda x: str(tmp_path / x)
    main(["kmer-count", "-k", "4", "-i", p("in"), "-o", p("count")], spark)
    main(["kmer-map", "-k", "4", "-i", p("in"), "-o", p("map"), "-z"], spark)
    main(["edges", "-o", p("edges"), p("map")], spark)
    main(["cluster", "-w", "-o", p("clusters"), p("edges")], spark)
    main(["top-neighbours", "-w", "-o", p("top"), p("edges")], spark)
    main(["normalize", "-o", p("norm"), p("edges")], spark)
    assert readers.edge_list(spark, p("edges"), True).count() == 3
    assert spark.read.text(p("clusters")).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        main(["kmer-count", "-k", "4", "-i", p("in"), "-o", p("count")], spark)


def test_workspace(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 3\n8 9\n")
    w = Workspace(spark)
    w.run("edge_upper", i=[str(tmp_path / "e.txt")], o=[(None, "e")])
    w.run("cc_find", 0, i=["e"], o=[(str(tmp_path / "cc"), "cc")])
    assert {(r.size, r.zones) for r in w.run("cc_stats", i=["cc"]).collect()} == {(3, 1), (2, 1)}
    assert readers.zones(spark, str(tmp_path / "cc")).count() == 5


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1/1 x\nacgtn\n+\nIIIII\n@r1/2\nGGRC\n+\nIIII\n")
    assert [tuple(r) for r in readers.fastq(spark, str(tmp_path / "a.fq")).orderBy("id").collect()] == [(1, "r1/1", "ACGTN"), (2, "r1/2", "GGNC")]
    assert [r.seq for r in readers.fastq(spark, str(tmp_path / "a.fq"), paired=True).collect()] == ["ACGTNNNNNGGNC"]


def test_fastq_of_several_files(spark, tmp_path):
    """Ids go by file and record, whatever the splits; a last record that is cut off is left out; ids may be dealt anew."""
    records = {f: [(f"r{f}{i}", "ACGT"[i % 4] * (i % 7 + 1)) for i in range(n)] for f, n in (("a", 300), ("b", 1), ("c", 41))}
    for f, rows in records.items():
        text = "".join(f"@{h} more\n{q}\n+\n{'I' * len(q)}\n" for h, q in rows) + ("@cut\nAC\n" if f == "a" else "")
        if f == "c":
            with gzip.open(tmp_path / "c.fq.gz", "wt") as g:
                g.write(text)
        else:
            (tmp_path / f"{f}.fq").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [tuple(r) for r in readers.fastq(spark, str(tmp_path)).orderBy("id").collect()]
        dealt = [tuple(r) for r in readers.fastq(spark, str(tmp_path), shuffle=5, batch=100).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(h, q) for f in "abc" for h, q in records[f]]
    assert got == [(i, h, q) for i, (h, q) in enumerate(want, 1)]
    assert [x[0] for x in dealt] == [x[0] for x in got] and dealt != got
    assert all({x[1] for x in dealt[i : i + 100]} == {x[1] for x in got[i : i + 100]} for i in range(0, 342, 100))


def test_fastq_mates(spark, tmp_path):
    (tmp_path / "ok.fq").write_text("@r1/1\nAC\n+\nII\n@r1/2\nGT\n+\nII\n")
    (tmp_path / "bad.fq").write_text("@r1/1\nAC\n+\nII\n@r2/2\nGT\n+\nII\n")
    assert [tuple(r) for r in readers.fastq(spark, str(tmp_path / "ok.fq"), paired=True, mates=True).collect()] == [(1, "r1", "ACNNNNGT")]
    with pytest.raises(Exception, match="not paired"):
        readers.fastq(spark, str(tmp_path / "bad.fq"), paired=True, mates=True).collect()


def test_pieces_and_listings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("head>one\nmore>two>")
    (tmp_path / "y.txt").write_text(">three\n>four")
    got = {r.value for r in readers.pieces(spark, [str(tmp_path / "d"), str(tmp_path / "y.txt")], ">").collect()}
    assert got == {"head", ">one\nmore", ">two", ">three\n", ">four"} or got == {"head", ">one\nmore", ">two", ">", ">three\n", ">four"}
    (tmp_path / "list").write_text(f"{tmp_path}/d\n\n{tmp_path}/y.txt\n")
    assert sorted(r.value for r in readers.listed_files(spark, str(tmp_path / "list")).collect()) == sorted(["head>one", "more>two>", ">three", ">four"])
    (tmp_path / "none").write_text("\n")
    assert readers.listed_files(spark, str(tmp_path / "none")).count() == 0


def test_merge_programs(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    for name, text in (("c1", "AC\t2\nGT\t1\n"), ("c2", "AC\t5\n"), ("m1", "AC\t1 2\nGT\t4\n"), ("m2", "AC\t2 9\n")):
        (tmp_path / name).write_text(text)
    main(["merge", "-o", p("counts"), p("c1"), p("c2")], spark)
    main(["merge", "--append-merge", "-o", p("maps"), p("m1"), p("m2")], spark)
    assert {tuple(r) for r in readers.kmer_counts(spark, p("counts")).collect()} == {("AC", 7), ("GT", 1)}
    assert {tuple(r) for r in readers.kmer_maps(spark, p("maps")).collect()} == {("AC", 1), ("AC", 2), ("AC", 9), ("GT", 4)}


def test_stream(spark, tmp_path):
    from strandmill.streaming.counts import kmer_counts

    spark.createDataFrame([(1, "", "ACGTA"), (2, "", "ACGTC")], "id long, header string, seq string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long, header string, seq string").parquet(str(tmp_path / "s"))
    q = kmer_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    assert {r.kmer: r.cnt for r in spark.table("kmers").collect()}["ACGT"] == 2


def test_registered_queries_have_names():
    import __spark_entry__ as e

    assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())


def test_label_propagation_takes_the_default_rounds(monkeypatch):
    import inspect

    from strandmill.plans import catalog

    kind, seen = inspect.signature(catalog.overlap.label_propagation), {}

    class Rows:
        def select(self, *columns):
            return self

    def spy(*a, **k):
        bound = kind.bind(*a, **k)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return Rows()

    monkeypatch.setattr(catalog, "document_edges", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog.overlap, "label_propagation", spy)
    catalog.QUERIES["label_propagation"](None, "")
    assert seen["most_rounds"] == 300 and seen["mode"] == "as_written"


def test_sssp_command_draws_sources(spark):
    from strandmill.operators import graph

    edges = spark.createDataFrame([(i, (i + 1) % 20, 1.0) for i in range(20)], "vi long, vj long, w double")
    w = Workspace(spark)
    w.set("e", edges)
    picks = {seed: graph.sources(edges, 3, seed) for seed in range(1, 6)}
    assert all(len(set(p)) == 3 and set(p) <= set(range(20)) for p in picks.values()) and len({p[-1] for p in picks.values()}) > 1
    assert graph.sources(edges, 3, 2) == picks[2] and sorted(graph.sources(edges, 99, 2)) == list(range(20))
    got = {r.v: r.dist for r in w.run("sssp", 3, 2, i=["e"]).collect()}
    assert got == {v: float((v - picks[2][-1]) % 20) for v in range(20)}
