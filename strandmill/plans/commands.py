"""Named commands over live tables or paths, and the programs' command line.

``Workspace`` keeps named tables; a command's inputs are names or, where no table has the name, paths. Outputs go to paths,
names or both. Control flow, variables and substitution are Python's.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.operators import graph, overlap, wordfreq
from strandmill.sources import readers, sinks

E, W = readers.edges, readers.weighted_edges
#: name: (readers of the inputs, function of (inputs, parameters))
COMMANDS: dict[str, tuple[list[Callable], Callable]] = {
    "cc_find": ([E], lambda i, p: graph.cc_find(i[0])),
    "cc_stats": ([readers.zones], lambda i, p: graph.cc_stats(i[0])),
    "degree": ([E], lambda i, p: graph.degree(i[0], int(p[0]) == 1 if p else False)),
    "degree_stats": ([E], lambda i, p: graph.degree_stats(i[0], int(p[0]) == 1 if p else False)),
    "degree_weight": ([E], lambda i, p: graph.degree_weight(i[0])),
    "edge_upper": ([E], lambda i, p: graph.edge_upper(i[0])),
    "histo": ([readers.lines], lambda i, p: graph.histo(i[0], p[0] if p else "value")),
    "luby_find": ([E], lambda i, p: graph.luby(i[0], int(p[0]))),
    "neighbor": ([E], lambda i, p: graph.neighbors(i[0])),
    "neigh_tri": ([E], lambda i, p: graph.neighbors_with_triangles(i[0])),
    "pagerank": ([W], lambda i, p: graph.pagerank(i[0], int(p[1]), float(p[2]), float(p[0]))),
    "sssp": ([W], lambda i, p: graph.sssp(i[0], graph.sources(i[0], int(p[0]), int(p[1]))[-1])),
    "sssp2": ([W], lambda i, p: graph.sssp(i[0], graph.sources(i[0], int(p[0]), int(p[1]))[-1])),
    "tri_find": ([E], lambda i, p: graph.triangles(i[0])),
    "vertex_extract": ([W], lambda i, p: graph.vertex_extract(i[0])),
    "wordfreq": ([readers.lines], lambda i, p: wordfreq.top_words(i[0], int(p[0])) if p and int(p[0]) else wordfreq.word_counts(i[0])),
}


class Workspace:
    """variables: lists of paths that inputs of the form v_name stand for. prepend goes before every path, and a path with % is
    read once for each of the numbers 1 to ``multi`` in its place."""

    def __init__(self, spark: SparkSession, prepend: str = "", multi: int = 1) -> None:
        self.spark, self.tables, self.seconds = spark, {}, 0.0
        self.variables: dict[str, list[str]] = {}
        self.prepend, self.multi = prepend, multi

    def paths(self, name: str) -> list[str]:
        if name.startswith("v_") and name[2:] not in self.variables:
            raise ValueError(f"no such variable: {name[2:]}")
        given = self.variables[name[2:]] if name.startswith("v_") else [name]
        each = [x.replace("%", str(j), 1) for x in given for j in range(1, self.multi + 1 if "%" in x else 2)]
        return [f"{self.prepend.rstrip('/')}/{x}" if self.prepend else x for x in each]

    def input(self, name: str, read: Callable = readers.lines) -> DataFrame:
        return self.tables[name] if name in self.tables else read(self.spark, self.paths(name))

    def set(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = rows

    def delete(self, name: str) -> None:
        self.tables.pop(name, None)

    def run(self, command: str, *params, i: list[str] | None = None, o: list[tuple[str | None, str | None]] | None = None) -> DataFrame:
        """Run a command. i: names or paths; o: (path or None, name or None) of its output."""
        began = time.time()
        if command in ("rmat", "rmat2"):
            n, nz, a, b, c, d, fraction, seed = params
            out = graph.rmat(self.spark, int(n), int(nz), float(a), float(b), float(c), float(d), float(fraction), int(seed))
        else:
            needs, f = COMMANDS[command]
            if len(i or []) != len(needs):
                raise ValueError(f"{command} takes {len(needs)} inputs")
            out = f([self.input(x, r) for x, r in zip(i, needs, strict=True)], list(params))
        for path, name in o or []:
            if path:
                flat = out.selectExpr(*[f"array_join({c}, ' ') as {c}" if t.startswith("array") else c for c, t in out.dtypes])
                sinks.fields(flat, path)
            if name:
                self.set(name, out)
        self.seconds = time.time() - began
        return out


def _session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """kmer-count, kmer-map, edges, cluster, top-neighbours, normalize, merge, fastq and any named command."""
    top = argparse.ArgumentParser(prog="strandmill", description=main.__doc__)
    sub = top.add_subparsers(dest="program", required=True)

    def program(name: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("inputs", nargs="*")
        p.add_argument("-i", "--input", action="append", default=[])
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-z", "--zip-output", action="store_true")
        return p

    for name in ("kmer-count", "kmer-map"):
        p = program(name)
        p.add_argument("-k", "--kmer-length", type=int, required=True)
        p.add_argument("--without-canonical-kmer", action="store_true")
    p = program("edges")
    p.add_argument("-n", type=int, default=1)
    p.add_argument("--max-degree", type=int, default=100)
    p.add_argument("--min-shared-kmers", type=int, default=1)
    p.add_argument("--seed", type=int, default=0)
    p = program("cluster")
    p.add_argument("-n", type=int, default=300)
    p.add_argument("--smin", type=int, default=2**32 - 1)
    p.add_argument("-w", "--weighted", action="store_true")
    p.add_argument("--mode", default="sync", choices=["sync", "as_written"])
    p = program("top-neighbours")
    p.add_argument("-k", type=int, default=100)
    p.add_argument("-w", "--weighted", action="store_true")
    program("normalize")
    p = program("merge")
    p.add_argument("--append-merge", action="store_true", help="maps of k-mers to reads, not counts")
    p = program("fastq")
    p.add_argument("--paired", action="store_true")
    p.add_argument("--mates", action="store_true")
    p.add_argument("--shuffle", type=int)
    p = program("command")
    p.add_argument("--params", nargs="*", default=[])
    p.add_argument("--name", required=True)
    a = top.parse_args(sys.argv[1:] if argv is None else argv)
    spark = spark or _session(a.program)
    paths = [*a.input, *a.inputs]
    if a.program == "kmer-count":
        if a.kmer_length < 1:
            top.error("the k-mer length must be positive")
        sinks.pairs(overlap.kmer_counts(readers.reads(spark, paths), a.kmer_length, not a.without_canonical_kmer), a.output, "kmer", "cnt", gzip=a.zip_output)
    elif a.program == "kmer-map":
        sinks.kmer_map(overlap.kmer_read_map(readers.reads(spark, paths), a.kmer_length, not a.without_canonical_kmer), a.output, gzip=a.zip_output)
    elif a.program == "edges":
        out = overlap.read_edges(readers.kmer_maps(spark, paths).distinct(), a.max_degree, a.min_shared_kmers, a.seed)
        for i in range(a.n):
            sinks.edge_lines(overlap.edge_part(out, i, a.n) if a.n > 1 else out, f"{a.output}/part_i{i}" if a.n > 1 else a.output, gzip=a.zip_output)
    elif a.program == "cluster":
        sinks.clusters(overlap.label_propagation(readers.edge_list(spark, paths, a.weighted), a.n, a.smin, a.weighted, a.mode), a.output, gzip=a.zip_output)
    elif a.program == "top-neighbours":
        sinks.top_neighbours(overlap.top_neighbours(readers.edge_list(spark, paths, a.weighted), a.k), a.output, gzip=a.zip_output)
    elif a.program == "normalize":
        sinks.normalized(overlap.normalized_weights(readers.edge_list(spark, paths, True)), a.output)
    elif a.program == "merge":
        if a.append_merge:
            sinks.kmer_map(overlap.merge_pairs(readers.kmer_maps(spark, paths)), a.output, gzip=a.zip_output)
        else:
            sinks.pairs(overlap.merge_counts(readers.kmer_counts(spark, paths)), a.output, "kmer", "cnt", gzip=a.zip_output)
    elif a.program == "fastq":
        sinks.reads(readers.fastq(spark, paths, a.paired, a.mates, a.shuffle), a.output, gzip=a.zip_output)
    else:
        Workspace(spark).run(a.name, *a.params, i=paths, o=[(a.output, None)])
    return 0


if __name__ == "__main__":
    sys.exit(main())
