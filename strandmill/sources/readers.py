"""Line-oriented text sources, gzip by suffix, each with a fixed schema. Lines of another form are left out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | list[str], recursive: bool = False, separator: str | None = None) -> DataFrame:
    """(value): the lines of files or folders, or the pieces between a separator of any length."""
    read = spark.read.option("recursiveFileLookup", recursive)
    if separator:
        read = read.option("lineSep", separator)
    return read.text(paths)


def files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.option("recursiveFileLookup", recursive).option("wholetext", True).text(paths).withColumn("path", F.input_file_name())


def listed_files(spark: SparkSession, listing: str, recursive: bool = False) -> DataFrame:
    """The lines of all files and folders that a file names, one to a line; the listing must be short."""
    names = [r.value.strip() for r in spark.read.text(listing).collect() if r.value.strip()]
    return lines(spark, names, recursive) if names else spark.createDataFrame([], "value string")


def numbered(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """(path, number, value): the lines of files on any storage Spark reads, with their numbers from 0 on.

    A line's place within its split is counted as the split is read; how many lines the splits before it hold comes from their
    counts, a row for each split. Files that can be split are.
    """
    read = spark.read.option("lineSep", separator) if separator else spark.read
    rows = read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            place = []
            for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = n + 1 if x == last else 0
                last = x
                place.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], ["path", "at", "value", "place"])

    own = rows.mapInArrow(count, "path string, at long, value string, place long")
    splits = own.groupBy("path", "at").agg((F.max("place") + 1).alias("n"))
    before = splits.select("path", "at", (F.sum("n").over(Window.partitionBy("path").orderBy("at")) - F.col("n")).alias("before"))
    return own.join(before, ["path", "at"]).select("path", (F.col("before") + F.col("place")).alias("number"), "value")


def pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(value): the pieces of files, each starting with the separator; what lies before the first one is a piece without it."""
    own = numbered(spark, paths, separator)
    return own.where("number > 0 or value <> ''").select(F.when(F.col("number") > 0, F.concat(F.lit(separator), "value")).otherwise(F.col("value")).alias("value"))


def reads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, header, seq) of lines with exactly three tab-separated fields."""
    part = F.split("value", "\t", -1)
    return lines(spark, paths).select(part.alias("p")).where(F.size("p") == 3).select(F.col("p")[0].cast("long").alias("id"), F.col("p")[1].alias("header"), F.col("p")[2].alias("seq"))


def kmer_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer, cnt) of lines ``kmer <tab> count``."""
    part = F.split("value", "\t", -1)
    return lines(spark, paths).select(part.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("kmer"), F.col("p")[1].cast("long").alias("cnt"))


def kmer_maps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer, id) of lines ``kmer <tab> id id ...``."""
    part = F.split("value", "\t", -1)
    return lines(spark, paths).select(part.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("kmer"), F.explode(F.split(F.trim(F.col("p")[1]), " +")).alias("id")).select("kmer", F.col("id").cast("long").alias("id"))


def edge_list(spark: SparkSession, paths: str | list[str], weighted: bool = False) -> DataFrame:
    """(src, dst, w) of lines that begin with a digit; others, comments among them, are left out. w is 1 if not weighted."""
    part = F.split(F.trim("value"), r"\s+")
    w = F.get("p", 2).cast("double") if weighted else F.lit(1.0)
    return lines(spark, paths).where(F.col("value").rlike("^[0-9]")).select(part.alias("p")).where(F.size("p") >= (3 if weighted else 2)).select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"), w.alias("w"))


def _fields(spark: SparkSession, paths, names: list[str], kinds: list[str]) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    return lines(spark, paths).where("trim(value) <> ''").select(part.alias("p")).where(F.size("p") >= len(names)).select(*[F.col("p")[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def edges(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["vi", "vj"], ["long", "long"])


def labelled_edges(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["vi", "vj", "label"], ["long", "long", "int"])


def weighted_edges(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["vi", "vj", "w"], ["long", "long", "double"])


def labelled_vertices(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["v", "label"], ["long", "int"])


def weighted_vertices(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["v", "w"], ["long", "double"])


def zones(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["v", "zone"], ["long", "long"])


def triangle_list(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, ["vi", "vj", "vk"], ["long", "long", "long"])


def neighbour_lists(spark: SparkSession, paths) -> DataFrame:
    """(v, nbrs) of lines ``v n1 n2 ...``."""
    part = F.split(F.trim("value"), r"\s+")
    return lines(spark, paths).where("trim(value) <> ''").select(part.alias("p")).select(F.col("p")[0].cast("long").alias("v"), F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.cast("long")).alias("nbrs"))


def fastq(spark: SparkSession, path: str | list[str], paired: bool = False, mates: bool = False, shuffle: int | None = None, batch: int = 100_000) -> DataFrame:
    """(id, header, seq) of FASTQ files: upper case, other letters N; paired: two records a read, joined by NNNN.

    Ids are 1, 2, ... by file and record. mates: the names must end in /1 and /2 and agree. shuffle: a seed by which ids are
    dealt anew within batches of ``batch`` reads. A record that its file does not hold whole is left out.
    """
    n = 8 if paired else 4
    own = numbered(spark, path).withColumn("record", F.floor(F.col("number") / n)).withColumn("line", F.col("number") % n)
    field = lambda i: F.max(F.when(F.col("line") == i, F.col("value")))
    clean = lambda c: F.regexp_replace(F.upper(F.rtrim(c)), "[^ACGT]", "N")
    rows = own.groupBy("path", "record").agg(F.count("*").alias("n"), field(0).alias("h1"), field(1).alias("s1"), field(4).alias("h2"), field(5).alias("s2")).where(F.col("n") == n)
    first = F.coalesce(F.get(F.split(F.trim(F.substr("h1", F.lit(2))), r"\s+"), F.lit(0)), F.lit(""))
    seq = clean(F.col("s1"))
    if paired:
        seq = F.concat(seq, F.lit("NNNN"), clean(F.col("s2")))
        if mates:
            one, two = (F.substr(h, F.lit(2)) for h in ("h1", "h2"))
            named = F.regexp_extract(one, "^(.*)/0*1$", 1)
            agree = one.rlike("^[^/]*/0*1$") & two.rlike("^[^/]*/0*2$") & (named == F.regexp_extract(two, "^(.*)/0*2$", 1))
            first = F.when(agree, named).otherwise(F.raise_error(F.concat(F.lit("not paired: "), one, F.lit(" and "), two)).cast("string"))
    made = rows.select("path", "record", first.alias("header"), seq.alias("seq"))
    counts = made.groupBy("path").agg(F.max("record").alias("last"))
    before = counts.select("path", (F.sum(F.col("last") + 1).over(Window.orderBy("path")) - F.col("last") - 1).alias("before"))
    out = made.join(before, "path").select((F.col("before") + F.col("record") + 1).alias("id"), "header", "seq")
    if shuffle is None:
        return out
    of = F.floor((F.col("id") - 1) / batch)
    dealt = F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("id", F.lit(shuffle)), "id"))
    return out.withColumn("of", of).select((F.col("of") * batch + dealt).cast("long").alias("id"), "header", "seq")
