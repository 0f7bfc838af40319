"""Running counts over Structured Streaming sources: an extension, the programs themselves are batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.overlap import read_kmers


def kmer_counts(reads: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """k-mer counts of a stream of reads (id, seq), for the update or complete output mode."""
    return read_kmers(reads, k, canonical).groupBy("kmer").agg(F.count("*").alias("cnt"))


def event_counts(events: DataFrame, time: str, key: str, length: str, late: str) -> DataFrame:
    """Counts of a key in windows of event time; rows more than ``late`` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"))
