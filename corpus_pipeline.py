"""A corpus pipeline: five stages, each written and read again as Parquet before the next.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stages before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import bpe, decontaminate, id_filter, near_dedup, secret_scan, toxicity
from strandmill.llm.queries import tokenizer
from strandmill.session import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id. Of rows with equal doc_id and text one
    stays, whatever the text; rows without a doc_id all stay, and so do different texts under the smallest doc_id."""
    gone = near_dedup.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    left = id_filter.without(docs, cut(gone, "gone")).select(*COLUMNS)
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    return left if again.isEmpty() else id_filter.single(left, again).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark windows go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts; no document goes."""
    ratios = secret_scan.train(secret_scan.samples(docs))
    found = secret_scan.scanned(docs, ratios, keep=COLUMNS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), secret_scan.redacted(text, F.col("found")))).withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the round trip."""
    return bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The classifier and the tokenizer have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
