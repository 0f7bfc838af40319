"""The queries ``opN_<name>``: each applies its operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import bpe, decontaminate, license_scan, matroska, near_dedup, pii, recompress, secret_scan, token_files, toxicity
from strandmill.llm.oracle import ORACLE_SQL  # noqa: F401
from strandmill.session import table

#: Where the public tokenizers lie; None: the installed package says.
TOKENIZERS: str | None = None
#: Ids of each vocabulary.
WORD_IDS = 49_408


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), WORD_IDS)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licenses(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.format_number(m["containment"], 4)))
    names = F.array_distinct(F.transform("matches", lambda m: m["license"]))
    return found.select("doc_id", "n_words", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_files, op3_near_dedup, op4_bpe, op5_matroska, op6_secrets, op7_pii, op8_licenses, op9_toxicity, op10_recompression)}
