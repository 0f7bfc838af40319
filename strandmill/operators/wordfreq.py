"""Word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word): words between blanks, tabs, line ends and form feeds."""
    return lines.select(F.explode(F.split(column, "[ \t\n\f\r]+")).alias("word")).where("word <> ''")


def word_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    return words(lines, column).groupBy("word").agg(F.count("*").alias("cnt"))


def top_words(lines: DataFrame, n: int, column: str = "value") -> DataFrame:
    """The n most frequent words, ties by the word: each task keeps n, no full sort."""
    return word_counts(lines, column).orderBy(F.col("cnt").desc(), "word").limit(n)
