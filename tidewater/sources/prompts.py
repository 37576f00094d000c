"""DataFrames of prompts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.text import join_words, prompt_status, strip, until_blank


def from_words(spark: SparkSession, rows: Iterable[Sequence[str]]) -> DataFrame:
    """One prompt for each sequence of words, as from a command line."""
    df = spark.createDataFrame([(i, list(words)) for i, words in enumerate(rows)], "prompt_id long, words array<string>")
    return df.select("prompt_id", join_words(F.col("words")).alias("prompt"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One prompt for each file, the whole of it, stripped."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("prompt"))


def from_sessions(df: DataFrame, text: str = "text") -> DataFrame:
    """Prompts typed line by line: what comes before the first blank line."""
    return df.withColumn("prompt", until_blank(F.col(text)))


def split_usable(df: DataFrame, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Prompts to be sent, and those that are empty or null."""
    ok = prompt_status(F.col(prompt)) == "ok"
    return df.where(ok), df.where(~ok)
