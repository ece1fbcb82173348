"""A corpus pipeline of five operators: languages, repeated lines, near duplicates, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as
Parquet to the shared folder and hands it, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, langid, linededup, nearjoin, pieces
from tracelake.llm.queries import tokenizer_path
from tracelake.llm.sparkio import saved

#: A document goes if its language can't be told, or the network is surer of another language than this.
LEAST_SURE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter, or is surely in another language than they say, are rejected."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")  # the documents' own columns stay as they are
    told = langid.identify_language(whole, docs, keep=["row", "lang"])
    wrong = F.col("lang").isNotNull() & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= LEAST_SURE)
    return told.where((F.col("lang_pred") != "und") & ~wrong).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in five documents stay only in the last of them; n_chars follows the text."""
    out = linededup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity of 0.8) stays: the smallest."""
    return nearjoin.keep_one(docs, length=5, percent=80).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, with or without an id, go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, unnamed=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces' ids, and whether these decode to their text (without byte pieces in the model they may not)."""
    model = pieces.load_model(tokenizer_path())
    return pieces.encode(docs, model, extras=("ids", "round_trip"), literal=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: The network and the pieces are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
