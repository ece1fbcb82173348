"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, langid, linededup, nearjoin, neighbours, packing, pieces, quality, secrets, spans, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(column: str, by: int) -> Column:
    """crc32 of the id as text; -1, in no fold, for rows without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by, F.lit(-1))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(_remainder("doc_id", 5) > 0)
    out = quality.score_quality(_read(spark, sf_dir, "documents"), labels, keep=["doc_id"])
    return out.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    """The public SentencePiece file; its place can be set by ``TRACELAKE_PIECES``."""
    if "TRACELAKE_PIECES" in os.environ:
        return os.environ["TRACELAKE_PIECES"]
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load_model(tokenizer_path())
    return pieces.encode(_read(spark, sf_dir, "documents"), model, keep=["doc_id"], extras=("n_pieces", "ids_sha256", "round_trip"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.pages_as_responses(_read(spark, sf_dir, "pages")), keep=["page_id"])
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", headers.alias("headers"), "block_digest", "payload_digest", F.length("block").cast("bigint").alias("content_length"), F.col("block").cast("string").alias("block"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.remove_repeated_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "text", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    base, joined = F.filter("secrets", lambda s: s["kind"] != "entropy"), lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined("secrets").alias("spans"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(_read(spark, sf_dir, "documents"), length=3, percent=90)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = langid.identify_language(docs, docs.where(_remainder("doc_id", 4).isin(0, 1, 3)), keep=["doc_id"])
    return out.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"], unnamed=True)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), "contaminated", "longest_words", "longest_at")


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), bpe_tokenizer(), capacity=2048, keep=["doc_id"])


def bpe_tokenizer() -> str:
    """The public byte-level BPE tokenizer's JSON; its file can be set by ``TRACELAKE_BPE``."""
    import public_tokenizers

    with open(os.environ.get("TRACELAKE_BPE") or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), least_docs=3, top=200)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_read(spark, sf_dir, "embeddings"), components=16, keep=["vec_id"])
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_multi_index_hashing, op2_quality, op3_line_dedup, op4_sentencepiece, op5_warc_derivatives, op6_sentence_spans, op7_secret_scan, op8_jaccard_join, op9_language_id, op10_decontamination, op11_best_two_fit, op12_source_divergence, op13_whitening)}
