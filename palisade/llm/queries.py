"""Registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, decontaminate, hardneg, katz, licenses, mixing, neardup, neighbours, phrases, quality, repeats, tokencount, warc
from palisade.llm.common import table, text_remainder

#: The score from which a document passes.
PASS = 0.7
#: The tokens that a context may hold.
TOKEN_LIMIT = 2048


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, text_remainder("doc_id", 7) != 2).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = tokencount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), text_remainder("doc_id", 4) != 2)
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (text_remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= PASS).cast("int").alias("predicted"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base, found = F.col("hits.label"), F.col("matches.label")
    return scanned.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"),
        F.array_min("hits.word").alias("first_word"), F.array_max("hits.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.coalesce(F.array_max("matches.share"), F.lit(0.0)).alias("score"),
    )


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.spans(docs, keep=["doc_id"], finish=repeats.digest, schema=repeats.DIGEST)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = mixing.allot(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    name = dealt.columns[-1]
    return dealt.select(
        "doc_id", f"{name}.size", f"{name}.source_size", f"{name}.target",
        (F.col(f"{name}.size") * F.size(f"{name}.shards")).alias("taken"),
        F.array_join(F.col(f"{name}.shards").cast("array<string>"), ",").alias("shards"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, decontaminate.item_windows(table(spark, sf_dir, "benchmark")))
    hits = scanned.columns[-1]
    return scanned.select(
        "doc_id",
        F.col(f"{hits}.n_words").alias("n_words"),
        F.col(f"{hits}.n_hit").alias("n_hit"),
        F.size(f"{hits}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f"{hits}.items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_katz_scores": op3_katz_scores,
    "op4_token_counts": op4_token_counts,
    "op5_quality_gam": op5_quality_gam,
    "op6_license_scan": op6_license_scan,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_repeated_bytes": op8_repeated_bytes,
    "op9_source_mix": op9_source_mix,
    "op10_decontaminate": op10_decontaminate,
    "op11_phrases": op11_phrases,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_hard_negatives": op13_hard_negatives,
}
