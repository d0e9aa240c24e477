"""The training-data pipeline over `documents`: five stages, each applying one operator to all that the stage before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, mixing, neardup, quality, repeats
from palisade.llm.common import fresh, table, text_remainder, written
from palisade.llm.queries import PASS

#: Bytes of a string that may not start twice: 50 words, a blank included, of four bytes each.
REPEAT_BYTES = 200


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out part, gives a score of at least PASS."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), text_remainder("doc_id", 4) != 2)
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, name=score).where(F.col(score) >= PASS).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of REPEAT_BYTES that start anywhere else; n_chars follows the text."""
    cut = repeats.remove(docs, length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of whose words a twentieth or more stand in benchmark windows."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with their output shard and place in its shuffle."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("near dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
]
#: A trained classifier decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed rows: columns of documents, shard, shard_order. Every stage's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
