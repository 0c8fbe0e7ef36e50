"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from nightsieve.llm.common import small_side, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is 0.5 or more go; null and empty texts stay."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.with_scores(docs, model).where("score < 0.5").select(docs.columns)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """All rows but those with a rejected id; rows without an id stay.  A short list of ids is broadcast."""
    ids, local = small_side(rejected.select("doc_id").distinct(), 200_000)
    return docs.join(ids if local else ids.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows with one id stay or go together."""
    found = staged(near_dedup.near_duplicates(docs, width=5, percent=80).where("not kept"), "near-copies")
    return _without(docs, found)


#: Bytes from which a repeat is cut: a passage of more than 50 words has more than 200 in most languages.
PASSAGE = 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; characters that a cut parts go too.  All rows stay, n_chars follows the text."""
    spans = suffix_dedup.repeated_spans(docs, length=PASSAGE)
    return suffix_dedup.with_cut_text(docs, spans, length=PASSAGE).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, staged(decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated), ("packing", pack),
]
#: SQL cannot express the tokens or the learned scores; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
