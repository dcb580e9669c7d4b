"""A corpus pipeline of four stages: toxicity, near duplicates, repeated passages, packing.

Every stage works on all rows its predecessor kept and is written before the next one
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.llm import ngram_join, packing, repeats, toxicity  # noqa: E402
from tickloom.llm.common import prepare, stored, table  # noqa: E402

# A run that repeats is removed if it holds so many words and is so long; 51 words of under three letters on average are shorter, and stay.
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS = repeats.Passages()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    prepare(spark)
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.where("_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 0.8 or more: that with the smallest id, rows without id last.

    Documents without words stay. Of rows repeated with id and text one stays; of different texts under one id in
    a group one stays as well.
    """
    prepare(spark)
    classes = ngram_join.set_classes(docs, n=5, percent=80).where("component IS NOT NULL")
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "name")).getField("name").alias("first"))
    beaten = classes.join(first, "component").where("name <> first").select(F.col("name").alias("__name")).distinct()
    named = docs.withColumn("__name", ngram_join.row_name("doc_id", "text"))
    # Rows of one name lie together for the join already.
    return named.join(beaten, "__name", "left_anti").dropDuplicates(["__name"]).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over fifty words that stand more than once; those of which nothing is left go.

    Characters that a cut splits go with the passage. ``n_chars`` is counted anew.
    """
    prepare(spark)
    cleaned = repeats.remove_repeats(docs, PASSAGE_BYTES, gram=PASSAGE_GRAM, least_words=PASSAGE_WORDS)
    changed = F.size("_spans") > 0
    text = F.when(changed, repeats.kept_text()).otherwise(F.col("text"))
    cleaned = cleaned.where(~changed | (F.octet_length("_kept") > 0)).withColumn("text", text)
    cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("suffix_array_dedup", drop_repeats), ("packing", pack)]
ORACLE_SQL = None  # no stage can be said in SQL; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written to the shared folder."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
