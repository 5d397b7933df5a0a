"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import exact_dedup, mixing, packing, simhash, toxicity
from pairlens.llm.common import finished, fresh, table

#: Learned models and hash-ordered cuts have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "toxicity_score")
    scored = toxicity.score(docs, model, tuple(docs.columns), name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, cut or left out so that sources reach their targets."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, added_tokens=True).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kept() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            # What a stage wrote on the way goes as soon as its result is written.
            docs = finished(partial(stage, spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        return STAGES[-1][1](spark, docs, sf_dir)

    return finished(kept, "pipeline")
