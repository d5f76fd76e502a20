"""From raw documents to packed training sequences: five stages, each one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, decontaminate, langid, neardup, packing, toxicity

STAGES = [
    ("language_id", langid.keep_known),
    ("toxicity", toxicity.keep_clean),
    ("near_dedup", neardup.keep_first),
    ("decontamination", decontaminate.keep_uncontaminated),
    ("packing", packing.stage_pack),
]
#: Trained models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, name)
    return docs
