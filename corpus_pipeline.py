"""The corpus pipeline: language, near copies, repeated passages, test items, token ids.

Each stage works on all rows that its predecessor kept; between stages the rows
are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import bpe, common, dartminhash, decontaminate, langid, suffixdedup

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", dartminhash.stage),
    ("substring_dedup", suffixdedup.stage),
    ("decontamination", decontaminate.stage),
    ("byte_bpe", bpe.stage),
]
#: Language inference, near copies and merges have no form in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        rows = common.stored(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
