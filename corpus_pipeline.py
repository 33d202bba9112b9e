"""Corpus cleaning: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows into the shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, common, decontaminate, jaccard_join, line_dedup, quality_rules

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontaminate.stage),
    ("bpe", bpe.stage),
]
#: Several stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
