"""The training-data pipeline: stages over ``documents``, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import Workspace, table
from ledgerline.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: the stages score, verify and tokenise texts, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage reads what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
