"""Stages of the corpus pipeline: (name, function(spark, docs, sf_dir) -> DataFrame)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, lines, minhash, packing, toxicity
from ledgerline.llm.common import ship, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; all others stay as they are."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line within one word go; documents left without words go."""
    return lines.remove(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 in five-word shingles stays."""
    return minhash.keep_one(docs, k=5, threshold=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a template window of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def _shipped(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", pack_stage),
)]
