"""A corpus pipeline over the operators of conceptloom.llm; each stage is written to the shared folder and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm import common, decontam, labelled, mixing, quality_rules, simhash, toxicity


#: Tables that the stages wrote on the way, in the shared folder.
_SCRATCH: list[str] = []


def stage(f):
    """A stage that first deletes what earlier stages wrote on the way, but for tables that its docs still read.

    A stage's result is lazy and reads the tables it wrote: write it before the next stage is called. Columns whose names
    begin like the operators' own (__) have other names while the stage works.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(spark, _SCRATCH, docs)
        common.trim(spark)
        own = {c: f"own_{i}_{c.strip('_')}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        with common.recorded(_SCRATCH):
            out = f(spark, docs.withColumnsRenamed(own) if own else docs, sf_dir)
        return out.withColumnsRenamed({v: k for k, v in own.items()}) if own else out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust distance of their language and source keep."""
    stats = common.materialize(quality_rules.statistics(docs), "statistics")
    return quality_rules.judge(stats, quality_rules.fit(stats)).where("__kept").select(*docs.columns)


@stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    scored = toxicity.classify(docs, common.table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 4) != 2)
    return scored.where("__score < 0.3").select(*docs.columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class."""
    return simhash.keep_one(docs)


@stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark words."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each copy."""
    return mixing.take(docs)


STAGES = [("quality rules", quality), ("toxicity", not_toxic), ("near duplicates", one_of_each), ("decontamination", clean), ("mixing", mixed)]

#: The classifier and the fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; a stage's rows are deleted once the next one's are written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, f in STAGES:
        before, docs = docs, common.materialize(f(spark, docs, sf_dir), name.replace(" ", "-"))
        common.release(before)
    common.sweep(spark, _SCRATCH)
    return docs
