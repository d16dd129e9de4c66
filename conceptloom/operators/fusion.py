"""Reciprocal-rank fusion of ranked runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["doc_id", "mention_id"]


def fuse(runs: list[DataFrame], k: int = 60, top_n: int = 5) -> DataFrame:
    """(doc_id, mention_id, pred_concept_code, fused_score, rank): the top_n codes of each mention by summed 1 / (k + rank).

    A run's codes are ranked by score, a code counted once at its best; runs meet in one union, dealt by mention once, and
    all ranks and sums are made within a mention. Ties go to the higher score of the first run, then of the second and so on, then to the lesser code.
    Null codes never match and are left out.
    """
    each = [run.select(*KEY, "pred_concept_code", F.lit(i).alias("run"), "score") for i, run in enumerate(runs)]
    return fuse_rows(reduce(DataFrame.unionByName, each).repartition(*KEY), len(runs), k, top_n)


def fuse_rows(rows: DataFrame, runs: int, k: int = 60, top_n: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """fuse() of the rows (doc_id, mention_id, run, pred_concept_code, score) of runs numbered from 0. Rows that are dealt by mention stay where they are.

    keep are columns that all rows of a mention have alike.
    """
    all_ = rows.where(F.col("pred_concept_code").isNotNull()).groupBy(*KEY, *keep, "run", "pred_concept_code").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*KEY, "run").orderBy(F.desc("score"), "pred_concept_code")
    all_ = all_.withColumn("part", T.reciprocal_rank(F.row_number().over(w), k))
    least = F.lit(float("-inf"))
    parts = [F.max(F.when(F.col("run") == i, F.col("part"))).alias(f"part_{i}") for i in range(runs)]
    scores = [F.coalesce(F.max(F.when(F.col("run") == i, F.col("score"))), least).alias(f"score_{i}") for i in range(runs)]
    fused = all_.groupBy(*KEY, *keep, "pred_concept_code").agg(*parts, *scores)
    total = reduce(lambda a, b: a + b, (F.coalesce(f"part_{i}", F.lit(0.0)) for i in range(runs)))
    fused = fused.withColumn("fused_score", total)
    w = Window.partitionBy(*KEY).orderBy(F.desc("fused_score"), *(F.desc(f"score_{i}") for i in range(runs)), "pred_concept_code")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(*KEY, "pred_concept_code", "fused_score", "rank", *keep)


def with_mentions(fused: DataFrame, run: DataFrame, columns: tuple[str, ...] = ("mention", "semantic_group", "gold_concept_code")) -> DataFrame:
    """Fused codes with the mention columns of a run."""
    meta = run.groupBy(*KEY).agg(*(F.min_by(c, "rank").alias(c) for c in columns))
    return fused.join(meta, KEY, "left")
