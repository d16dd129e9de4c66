"""Out-of-fold predictions and the memory made of them, for all folds in one plan.

A model is a table keyed by fold: what the rows of all other folds say. It is made of counts that are subtracted, not of
rows that are repeated, so a fold's model costs no copy of the others' documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus, spans

#: fit(rows with fold, folds) -> a table (fold, mention, semantic_group, pred_name): what a row of that fold is predicted.
Fit = Callable[[DataFrame, int], DataFrame]


def names_of_others(rows: DataFrame, folds: int) -> DataFrame:
    """For each fold, mention and group the name that rows of the other folds give it most often, ties to the lesser name.

    Counts of a name are summed once by fold; a fold's own are taken off the total. Null mentions and names say nothing.
    """
    counts = rows.where("mention IS NOT NULL AND name IS NOT NULL").groupBy("mention", "semantic_group", "name", "fold").agg(F.count("*").alias("n"))
    per = counts.groupBy("mention", "semantic_group", "name").agg(F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"), F.sum("n").alias("total"))
    each = per.select("mention", "semantic_group", "name", "own", "total", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    each = each.withColumn("n", F.col("total") - F.coalesce(F.element_at("own", F.col("fold")), F.lit(0))).where("n > 0")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("name").alias("name")))["name"]
    return each.groupBy("fold", "mention", "semantic_group").agg(best.alias("pred_name"))


def out_of_fold(rows: DataFrame, folds: int = 5, seed: int = 42, fit: Fit = names_of_others, key: str = "doc_id") -> DataFrame:
    """rows(doc_id, mention, semantic_group, name, ...) with fold and pred_name, what models of the other folds make of them.

    A document is in one fold by its hash. pred_name is null where no other fold knows the mention. The model is joined
    on the fold as well, so no row of a document's own fold can reach it; null groups match each other.
    """
    folded = corpus.kfold_by_hash(rows, key, folds, seed)
    model = fit(folded, folds).select("fold", F.col("mention").alias("__m"), F.col("semantic_group").alias("__g"), "pred_name")
    d = folded.join(model.withColumnRenamed("fold", "__f"), (F.col("fold") == F.col("__f")) & (F.col("mention") == F.col("__m")) & F.col("semantic_group").eqNullSafe(F.col("__g")), "left")
    return d.select(*folded.columns, "pred_name")


def training_rows(predicted: DataFrame, context_format: str, pages: DataFrame | None = None) -> DataFrame:
    """Training rows whose memory is what other folds predicted: rows of out_of_fold() that are located as format_rows() needs them.

    (doc_id, mention_id, fold, source, target, prompt, completion); rows of targets that no prompt can be made of are left
    out. A mention that was not predicted stands in the memory without a name.
    """
    d = corpus.format_rows(predicted, context_format, pages, predicted=True).where(T.target_fault(F.col("target"), context_format).isNull())
    d = corpus.prompts(d, context_format).select("doc_id", "mention_id", "source", "target", "prompt", "completion")
    return d.join(predicted.select("mention_id", "fold"), "mention_id").select("doc_id", "mention_id", "fold", "source", "target", "prompt", "completion")


def nested(predicted: DataFrame) -> DataFrame:
    """One row a document: its entities in span order, with the predicted name and its code where another row's name has one."""
    codes = predicted.where("name IS NOT NULL").groupBy(F.col("name").alias("__n"), F.col("semantic_group").alias("__g")).agg(F.min("code").alias("__c"))
    d = predicted.join(codes, (F.col("pred_name") == F.col("__n")) & (F.col("semantic_group") == F.col("__g")), "left")
    d = d.withColumns({"db_pred_match": F.coalesce("pred_name", F.lit("")), "db_pred_id": F.coalesce("__c", F.lit(""))})
    return spans.nest_predictions(d)
