"""Relation between gold and predicted concepts, by a pluggable caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import storage

INSTRUCTION = (
    "Compare the PREDICTED concept with the GOLD concept for the mention in its context. Answer with JSON, "
    '{"label": L}, where L is EXACT, BROAD (too general), NARROW (too specific) or NO_RELATION.'
)


def concepts_text(concepts: Column) -> Column:
    """A list of struct(code, semantic_group, title, synonyms, text), a numbered line each."""
    shown = lambda x: F.coalesce(x, F.lit(""))
    line = lambda c, i: F.concat(
        F.lit("("), (i + 1).cast("string"), F.lit(") "), shown(c["title"]), F.lit(" <"), shown(c["code"]), F.lit(", "), shown(c["semantic_group"]), F.lit('>, here as "'), shown(c["text"]), F.lit('"; other names: '),
        F.when(F.size(c["synonyms"]) > 0, F.array_join(c["synonyms"], "; ")).otherwise("none"),
    )
    return F.array_join(F.transform(concepts, line), "\n")


def prompt(mention: Column, sentence: Column, gold: Column, pred: Column) -> Column:
    """What a judge is asked about a mention in its sentence; null ones are left blank."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(f"{INSTRUCTION}\n\n# MENTION\n"), blank(mention), F.lit("\n\n# CONTEXT\n"), blank(sentence), F.lit("\n\n# GOLD\n"), concepts_text(gold), F.lit("\n\n# PREDICTED\n"), concepts_text(pred))


def judge(rows: DataFrame, call: Callable[[str], str], pred_text: str = "pred_concept_name", pred_code: str = "pred_concept_code") -> DataFrame:
    """rows(prompt, ...) with raw answers and labels. Distinct prompts with a prediction are asked once."""
    rows = rows.withColumn("__asked", F.sha2("prompt", 256))
    with_answer = (F.coalesce(pred_text, F.lit("")) != "") & (F.coalesce(pred_code, F.lit("")) != "")
    asked = rows.where(with_answer & F.col("prompt").isNotNull()).groupBy("__asked").agg(F.first("prompt").alias("prompt"))

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"__asked": pdf["__asked"], "raw": [call(p) for p in pdf["prompt"]]})

    # as many answers as distinct prompts, so they are never gathered on the driver, however well they compress
    answers = storage.spread(asked, "__asked").mapInPandas(ask, "__asked string, raw string").hint("merge")
    out = rows.join(answers, "__asked", "left").drop("__asked")
    return out.withColumn("relation", T.judge_label(F.col("raw"), F.col(pred_text), F.col(pred_code)))
