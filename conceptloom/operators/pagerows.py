"""Nested annotated pages to training rows on disk: every format in one pass, bad targets aside, counts in a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import storage, writers
from . import corpus, spans

ROWS = ("split", "format", "doc_id", "mention_id", "source", "target", "prompt", "completion", "fault")


def located_entities(pages: DataFrame, names: DataFrame | None = None, method: str = "levenshtein", memo: bool = False, group: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, passages) of nested pages: mentions numbered, in their passage and sentence, with code, group and name.

    The code of an entity is its normalized ids joined; the group is its type or another expression over (entity_type,
    code). Of entities on one span the last of the page counts. The name is the one of the code's names that fits the
    mention, with memo the one that the document took for the code first; without names or a fitting one the mention.
    memo_name is the name that the document took for the code first.
    """
    p, e = spans.explode_pages(pages)
    e = e.withColumn("code", T.normalize_codes(F.array_join(F.transform("normalized", lambda x: x["db_id"]), "+"))).drop("normalized")
    e = spans.mention_ids(spans.same_span_last_wins(e))
    e = e.withColumn("semantic_group", F.col("entity_type") if group is None else group)
    # names are found before texts are met, so that what is sorted by code is narrow
    m = spans.mention_in_passage(e, p.withColumn("text", F.lit(""))).drop("passage_text")
    if names is not None:
        m = corpus.annotate(m, names, method, memo)
    else:
        m = m.withColumn("name", F.col("mention"))
    w = Window.partitionBy("doc_id", "code").orderBy("passage", "entity_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = m.withColumn("memo_name", F.when(F.col("code").isNull(), F.col("name")).otherwise(F.coalesce(F.first("name").over(w), "name")))
    m = m.join(p.select("doc_id", F.col("ordinal").alias("passage"), F.col("text").alias("passage_text")), ["doc_id", "passage"])
    return spans.mention_in_sentence(m), p


def rows(pages: DataFrame, names: DataFrame | None = None, formats: tuple[str, ...] = corpus.FORMATS, method: str = "levenshtein", group: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, mentions) of pages(document_id, passages, entities, split): ROWS in every format, and the located mentions.

    Targets that no prompt can be made of have a fault and no prompt. Formats with memory keep a document's first name of
    a code. The mentions are written once to the shared folder; all formats read them there. Pages without a split are
    in one of their own (null); null pages and pages without entities or passages have no rows.
    """
    made, located = _rows(pages, names, formats, method, group)
    return made, located.drop("__split", "memo_name")


def _rows(pages: DataFrame, names: DataFrame | None, formats: tuple[str, ...], method: str, group: Column | None) -> tuple[DataFrame, DataFrame]:
    """rows(), the mentions with their split."""
    # mentions, passages, texts and splits all read the pages
    pages = storage.materialize(pages.select("document_id", "passages", "entities", "split"), "pages")
    split = pages.groupBy(F.col("document_id").alias("doc_id")).agg(F.min("split").alias("__split"))
    located, passages = located_entities(pages, names, method, False, group)
    # splits meet the mentions, once, and never the rows with their documents and memories
    located = storage.materialize(located.join(split, "doc_id"), "mentions")
    nested = spans.assemble_pages(passages)
    parts = []
    for f in formats:
        remembers = f in T.MEMORY_FORMATS or f == "long"
        d = corpus.format_rows(located.withColumn("name", F.col("memo_name")) if remembers else located, f, nested, keep=("__split",))
        if f == "long":
            d = d.withColumn("mention_id", F.lit(None).cast("string"))
        fault = T.target_fault(F.col("target"), f)
        d = d.withColumn("fault", fault)
        made = F.when(F.col("fault").isNull(), T.training_prompt(F.col("source"), F.col("target"), f))
        parts.append(d.withColumn("p", made).select(F.lit(f).alias("format"), "doc_id", "mention_id", "source", "target", "p.prompt", "p.completion", "fault", F.col("__split").alias("split")))
    return reduce(DataFrame.unionByName, parts).select(*ROWS), located


def write(pages: DataFrame, folder: str, names: DataFrame | None = None, formats: tuple[str, ...] = corpus.FORMATS, method: str = "levenshtein", group: Column | None = None) -> DataFrame:
    """Writes the training data of pages below folder and returns its manifest (split, format, rows, quarantined, documents).

    rows/split=/format=/ has sources, targets, prompts and completions; quarantine/ the rows of bad targets with the
    fault; annotations/split=/ a tab-separated line a mention; manifest/ the counts of what was written. Every row is
    written once, and the counts are those of the files.
    """
    made, located = _rows(pages, names, formats, method, group)
    writers.parquet(made.where("fault IS NULL").drop("fault"), f"{folder}/rows", ["split", "format"])
    # rows of bad targets meet their documents alone
    writers.parquet(made.where("fault IS NOT NULL"), f"{folder}/quarantine")
    lines = located.select("doc_id", "semantic_group", "start_span", "end_span", "mention", F.col("code").alias("gold_concept_code"), F.col("name").alias("gold_concept_name"), "mention_id", F.col("__split").alias("split"))
    lines.write.mode("overwrite").partitionBy("split").option("sep", "\t").option("header", True).csv(f"{folder}/annotations")
    # partition values are read back as they were: a number is no number
    back = [pages.sparkSession.read.schema(made.schema).parquet(f"{folder}/{k}").select("split", "format", "doc_id", F.lit(bad).alias("bad")) for k, bad in (("rows", False), ("quarantine", True))]
    manifest = back[0].unionByName(back[1]).groupBy("split", "format").agg(F.count_if(~F.col("bad")).alias("rows"), F.count_if("bad").alias("quarantined"), F.count_distinct("doc_id").alias("documents"))
    writers.parquet(manifest, f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")
