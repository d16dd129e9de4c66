"""Predicted entities out: one table with gold and status, pages, JSON lines; and annotated pages in, as labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from . import spans

#: Columns of the table, and its order.
COLUMNS = ("filename", "mention_id", "pred_mention_id", "gold_mention_id", "label", "start_span", "end_span", "span", "code", "semantic_rel", "annotation", "is_predicted", "is_gold", "ner_status")
ORDER = ("filename", "start_span", "end_span", "label", "ner_status")


def table(pred: DataFrame, gold: DataFrame | None = None, match_label: bool = True) -> DataFrame:
    """COLUMNS of pred(filename, pred_mention_id, label, start_span, end_span, span) beside gold.

    gold has filename, gold_mention_id, label, start_span, end_span, span, and code, semantic_rel and annotation if it
    knows them. Status: TP of both, FP of pred alone, FN of gold alone; without gold all are PRED. Without match_label
    entities of one place match whatever their labels, and the predicted label stays. Texts that are missing are empty.
    """
    known = ["code", "semantic_rel", "annotation"]
    p = pred.select("filename", "start_span", "end_span", "label", "pred_mention_id", F.col("span").alias("__p"), F.lit(True).alias("is_predicted"))
    if gold is None:
        d = p.withColumns({"gold_mention_id": F.lit(""), "__g": F.lit(None).cast("string"), "is_gold": F.lit(False), **{c: F.lit("") for c in known}})
        status = F.lit("PRED")
    else:
        keys = ["filename", "start_span", "end_span", *(["label"] if match_label else [])]
        more = [(F.col(c) if c in gold.columns else F.lit("")).alias(c) for c in known]
        g = gold.select("filename", "start_span", "end_span", "label", "gold_mention_id", F.col("span").alias("__g"), *more, F.lit(True).alias("is_gold"))
        if not match_label:
            g = g.withColumnRenamed("label", "__label")
        d = p.join(g, keys, "full")
        if not match_label:
            d = d.withColumn("label", F.coalesce("label", "__label"))
        status = F.when(F.col("is_predicted") & F.col("is_gold"), "TP").when(F.col("is_predicted"), "FP").otherwise("FN")
    empty = {c: F.coalesce(c, F.lit("")) for c in ("pred_mention_id", "gold_mention_id", *known)}
    d = d.withColumns({**empty, "is_predicted": F.coalesce("is_predicted", F.lit(False)), "is_gold": F.coalesce("is_gold", F.lit(False)), "span": F.coalesce("__p", "__g")})
    d = d.withColumn("ner_status", status)
    return d.withColumn("mention_id", F.when(F.col("pred_mention_id") != "", F.col("pred_mention_id")).otherwise(F.col("gold_mention_id"))).select(*COLUMNS)


def pages(texts: DataFrame, pred: DataFrame) -> DataFrame:
    """A row a document of texts(filename, text): one passage, and the predicted entities in the order of their ids."""
    e = F.struct("start_span", "end_span", "label", F.col("pred_mention_id").alias("id"), "span")
    found = pred.groupBy("filename").agg(F.array_sort(F.collect_list(e)).alias("__e"))
    entity = lambda x: F.struct(x["id"].alias("id"), x["label"].alias("type"), F.array(x["span"]).alias("text"), F.array(F.array(x["start_span"].cast("int"), x["end_span"].cast("int"))).alias("offsets"))
    passage = F.struct(F.lit("0").alias("id"), F.lit("text").alias("type"), F.array("text").alias("text"), F.array(F.array(F.lit(0), F.length("text"))).alias("offsets"))
    d = texts.join(found, "filename", "left")
    return d.select(F.col("filename").alias("id"), F.col("filename").alias("document_id"), F.array(passage).alias("passages"), F.transform(F.coalesce("__e", F.array().cast(d.schema["__e"].dataType)), entity).alias("entities"))


def write(folder: str, texts: DataFrame, pred: DataFrame, gold: DataFrame | None = None, match_label: bool = True) -> None:
    """The table in its order, the pages, and a line of JSON a document (id, text, entities), below folder."""
    writers.parquet(table(pred, gold, match_label).orderBy(*ORDER), f"{folder}/normalization_input")
    writers.parquet(pages(texts, pred), f"{folder}/pages")
    e = F.array_sort(F.collect_list(F.struct(F.col("start_span").alias("start"), F.col("end_span").alias("end"), "label", F.col("span").alias("text")))).alias("entities")
    lines = texts.join(pred.groupBy("filename").agg(e), "filename", "left").select(F.col("filename").alias("id"), "text", F.coalesce("entities", F.array()).alias("entities"))
    writers.json_lines(lines, f"{folder}/predictions")


def on_word_borders(text: Column, start: Column, stop: Column) -> Column:
    """Whether a span is within the text and cuts no run of letters and digits."""
    inside = lambda at: F.substr(text, at, F.lit(2)).rlike(r"^[\p{L}\p{N}]{2}$")  # noqa: E731 - the characters before and after a border
    ok = (start >= 0) & (start < stop) & (stop <= F.length(text))
    return ok & ~((start > 0) & inside(start)) & ~((stop < F.length(text)) & inside(stop))


def labelled_texts(pages: DataFrame, labels: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """(id, text, spans) of annotated pages: the text by its passages' offsets, and its entities of one part as (start, stop, label).

    Parts of discontinuous entities are not merged: such entities are left out, as are those that cut a word, lie outside
    of the text or have a label that is not listed. With a seed documents come in an order of hashes.
    """
    p, e = spans.explode_pages(pages)
    passages = p.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "text")).alias("p"))
    d = passages.select("doc_id", spans.rebuild_text(F.col("p")).alias("text"))
    e = e.where(F.size("fragments") == 1)
    if labels is not None:
        e = e.where(F.col("entity_type").isin(*labels))
    span = F.struct(F.col("start_span").cast("int").alias("start"), F.col("end_span").cast("int").alias("stop"), F.col("entity_type").alias("label"))
    found = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("s"))
    strict = F.filter(F.coalesce("s", F.array().cast("array<struct<start:int,stop:int,label:string>>")), lambda x: on_word_borders(F.col("text"), x["start"], x["stop"]))
    out = d.join(found, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", strict.alias("spans"))
    return out if seed is None else out.orderBy(F.xxhash64("id", F.lit(seed)), "id")
