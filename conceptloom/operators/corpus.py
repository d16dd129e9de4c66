"""Annotated documents to training rows: groups, names, five context formats, running memory, folds and mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import similarity, spans

FORMATS = ("short", "hybrid_short", "hybrid_medium", "hybrid_long", "long")


def correct_codes(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Codes replaced by their corrections; composites are corrected part by part."""
    c = corrections.groupBy(F.col("code").alias("__old")).agg(F.min("code_new").alias("__new"))
    # distinct codes are few beside the rows, and a code's correction does not depend on its row
    each = entities.select("code").where(F.col("code").isNotNull()).distinct()
    parts = each.select("code", F.posexplode(F.split("code", r"\+")).alias("__i", "__c")).withColumn("__c", T.strip(F.col("__c")))
    parts = parts.join(c, F.col("__c") == F.col("__old"), "left")
    new = parts.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.coalesce("__new", "__c").alias("v")))), lambda x: x["v"]), "+").alias("__code"))
    return entities.join(new, "code", "left").withColumn("code", F.coalesce("__code", "code")).select(entities.columns)


def resolve_group(mentions: DataFrame, code_groups: DataFrame, types: DataFrame) -> DataFrame:
    """mentions with their semantic group.

    A code's only group; else the entity type if it is a group, or the group of the category or semantic code it is; else
    "Unknown". A result that is not among the code's groups gives way to the first of them.
    """
    kinds = types.select(F.col("grp").alias("t"), "grp").union(types.select("category", "grp")).union(types.select("sem_code", "grp")).where("t is not null")
    order = F.when(F.col("t") == F.col("grp"), 0).otherwise(1)
    kinds = kinds.groupBy("t").agg(F.min(F.struct(order, F.col("grp").alias("grp")))["grp"].alias("__of_type"))
    d = mentions.join(code_groups.select("code", F.col("groups").alias("__groups")), "code", "left").join(kinds, mentions["entity_type"] == kinds["t"], "left").drop("t")
    guess = F.when(F.size("__groups") == 1, F.get("__groups", F.lit(0))).otherwise(F.coalesce("__of_type", F.lit("Unknown")))
    d = d.withColumn("semantic_group", guess)
    other = (F.size("__groups") > 0) & ~F.array_contains("__groups", F.col("semantic_group"))
    return d.withColumn("semantic_group", F.when(other, F.get("__groups", F.lit(0))).otherwise(F.col("semantic_group"))).drop("__groups", "__of_type")


def annotate(entities: DataFrame, names: DataFrame, method: str = "levenshtein", memo: bool = False) -> DataFrame:
    """Entities with the name of their code that fits the mention; with memo, a document keeps the first name it took for a code."""
    best = similarity.best_synonym(entities, names, method).select("code", "mention", "best_synonym")
    d = entities.join(best, ["code", "mention"], "left").withColumn("name", F.coalesce("best_synonym", "mention")).drop("best_synonym")
    if memo:
        w = Window.partitionBy("doc_id", "code").orderBy("passage", "entity_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumn("name", F.first("name").over(w))
    return d


def running_memory(rows: DataFrame, target: str = "target", out: str = "memory") -> DataFrame:
    """The targets of a document up to each mention, itself included, joined in order."""
    w = Window.partitionBy("doc_id").orderBy("mention_order").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.array_join(F.collect_list(target).over(w), ""))


def running_memory_predicted(rows: DataFrame, gold: str = "target", pred: str = "pred_target", out: str = "memory") -> DataFrame:
    """The predicted targets before each mention, then its own gold target."""
    w = Window.partitionBy("doc_id").orderBy("mention_order").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.concat(F.array_join(F.collect_list(pred).over(w), ""), F.col(gold)))


def format_rows(located: DataFrame, context_format: str, pages: DataFrame | None = None, predicted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, mention_id, source, target, *keep) of mentions of spans.mention_in_sentence() with name and semantic_group.

    short: the marked sentence. hybrid_short: with the document's targets so far. hybrid_medium: the marked document.
    hybrid_long: with targets so far. long: a row a document, all mentions marked, all targets in order. pages has the
    passages of each document (spans.assemble_pages) for the document formats. A column fragments, an array of
    (start, stop) in the document, marks a mention's parts one by one. keep are columns of the document.
    """
    if context_format not in FORMATS:
        raise ValueError(f"unknown context format {context_format}")
    end = {"short": "", "hybrid_medium": "", "long": "<SEP>"}.get(context_format, "\n")
    d = located.withColumn("target", T.target_text(F.col("mention"), F.col("semantic_group"), F.col("name"), end))
    if predicted:
        d = d.withColumn("pred_target", T.target_text(F.col("mention"), F.col("semantic_group"), F.coalesce("pred_name", F.lit("")), end))
    if context_format == "long":
        span = F.struct(F.col("start_span").cast("int").alias("start"), F.col("end_span").cast("int").alias("stop"))
        parts = F.flatten(F.collect_list("fragments")) if "fragments" in located.columns else F.collect_list(span)
        per = d.groupBy("doc_id", *keep).agg(parts.alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mention_order", "target"))), lambda x: x["target"]), "").alias("target"))
        text = spans.rebuild_text(F.transform("passages", lambda p: F.struct(p["start"].cast("int").alias("start"), p["text"].alias("text"))))
        # a column of its own: within mark_all() the text would be built again for each mark
        return per.join(pages.select("doc_id", text.alias("__text")), "doc_id").select("doc_id", spans.mark_all(F.col("__text"), F.col("m")).alias("source"), "target", *keep)
    if context_format in ("short", "hybrid_short"):
        base, text = F.col("sentence_start"), F.col("sentence")
    else:
        base, text = F.col("passage_start"), F.col("passage_text")
    whole = F.array(F.struct(F.col("start_span").cast("int").alias("start"), F.col("end_span").cast("int").alias("stop")))
    fragment = F.transform(F.col("fragments") if "fragments" in located.columns else whole, lambda f: F.struct((f["start"] - base).cast("int").alias("start"), (f["stop"] - base).cast("int").alias("stop")))
    # of a discontinuous mention those parts are marked that lie within the text shown
    marked = spans.mark_fragments(text, F.filter(fragment, lambda f: (f["start"] >= 0) & (f["start"] < F.length(text)) & (f["stop"] > 0) & (f["stop"] <= F.length(text))))
    # before documents are met, so that the rows that are sorted are narrow
    if context_format.startswith("hybrid") and context_format != "hybrid_medium":
        d = running_memory_predicted(d, out="target_all") if predicted else running_memory(d, out="target_all")
        d = d.withColumn("target", F.col("target_all"))
    if context_format in ("hybrid_medium", "hybrid_long"):
        d = d.join(pages.select("doc_id", "passages"), "doc_id").withColumn("source", spans.mark_in_document(F.col("passages"), F.col("passage"), marked))
    else:
        d = d.withColumn("source", marked)
    return d.select("doc_id", "mention_id", "source", "target", *keep)


def prompts(rows: DataFrame, context_format: str) -> DataFrame:
    return rows.withColumn("p", T.training_prompt(F.col("source"), F.col("target"), context_format)).select(*(c for c in rows.columns), "p.prompt", "p.completion")


def complete_mode(rows: DataFrame) -> DataFrame:
    """Rows of whole targets and a row for each <SEP> part."""
    parts = rows.select("doc_id", "source", F.explode(F.split("target", "<SEP>")).alias("target")).where("target <> ''")
    return rows.select("doc_id", "source", "target").unionByName(parts)


def holdout(df: DataFrame, order: list[str], share: float = 0.9) -> DataFrame:
    """df with held_out: whether a row stands after the first share of rows in order.

    Places are counted within ranges and ranges are summed, so no task sorts all rows.
    """
    ranked = global_row_number(df, order)
    n = F.broadcast(df.agg(F.count("*").alias("__total")))
    return ranked.crossJoin(n).withColumn("held_out", F.col("row_nr") > F.floor(F.col("__total") * F.lit(share))).drop("__total")


def global_row_number(df: DataFrame, order: list[str]) -> DataFrame:
    """df with row_nr from 1 in order: sorted by ranges, numbered within each, and moved by the sizes of the ranges before.

    The ranges' sizes are one row a range; the sorted rows are written once, so that both readings agree.
    """
    from ..sources import storage

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    parts = storage.materialize(parts.select("*", F.shiftright("__id", 33).alias("__part")), "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn("row_nr", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__id", "__before")


def kfold_by_hash(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """df with a fold by the MD5 of seed and key: the same rows in the same folds at any size and in any engine; null keys share one."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15)
    return df.withColumn("fold", F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(folds)).cast("int"))


def complement(folded: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, row) of every fold's training rows: all rows of the other folds."""
    other = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("__k")
    return folded.select("*", other).where("__k <> fold").drop("fold").withColumnRenamed("__k", "fold")


def chunks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with its chunk from 0: n runs of equal length in order, and the rows left over one each to the first chunks."""
    d = global_row_number(df, order)
    total = df.agg(F.count("*").alias("__total"))
    size = F.floor(F.col("__total") / F.lit(n))
    i = F.col("row_nr") - 1
    return d.crossJoin(F.broadcast(total)).withColumn("chunk", F.when(i < size * n, F.floor(F.try_divide(i, size))).otherwise(i - size * n)).drop("__total", "row_nr")


def upsampled(human: DataFrame, synthetic: DataFrame, order: str, mode: str = "full") -> DataFrame:
    """Training rows of a kind of mix: "human" or "synthetic" alone, "full" (all of both) or "full_upsampled" (by turns, the smaller side repeated)."""
    if mode == "human":
        return human.select(F.lit("large").alias("side"), order)
    if mode == "synthetic":
        return synthetic.select(F.lit("small").alias("side"), order)
    if mode == "full":
        return human.select(F.lit("large").alias("side"), order).unionByName(synthetic.select(F.lit("small").alias("side"), order))
    if mode == "full_upsampled":
        return interleave(human, synthetic, order).select("side", order)
    raise ValueError(f"unknown mix {mode}")


def interleave(large: DataFrame, small: DataFrame, order: str) -> DataFrame:
    """Rows of both by turns until the larger is through, the smaller one repeated: (turn, side, order column)."""
    a = global_row_number(large.select(order), [order]).select((F.col("row_nr") - 1).alias("i"), order)
    b = global_row_number(small.select(order), [order]).select((F.col("row_nr") - 1).alias("j"), order)
    n = F.broadcast(small.agg(F.count("*").alias("n")))
    turns = a.crossJoin(n).select("i", F.pmod("i", "n").alias("j"))
    again = turns.join(b, "j").select((2 * F.col("i") + 1).alias("turn"), F.lit("small").alias("side"), order)
    return a.select((2 * F.col("i")).alias("turn"), F.lit("large").alias("side"), order).unionByName(again)


def batches(mentions: DataFrame, size: int) -> DataFrame:
    """Mentions that do not wait for each other, with their batch of size rows in the order of documents (beams.run() makes those that do)."""
    return global_row_number(mentions, ["doc_id", "mention_order"]).withColumn("batch", F.floor((F.col("row_nr") - 1) / size)).drop("row_nr")
