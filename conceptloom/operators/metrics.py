"""Evaluation: predictions, slices, recall, precision, bootstrap intervals, deltas, error propagation, alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

OVERALL = "overall"


def load_predictions(raw: DataFrame, top_k: int = 1) -> DataFrame:
    """Predictions of rank top_k at most: codes normalised, one row a (document, mention, rank), golds of NO_CODE and null left out.

    Of repeated rows that of the highest score, then of the least code, stays. A prediction without a name has the empty one.
    """
    w = Window.partitionBy("doc_id", "mention_id").orderBy("rank", F.desc("score"), F.col("pred_concept_code").asc_nulls_last())
    rows = raw.where((F.col("rank") <= top_k) & ~F.col("gold_concept_code").contains("NO_CODE"))
    # a rank's first row follows one of another rank: all ranks of a mention stay together, as they may lie already
    return (
        rows.withColumn("__before", F.lag("rank").over(w))
        .where("__before IS NULL OR __before <> rank")
        .drop("__before")
        .withColumns({"gold_concept_code": T.normalize_codes(F.col("gold_concept_code")), "pred_concept_code": T.normalize_codes(F.col("pred_concept_code"))})
        .withColumns({c: F.coalesce(c, F.lit("")) for c in ("pred_concept_name",) if c in raw.columns})
    )


def in_order(preds: DataFrame, tasks: int | None = None) -> DataFrame:
    """Predictions by mention and rank, both in string order of the mention; sorted in as many tasks as given."""
    if tasks:
        return preds.repartitionByRange(tasks, "mention_id", "rank").sortWithinPartitions("mention_id", "rank")
    return preds.orderBy("mention_id", "rank")


def overall_last(df: DataFrame, label: str = "semantic_group") -> DataFrame:
    """Rows by label, that of all labels last."""
    return df.orderBy(F.col(label) == OVERALL, label)


def with_labels(df: DataFrame, labels: DataFrame, label: str = "semantic_group") -> DataFrame:
    """A row for each of labels(label) and for all, zeros where df has none."""
    every = labels.select(label).where(F.col(label).isNotNull()).distinct().unionByName(df.where(F.col(label) == OVERALL).select(label)).distinct()
    rest = [c for c in df.columns if c != label]
    return every.join(df, label, "left").select(label, *(F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in rest))


def correct() -> Column:
    return F.coalesce(F.col("gold_concept_code") == F.col("pred_concept_code"), F.lit(False))


def by_group(df: DataFrame, aggregates: list[Column], label: str = "semantic_group") -> DataFrame:
    """One row a label and one for all, in one pass (grouping sets)."""
    return df.rollup(label).agg(F.grouping(label).alias("__all"), *aggregates).withColumn(label, F.when(F.col("__all") == 1, F.lit(OVERALL)).otherwise(F.col(label))).drop("__all")


def recall_by_group(top1: DataFrame) -> DataFrame:
    out = by_group(top1, [F.count("*").alias("n"), F.count_if(correct()).alias("n_correct")])
    return out.withColumn("recall", T.safe_divide(F.col("n_correct"), F.col("n")))


def recall_at_k(preds: DataFrame) -> DataFrame:
    """Any of a mention's ranked codes right, with the row of the first rank."""
    m = preds.groupBy("doc_id", "mention_id").agg(F.min_by("semantic_group", "rank").alias("semantic_group"), F.bool_or(correct()).alias("hit"))
    out = by_group(m, [F.count("*").alias("n"), F.count_if("hit").alias("n_correct")])
    return out.withColumn("recall", T.safe_divide(F.col("n_correct"), F.col("n")))


def threshold_prf(top1: DataFrame, threshold: float, score: str = "score", label: str = "semantic_group") -> DataFrame:
    """Precision over predictions of at least threshold, recall over all mentions, and F1."""
    on = F.coalesce(F.col(score) >= threshold, F.lit(False))
    out = by_group(top1, [F.count("*").alias("n"), F.count_if(on).alias("n_pred"), F.count_if(on & correct()).alias("n_correct")], label)
    p, r = T.safe_divide(F.col("n_correct"), F.col("n_pred")), T.safe_divide(F.col("n_correct"), F.col("n"))
    return out.withColumns({"precision": p, "recall": r, "f1": T.f1(p, r)})


def relation_recalls(top1: DataFrame, label: str = "relation", threshold: float | None = None, score: str = "score") -> DataFrame:
    """Shares of strict hits and of judged relations; "correct" is a hit or EXACT, "broad" takes BROAD and PARTIAL.

    With a threshold the shares are of the predictions of at least that score, and n_pred and kept say how many those are.
    """
    r = F.col(label)
    on = F.lit(True) if threshold is None else F.coalesce(F.col(score) >= threshold, F.lit(False))
    counts = {
        "strict": correct(),
        "correct": correct() | (r == "EXACT"),
        "exact": r == "EXACT",
        "partial": r == "PARTIAL",
        "narrow": r == "NARROW",
        "broad": r.isin("BROAD", "PARTIAL"),
        "no_relation": r == "NO_RELATION",
    }
    kept = [] if threshold is None else [F.count_if(on).alias("n_pred")]
    out = by_group(top1, [F.count("*").alias("n"), *kept, *(F.count_if(F.coalesce(c, F.lit(False)) & on).alias(f"n_{k}") for k, c in counts.items())])
    of = F.col("n" if threshold is None else "n_pred")
    out = out.withColumns({k: T.safe_divide(F.col(f"n_{k}"), of) for k in counts})
    return out if threshold is None else out.withColumn("kept", T.ratio_text(F.col("n_pred"), F.col("n")))


def grid_report(recalls: DataFrame, runs: list[str], labels: DataFrame | None = None) -> DataFrame:
    """A row a label and a column a run, each 'p% (a/b)', from recalls(run, semantic_group, n, n_correct); all labels last.

    A label of labels that a run has not met shows as nothing of nothing.
    """
    text = T.ratio_text(F.coalesce("n_correct", F.lit(0)), F.coalesce("n", F.lit(0)))
    wide = recalls.withColumn("text", text).groupBy("semantic_group").pivot("run", runs).agg(F.first("text"))
    if labels is not None:
        wide = labels.select("semantic_group").distinct().join(wide, "semantic_group", "full")
    return overall_last(wide.select("semantic_group", *(F.coalesce(r, F.lit("0% (0/0)")).alias(r) for r in runs)))


def top_values(train: DataFrame, column: str, n: int = 100) -> DataFrame:
    """The n most frequent values, ties by value."""
    return train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("times")).orderBy(F.desc("times"), column).limit(n)


def repeat_rank(top1: DataFrame) -> DataFrame:
    """How often a concept was met in its document up to this mention, and in all."""
    w = Window.partitionBy("doc_id", "gold_concept_code")
    order = w.orderBy(T.trailing_number(F.col("mention_id")), F.col("mention_id")).rowsBetween(Window.unboundedPreceding, 0)
    return top1.withColumns({"repeat_rank": F.count("mention_id").over(order), "repeats": F.count("mention_id").over(w)})


def seen(df: DataFrame, train: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """df with a flag: whether its keys occur in train. Null keys are not seen."""
    known = train.select(*(F.col(k).alias(f"__{k}") for k in keys)).dropna().distinct().withColumn(flag, F.lit(True))
    on = [df[k] == known[f"__{k}"] for k in keys]
    return df.join(known, on, "left").drop(*(f"__{k}" for k in keys)).withColumn(flag, F.coalesce(flag, F.lit(False)))


def tag_slices(top1: DataFrame, train: DataFrame) -> DataFrame:
    """top1 with the columns that slices() reads: what training has seen, the hundred most frequent, and repeats."""
    d = repeat_rank(top1)
    for keys, flag in ((["gold_concept_code"], "seen_code"), (["mention"], "seen_mention"), (["mention", "gold_concept_code"], "seen_pair")):
        d = seen(d, train, keys, flag)
    for key, flag in (("gold_concept_code", "top_code"), ("mention", "top_mention")):
        d = seen(d, F.broadcast(top_values(train, key)), [key], flag)  # a hundred rows
    return d


def counted(top1: DataFrame, hits: dict[str, Column], train: Column) -> DataFrame:
    """top1 with equal rows as one: what slices() reads, training rows apart (train), times and the number of each of hits.

    Training and test rows share no document. Most mentions, codes and names come again and again, so the rows that meet
    what training has seen are few beside top1. Ranks of repeats are told apart up to 5, as slices() tells them.
    """
    d = repeat_rank(top1.withColumn("train", train))
    d = d.withColumns({"repeats": F.least("repeats", F.lit(2)), "repeat_rank": F.least("repeat_rank", F.lit(5))})
    # training is read for its mentions and codes alone
    d = d.withColumns({c: F.when(~F.col("train"), F.col(c)) for c in ("semantic_group", "gold_concept_name", "repeats", "repeat_rank")})
    keys = ("train", "semantic_group", "mention", "gold_concept_code", "gold_concept_name", "repeats", "repeat_rank")
    return d.groupBy(*keys).agg(F.count("*").alias("times"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in hits.items()))


def sums_of_slices(counts: DataFrame, hits: dict[str, str], more: dict[str, Column] | None = None) -> DataFrame:
    """(semantic_group, slice, n, the columns that hits names) of counted() rows, which are read several times: all slices in one aggregate."""
    train = counts.where("train")
    d = counts.where(~F.col("train"))
    for keys, flag in ((["gold_concept_code"], "seen_code"), (["mention"], "seen_mention"), (["mention", "gold_concept_code"], "seen_pair")):
        d = seen(d, train, keys, flag)
    for key, flag in (("gold_concept_code", "top_code"), ("mention", "top_mention")):
        top = train.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("times").alias("times")).orderBy(F.desc("times"), key).limit(100)
        d = seen(d, F.broadcast(top), [key], flag)
    tags = slices() | (more or {})
    columns = {"n": "times"} | {name: k for k, name in hits.items()}
    of = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    wide = by_group(d, [of(c, x).alias(f"{name}_{k}") for k, c in tags.items() for name, x in columns.items()])
    each = F.array(*(F.struct(F.lit(k).alias("slice"), *(F.col(f"{name}_{k}").alias(name) for name in columns)) for k in tags))
    return wide.select("semantic_group", F.explode(each).alias("x")).select("semantic_group", "x.*")


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """metrics_all_slices() of counted() rows with the number of hits as hit."""
    return sums_of_slices(counts, {"hit": "n_correct"}).withColumn("recall", T.safe_divide(F.col("n_correct"), F.col("n")))


def deltas_of_counts(counts: DataFrame) -> DataFrame:
    """paired_delta_slices() of counted() rows with the hits of both runs as hit_base and hit."""
    long = sums_of_slices(counts, {"hit_base": "n_base", "hit": "n_other"}, {"multi_words": T.word_count(F.col("mention")) > 1})
    return long.withColumn("delta", T.safe_divide(F.col("n_other") - F.col("n_base"), F.col("n")))


def slices(d: DataFrame | None = None) -> dict[str, Column]:
    """The 28 slices of single predictions, over the columns of tag_slices(); All@5 is recall_at_k()."""
    words, c = T.word_count(F.col("mention")), F.col
    same = F.lower("mention") == F.lower("gold_concept_name")
    return {
        "all": F.lit(True),
        "seen_cuis": c("seen_code"),
        "unseen_cuis": ~c("seen_code"),
        "seen_mentions": c("seen_mention"),
        "unseen_mentions": ~c("seen_mention"),
        "in_top_100_cuis": c("top_code"),
        "not_in_top_100_cuis": ~c("top_code"),
        "in_top_100_mentions": c("top_mention"),
        "not_in_top_100_mentions": ~c("top_mention"),
        "seen_unique_pairs": c("seen_pair"),
        "unseen_unique_pairs": ~c("seen_pair"),
        "identical": same,
        "not_identical": ~same,
        "one_word": words == 1,
        "two_words": words == 2,
        "three_words": words == 3,
        "more_than_three_words": words > 3,
        "abbrev_only": T.abbreviation_only(c("mention")),
        "abbrev_or_contains": T.abbreviation_inside(c("mention")),
        "not_abbrev": ~T.abbreviation_inside(c("mention")),
        "repeated": c("repeats") > 1,
        "repeated_rank_2": c("repeat_rank") == 2,
        "repeated_rank_3": c("repeat_rank") == 3,
        "repeated_rank_4": c("repeat_rank") == 4,
        "repeated_rank_gte_5": c("repeat_rank") >= 5,
        "not_repeated": c("repeats") == 1,
        "simple_concepts": ~c("gold_concept_code").contains("+"),
        "composite_concepts": c("gold_concept_code").contains("+"),
    }


def metrics_all_slices(tagged: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """(semantic_group, slice, n, n_correct, recall) of all slices in one aggregate; with preds also All@5.

    Two conditional counts a slice and no row more: the slices overlap, and exploding them would multiply the rows.
    """
    tags = slices()
    aggregates = [x for k, cond in tags.items() for x in (F.count_if(F.coalesce(cond, F.lit(False))).alias(f"n_{k}"), F.count_if(F.coalesce(cond & correct(), F.lit(False))).alias(f"c_{k}"))]
    wide = by_group(tagged, aggregates)
    long = wide.select("semantic_group", F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(f"n_{k}").alias("n"), F.col(f"c_{k}").alias("n_correct")) for k in tags))).alias("x")).select("semantic_group", "x.*")
    long = long.withColumn("recall", T.safe_divide(F.col("n_correct"), F.col("n")))
    if preds is not None:
        long = long.unionByName(all_at_k(preds).select(long.columns))
    return long


def all_at_k(preds: DataFrame, name: str = "all_at_5") -> DataFrame:
    """recall_at_k() as a slice beside those of single predictions; it reads none of their tags."""
    return recall_at_k(preds).select("semantic_group", F.lit(name).alias("slice"), "n", "n_correct", "recall")


def bootstrap_weights(spark: SparkSession, docs: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(doc_id, b, w): multinomial document counts of each replicate; for up to about 50,000 documents."""
    n = len(docs)
    counts = np.random.default_rng(seed).multinomial(n, np.full(n, 1 / n), size=replicates) if n else np.zeros((replicates, 0), int)
    rows = [(d, counts[:, i].tolist()) for i, d in enumerate(sorted(docs))]
    return spark.createDataFrame(rows, "doc_id string, w array<bigint>")


def bootstrap_ci(per_doc: DataFrame, weights: DataFrame, ci: float = 0.95, label: str = "semantic_group", empty_is_zero: bool = True) -> DataFrame:
    """(label, low, high) of sum(w * num) / sum(w * den) over replicates, from per_doc(doc_id, label, num, den).

    Documents are summed before weights are met, so the rows that are multiplied by the replicates are one a document and
    label. A replicate without denominator counts as 0, or not at all.
    """
    d = per_doc.groupBy("doc_id", label).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    d = d.unionByName(d.groupBy("doc_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn(label, F.lit(OVERALL)))
    b = d.join(weights, "doc_id").select(label, "num", "den", F.posexplode("w").alias("b", "k"))
    v = b.groupBy(label, "b").agg(F.sum(F.col("k") * F.col("num")).alias("num"), F.sum(F.col("k") * F.col("den")).alias("den"))
    return interval(v, ci, label, empty_is_zero)


def interval(sums: DataFrame, ci: float, label: str, empty_is_zero: bool) -> DataFrame:
    """(label, low, high) of num / den over replicates."""
    ratio = F.try_divide(F.col("num").cast("double"), F.col("den").cast("double"))
    v = sums.withColumn("v", F.coalesce(ratio, F.lit(0.0)) if empty_is_zero else ratio)
    return v.groupBy(label).agg(F.percentile("v", (1 - ci) / 2).alias("low"), F.percentile("v", (1 + ci) / 2).alias("high"))


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """Mentions of two runs side by side: (doc_id, mention_id, semantic_group, hit_base, hit)."""
    b = base.select("doc_id", "mention_id", correct().alias("hit_base"))
    return other.select("doc_id", "mention_id", "semantic_group", correct().alias("hit")).join(b, ["doc_id", "mention_id"])


def paired_delta(pairs: DataFrame) -> DataFrame:
    """Recall of both runs and their difference, by group and overall."""
    out = by_group(pairs, [F.count("*").alias("n"), F.count_if("hit_base").alias("n_base"), F.count_if("hit").alias("n_other")])
    return out.withColumn("delta", T.safe_divide(F.col("n_other") - F.col("n_base"), F.col("n")))


def paired_delta_slices(base: DataFrame, other: DataFrame, train: DataFrame) -> DataFrame:
    """paired_delta in every slice of slices() and in "multi_words": (semantic_group, slice, n, n_base, n_other, delta), in one aggregate."""
    tagged = tag_slices(other, train)
    b = base.select("doc_id", "mention_id", correct().alias("hit_base"))
    d = tagged.withColumn("hit", correct()).join(b, ["doc_id", "mention_id"])
    tags = slices() | {"multi_words": T.word_count(F.col("mention")) > 1}
    count = lambda c, k: F.count_if(F.coalesce(c, F.lit(False))).alias(k)
    wide = by_group(d, [x for k, c in tags.items() for x in (count(c, f"n_{k}"), count(c & F.col("hit_base"), f"b_{k}"), count(c & F.col("hit"), f"o_{k}"))])
    each = F.array(*(F.struct(F.lit(k).alias("slice"), F.col(f"n_{k}").alias("n"), F.col(f"b_{k}").alias("n_base"), F.col(f"o_{k}").alias("n_other")) for k in tags))
    long = wide.select("semantic_group", F.explode(each).alias("x")).select("semantic_group", "x.*")
    return long.withColumn("delta", T.safe_divide(F.col("n_other") - F.col("n_base"), F.col("n")))


def context_delta(rates: DataFrame, base: str, other: str) -> DataFrame:
    """Echo rates of two contexts side by side, their difference, and the exposed mentions of the base as support, all labels last.

    rates(semantic_group, context, echo_rate, n_exposed); a label that one context lacks has a null rate and delta.
    """
    rate = pivot_contexts(rates, [base, other], "echo_rate")
    support = rates.where(F.col("context") == base).select("semantic_group", F.col("n_exposed").alias("support"))
    d = rate.join(support, "semantic_group", "full").withColumns({"support": F.coalesce("support", F.lit(0).cast("long")), "delta": F.col(other) - F.col(base)})
    n = F.when(F.col("semantic_group") == OVERALL, F.lit(" (N=")).otherwise(F.lit(" (n="))
    return overall_last(d.withColumn("label", F.concat(T.renamed(F.col("semantic_group")), n, F.col("support").cast("string"), F.lit(")"))))


def paired_bootstrap(pairs: DataFrame, weights: DataFrame, ci: float = 0.95) -> DataFrame:
    """Intervals of the difference of two runs under given weights (resample.paired_bootstrap draws its own)."""
    d = pairs.select("doc_id", "semantic_group", (F.col("hit").cast("int") - F.col("hit_base").cast("int")).alias("num"), F.lit(1).alias("den"))
    return bootstrap_ci(d, weights, ci, empty_is_zero=False)


def best_run(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest delta of each key, ties to the larger run name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("delta"), F.desc("run"))
    return deltas.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def echo_errors(top1: DataFrame) -> DataFrame:
    """By group: mentions after the first error on their concept in the document, and those that repeat its wrong code."""
    wrong = F.coalesce((F.col("pred_concept_code") != F.col("gold_concept_code")) & (F.col("pred_concept_code") != ""), F.lit(False))
    key = Window.partitionBy("doc_id", "gold_concept_code")
    d = top1.select("semantic_group", "doc_id", "gold_concept_code", "pred_concept_code", T.trailing_number(F.col("mention_id")).alias("o"), "mention_id", wrong.alias("wrong"))
    place = F.struct("o", "mention_id")
    d = d.withColumn("first", F.min(F.when(F.col("wrong"), F.struct(place.alias("at"), F.col("pred_concept_code").alias("code")))).over(key))
    exposed = F.coalesce(place > F.col("first.at"), F.lit(False))
    echo = exposed & F.col("wrong") & (F.col("pred_concept_code") == F.col("first.code"))
    out = by_group(d, [F.count("*").alias("n"), F.count_if(exposed).alias("n_exposed"), F.count_if(F.coalesce(echo, F.lit(False))).alias("n_echo")])
    return out.withColumn("echo_rate", T.safe_divide(F.col("n_echo"), F.col("n_exposed")))


def pivot_contexts(rates: DataFrame, contexts: list[str], value: str) -> DataFrame:
    """A column for each context, and a row for each group."""
    return rates.groupBy("semantic_group").pivot("context", contexts).agg(F.first(value))


def align_entities(gold: DataFrame, pred: DataFrame, match_label: bool = True) -> DataFrame:
    """Full outer alignment of entity spans: TP, FP or FN, and the ids of both sides. Equal spans on a side multiply."""
    on = ["filename", "start_span", "end_span", *(["label"] if match_label else [])]
    g = gold.select(*on, F.col("mention_id").alias("gold_mention_id"), *([] if match_label else [F.col("label").alias("gold_label")]))
    p = pred.select(*on, F.col("pred_mention_id"), *([] if match_label else [F.col("label").alias("pred_label")]))
    out = g.join(p, on, "full")
    status = F.when(F.col("gold_mention_id").isNull(), "FP").when(F.col("pred_mention_id").isNull(), "FN").otherwise("TP")
    if not match_label:
        out = out.withColumn("label", F.coalesce("pred_label", "gold_label")).drop("pred_label", "gold_label")
    return out.select("filename", "start_span", "end_span", "label", "gold_mention_id", "pred_mention_id", status.alias("ner_status"))


def entity_prf(aligned: DataFrame) -> DataFrame:
    s = F.col("ner_status")
    out = by_group(aligned, [F.count_if(s == "TP").alias("tp"), F.count_if(s == "FP").alias("fp"), F.count_if(s == "FN").alias("fn")], "label")
    p, r = T.safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), T.safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": T.f1(p, r)})


def span_exact_match(tokens: DataFrame) -> DataFrame:
    """Recall of runs of labels other than -100: (row_id, pos, label, pred); a prediction stands one place before its label."""
    w = Window.partitionBy("row_id").orderBy("pos")
    d = tokens.withColumn("shifted", F.lag("pred").over(w)).withColumn("on", F.col("label") != -100)
    d = d.where("on").withColumn("island", F.col("pos") - F.row_number().over(w))
    spans = d.where(F.col("pos") > 0).groupBy("row_id", "island").agg(F.bool_and(F.coalesce(F.col("label") == F.col("shifted"), F.lit(False))).alias("hit"))
    return spans.agg(F.count("*").alias("num_gold"), T.safe_divide(F.count_if("hit"), F.count("*")).alias("recall"))
