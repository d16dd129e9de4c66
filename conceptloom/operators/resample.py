"""Multinomial bootstrap counts at any number of documents, drawn where the documents are.

Documents fall in buckets by hash, and the buckets are the leaves of a binary tree. Each replicate has as many draws as
there are documents; going down the tree they are split binomially by the documents on either side, and in a bucket they
fall on its documents evenly: together a multinomial sample of exactly all draws. The random numbers of a node depend
on the seed and the node only, so every task that passes it splits alike, and nothing is drawn on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage
from .metrics import OVERALL, interval

#: Documents of a bucket, about.
BUCKET = 256
#: Documents of a task, about.
TASK_DOCS = 1 << 16


def draws_at(path: list[tuple[int, int]], bucket: int, total: int, replicates: int, seed: int) -> np.ndarray:
    """How many draws of each replicate fall in a bucket; path has the documents (left, both) of each node above it, top down."""
    k = np.full(replicates, total, np.int64)
    for depth, (left, both) in enumerate(path):
        node = bucket >> (len(path) - depth)
        to_left = np.random.default_rng([seed, depth, node]).binomial(k, left / both)
        k = to_left if bucket >> (len(path) - 1 - depth) & 1 == 0 else k - to_left
    return k


def bucket_weights(n: int, k: np.ndarray, bucket: int, levels: int, seed: int) -> np.ndarray:
    """Counts of n documents, a row a replicate, of which replicate b has k[b] draws."""
    at = np.random.default_rng([seed, levels + 1, bucket]).integers(0, n, int(k.sum()))
    of = np.repeat(np.arange(len(k)), k)
    return np.bincount(of * n + at, minlength=len(k) * n).reshape(len(k), n)


def _bucketed(docs: DataFrame, bucket_docs: int) -> tuple[DataFrame, DataFrame, int, int]:
    """docs(doc_id, ...) with bucket, (bucket, path) of each bucket, the levels of the tree, and the number of documents.

    docs is written once: documents are counted, dealt to buckets and drawn from the table, not from its plan.
    """
    named = storage.materialize(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))), "documents")
    total = named.select("doc_id").distinct().count()
    levels = max(0, int(np.ceil(np.log2(max(1, total) / bucket_docs))))
    named = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(1 << levels)))
    sizes = named.select("bucket", "doc_id").distinct().groupBy("bucket").agg(F.count("*").alias("n"))
    if not levels:
        return named, sizes.select("bucket", F.array().cast("array<struct<left:bigint,both:bigint>>").alias("path")), 0, total
    # documents of every node, and with each bucket those of the nodes above it: narrow rows, a few a bucket
    sizes = storage.materialize(sizes, "buckets")
    depth = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("depth")
    nodes = sizes.select("n", depth, "bucket").withColumn("node", F.expr(f"shiftright(bucket, {levels} - depth)")).groupBy("depth", "node").agg(F.sum("n").alias("n"))
    above = sizes.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("depth")).withColumn("node", F.expr(f"shiftright(bucket, {levels} - depth)"))
    left = nodes.where("node % 2 = 0").select((F.col("depth") - 1).alias("depth"), F.expr("node div 2").alias("node"), F.col("n").alias("left"))
    both = above.join(nodes.withColumnRenamed("n", "both"), ["depth", "node"]).join(left, ["depth", "node"], "left").withColumn("left", F.coalesce("left", F.lit(0).cast("bigint")))
    path = both.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "left", "both"))), lambda x: F.struct(x["left"].alias("left"), x["both"].alias("both"))).alias("path"))
    return named, path, levels, total


def _buckets(it: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list]]:
    """The rows of one bucket after another with its path, from batches in which they are neighbours, the path's row first."""
    held: list[pd.DataFrame] = []

    def whole() -> tuple[pd.DataFrame, list]:
        part = pd.concat(held)
        return part.iloc[1:], part["path"].iloc[0]

    for pdf in it:
        for bucket, part in pdf.groupby("bucket", sort=False):
            if held and held[0]["bucket"].iloc[0] != bucket:
                yield whole()
                held = []
            held.append(part)
    if held:
        yield whole()


def _prepared(docs: DataFrame, bucket_docs: int) -> tuple[DataFrame, int, int]:
    """Rows of docs by bucket and document, before those of a bucket a row of its path; a path on each row would outweigh the rows."""
    named, path, levels, total = _bucketed(docs, bucket_docs)
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_DOCS))
    d = named.unionByName(path, allowMissingColumns=True)
    return d.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first()), levels, total


def _drawn(part: pd.DataFrame, path: list, levels: int, total: int, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(the document of each row, counts a row a replicate and a column a document) of a bucket's sorted rows."""
    bucket = int(part["bucket"].iloc[0])
    doc, names = pd.factorize(part["doc_id"])
    above = [(x["left"], x["both"]) for x in path]
    return doc, bucket_weights(len(names), draws_at(above, bucket, total, replicates, seed), bucket, levels, seed)


def multinomial_weights(docs: DataFrame, replicates: int = 1000, seed: int = 42, bucket_docs: int = BUCKET) -> DataFrame:
    """(doc_id, w): how often each document is drawn in each replicate; every replicate draws as many as there are documents."""
    d, levels, total = _prepared(docs.select("doc_id").distinct(), bucket_docs)

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, path in _buckets(it):
            _, w = _drawn(part, path, levels, total, replicates, seed)
            yield pd.DataFrame({"doc_id": [None if x == "\0null" else x for x in part["doc_id"]], "w": list(w.T)})

    return d.select("bucket", "doc_id", "path").mapInPandas(draw, "doc_id string, w array<bigint>")


def bootstrap_ci(per_doc: DataFrame, replicates: int = 1000, seed: int = 42, ci: float = 0.95, label: str = "semantic_group", empty_is_zero: bool = True, bucket_docs: int = BUCKET) -> DataFrame:
    """(label, low, high) of sum(num) / sum(den) over resampled documents, by label and over all, from per_doc(doc_id, label, num, den).

    Counts are drawn bucket by bucket and summed there: only sums by label and replicate leave a task, and no row is
    multiplied by the replicates. A replicate without denominator counts as 0, or not at all; null ids are one document.
    """
    d = per_doc.groupBy("doc_id", label).agg(F.sum("num").cast("double").alias("num"), F.sum("den").cast("double").alias("den"))
    d, levels, total = _prepared(d.withColumnRenamed(label, "label"), bucket_docs)

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"label": list(acc), "num": [x[0] for x in acc.values()], "den": [x[1] for x in acc.values()]})
            acc.clear()
            return out

        for part, path in _buckets(it):
            doc, w = _drawn(part, path, levels, total, replicates, seed)
            of, labels = pd.factorize(part["label"], use_na_sentinel=False)
            values = np.zeros((len(labels), 2, replicates))
            drawn = w.T.astype(float)
            for k, c in enumerate(("num", "den")):
                by = np.zeros((len(labels), w.shape[1]))
                np.add.at(by, (of, doc), part[c].to_numpy())
                values[:, k] = by @ drawn
            for name, v in [*zip((None if pd.isna(x) else x for x in labels), values, strict=True), (OVERALL, values.sum(axis=0))]:
                acc[name] = acc[name] + v if name in acc else v
            if len(acc) > 1000:
                yield flush()
        if acc:  # a task may get no bucket
            yield flush()

    s = d.select("bucket", "doc_id", "label", "num", "den", "path").mapInPandas(sums, "label string, num array<double>, den array<double>")
    b = s.select(F.col("label").alias(label), F.posexplode(F.arrays_zip("num", "den")).alias("b", "x"))
    v = b.groupBy(label, "b").agg(F.sum("x.num").alias("num"), F.sum("x.den").alias("den"))
    return interval(v, ci, label, empty_is_zero)


def paired_bootstrap(pairs: DataFrame, ci: float = 0.95, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of the difference of two runs: rows of metrics.paired()."""
    d = pairs.select("doc_id", "semantic_group", (F.col("hit").cast("int") - F.col("hit_base").cast("int")).alias("num"), F.lit(1).alias("den"))
    return bootstrap_ci(d, replicates, seed, ci, empty_is_zero=False)
