"""A bounded sample of labelled texts for fitting classifiers on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (of a null id: 0's place is taken by crc32 of the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


@dataclass
class Sample:
    texts: list[str]
    labels: list[int]
    #: Rows with each label in the whole training part; what the sample is weighted to.
    totals: dict[int, int]

    def weights(self) -> list[float]:
        have = {y: self.labels.count(y) for y in (0, 1)}
        return [self.totals[y] / have[y] for y in self.labels]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """At most per_class rows of each label and max_chars characters of each, whole texts, in an order of hashed ids.

    train is a condition on labels' id_col. Ids are picked from labels first; then lengths, one row a picked id, tell
    which texts fit, and only those are fetched. A text that would pass the bound is left out and the next ones are
    tried. Of rows that share an id the least by length and hash stands for all; an id with both labels gives both. Rows of labels without a
    label of 0 or 1 do not count; ids whose document is missing are not in the sample. Null texts are empty; empty tables
    give an empty sample; other columns are not read.
    """
    rows = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    totals = {0: 0, 1: 0} | {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).toLocalIterator()}
    order = [F.xxhash64("i"), F.col("i")]
    rows = rows.distinct()
    picked = rows.where("y = 0").orderBy(*order).limit(per_class).unionByName(rows.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # at most per_class ids of each label: broadcast
    found = texts.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min(F.struct(F.length("t").alias("n"), F.xxhash64("t").alias("h"))).alias("x"))
    room, chosen = {0: max_chars, 1: max_chars}, []
    for r in found.orderBy(*order, "y").toLocalIterator():
        if r["x"]["n"] <= room[r["y"]]:
            room[r["y"]] -= r["x"]["n"]
            chosen.append((r["i"], r["x"]["n"], r["x"]["h"], r["y"]))
    if not chosen:
        return Sample([], [], totals)
    want = docs.sparkSession.createDataFrame(chosen, StructType([StructField("i", labels.schema[id_col].dataType), *(StructField(c, k) for c, k in (("n", LongType()), ("h", LongType()), ("y", LongType())))]))
    got = texts.join(F.broadcast(want), (texts["i"] == want["i"]) & (F.length("t") == want["n"]) & (F.xxhash64("t") == want["h"])).select(want["i"], "y", "t")
    have: dict[tuple, str] = {}
    for r in got.toLocalIterator():
        have.setdefault((r["i"], r["y"]), r["t"])
    ordered = [(have[i, y], y) for i, _, _, y in chosen if (i, y) in have]
    return Sample([t for t, _ in ordered], [y for _, y in ordered], totals)
