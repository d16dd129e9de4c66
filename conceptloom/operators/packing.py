"""Rows packed in order into batches of bounded size, over groups of any size, by a parallel scan.

Packing is a fold: a row joins the open pack if it fits, else it opens the next one. Sorted rows are cut into ranges. What
a range does to the pack that is open before it depends only on which of its rows is the first not to fit; from there on
it packs alike. So a range is summarised as a table from space to (packs, size of the last one), the tables are put one
after another in order, and then every range packs its rows from the state that it is due.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage

#: A row in a range of a group, sorted; and a range's summary.
SUMMARY = "g string, part int, total long, first array<long>, packs array<long>, out array<long>"


def _next(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each row and after the last, the first row that a pack from each row does not hold)."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    after = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    return sums, np.maximum(after, np.arange(len(lengths)) + 1)


def summary(lengths: np.ndarray, budget: int) -> tuple[int, list[int], list[int], list[int]]:
    """(total, first, packs, out): from row j on, the k-th that may be the first not to fit, packs[k] packs are opened and the last has out[k].

    first[k] is the size of the rows before j: row j is the first not to fit if the space left holds these and not its own.
    """
    n = len(lengths)
    sums, after = _next(lengths, budget)
    packs, out = [0] * (n + 1), [0] * (n + 1)
    s, e = sums.tolist(), after.tolist()
    for j in range(n - 1, -1, -1):
        if e[j] < n:
            packs[j], out[j] = packs[e[j]] + 1, out[e[j]]
        else:
            packs[j], out[j] = 1, s[n] - s[j]
    # a row of no length fits wherever a pack is not over full, and then so does the row before it
    may = [j for j in range(n) if s[j] <= budget and (j == 0 or lengths[j] > 0)]
    return s[n], [s[j] for j in may], [packs[j] for j in may], [out[j] for j in may]


def through(state: int, total: int, first: list[int], packs: list[int], out: list[int], budget: int) -> tuple[int, int]:
    """(packs opened, size of the last pack) of a range that is entered with a pack of size state, -1 for none."""
    if state < 0 or state > budget:
        return packs[0], out[0]
    if state + total <= budget:
        return 0, state + total
    k = int(np.searchsorted(np.array(first), budget - state, side="right")) - 1
    return packs[k], out[k]


def replay(lengths: np.ndarray, state: int, budget: int) -> np.ndarray:
    """The pack of each row, counted from the one open before (0) or from the first of all (1 where none is open)."""
    n = len(lengths)
    sums, after = _next(lengths, budget)
    starts = np.zeros(n + 1, np.int64)
    j = 0 if state < 0 or state > budget else int(np.searchsorted(sums, budget - state, side="right")) - 1
    while j < n:
        starts[j] = 1
        j = int(after[j])
    return np.cumsum(starts[:n])


def packed(df: DataFrame, group: list[str], length: str, order: list[str], budget: int, falling: bool = True) -> DataFrame:
    """(group, order, pack): within each group, rows in falling or rising length, then by order, share a pack while their lengths stay within budget.

    A row longer than the budget is a pack of its own; null and negative lengths count as 0; null groups are a group.
    order must tell a group's rows apart. Rows are sorted by ranges, so a group is in no task as a whole; the sorted rows,
    their summaries (a row a range and group) and their states are written once, so a lost executor repeats a range.
    """
    if budget < 0:
        raise ValueError("the budget is not negative")
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    key = F.to_json(F.struct(*(F.col(c) for c in group)), {"ignoreNullFields": "false"})
    d = df.select(*group, *order, size.alias("__n"), key.alias("g")).withColumn("__k", -F.col("__n") if falling else F.col("__n"))
    d = d.repartitionByRange("g", "__k", *order).sortWithinPartitions("g", "__k", *order)
    d = d.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    d = storage.materialize(d.select(*group, *order, "g", "__n", "at", "part"), "sorted")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(g, int(of["part"].iloc[0]), *summary(of["__n"].to_numpy(), budget)) for g, of in pdf.sort_values("at").groupby("g", sort=False)]
        return pd.DataFrame(rows, columns=["g", "part", "total", "first", "packs", "out"])

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        state, pack, rows = -1, -1, []
        for r in pdf.sort_values("part").itertuples(index=False):
            rows.append((r.g, r.part, state, pack))
            more, state = through(state, r.total, list(r.first), list(r.packs), list(r.out), budget)
            pack += more
        return pd.DataFrame(rows, columns=["g", "part", "state", "pack"])

    narrow = d.select("g", "part", "at", "__n")
    summaries = storage.materialize(narrow.groupBy("part").applyInPandas(summarise, SUMMARY), "summaries")
    # a group within one range starts with no pack; of the others there are no more than ranges
    ranges = summaries.groupBy("g").agg(F.count("*").alias("ranges"))
    known = summaries.join(ranges, "g")
    alone = known.where("ranges = 1").select("g", "part", F.lit(-1).cast("long").alias("state"), F.lit(-1).cast("long").alias("pack"))
    split = known.where("ranges > 1").drop("ranges").groupBy("g").applyInPandas(put_together, "g string, part int, state long, pack long")
    states = storage.materialize(alone.unionByName(split), "states")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        out = [of["pack"].iloc[0] + replay(of["__n"].to_numpy(), int(of["state"].iloc[0]), budget) for _, of in pdf.groupby("g", sort=False)]
        return pd.DataFrame({"at": pdf["at"], "pack": np.concatenate(out)})

    packs = narrow.join(states, ["g", "part"]).groupBy("part").applyInPandas(pack, "at long, pack long")
    return d.join(packs, "at").select(*group, *order, F.col("pack").cast("int").alias("pack"))


def sub_batches(packs: DataFrame, keys: list[str], tokens: str, order: list[str], budget: int) -> DataFrame:
    """packs with sub, the part of its pack: rows of a pack in order share a part while their tokens stay within budget.

    keys name a pack, which is bounded by its own budget, so a pack is one array here.
    """
    row = F.struct(*order, F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("__n"))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("sub"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        fits = (a["sum"] == 0) | (a["sum"] + x["__n"] <= budget)
        sub = F.when(fits, a["sub"]).otherwise(a["sub"] + 1)
        return F.struct(F.when(fits, a["sum"] + x["__n"]).otherwise(x["__n"]).alias("sum"), sub.alias("sub"), F.concat(a["out"], F.array(sub)).alias("out"))

    g = packs.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    g = g.select(*keys, F.explode(F.arrays_zip("__rows", F.aggregate("__rows", zero, step, lambda a: a["out"]).alias("sub"))).alias("x"))
    return g.select(*keys, *(F.col(f"x.__rows.{c}").alias(c) for c in order), F.col("x.sub").alias("sub"))

