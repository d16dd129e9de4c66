"""Mixing sources to target weights by balanced sampling (the cube method).

A document of a source whose target is r times its size is taken floor(r) times for certain and once more with
probability r - floor(r). The flight phase moves these probabilities through the null space of the balancing
constraints (documents and words of the source) until all but two of a block are 0 or 1; the rest of the blocks fly
again together, level by level, until each source has a landing problem of two documents at most.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order, repeating; the mix has MIX times the words of all documents; a document is taken CAP times at most.
WEIGHTS, MIX, CAP = (3, 1, 2), 1.5, 2
#: Documents that fly together; what a level leaves flies again until a source fits one block.
BLOCK = 4096
EPS = 1e-9


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, mix: float = MIX, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) for each source of docs(source, size), by water filling.

    Sources go by code point, null last. A source's target is min(cap * its size, its weight * level); the level is that
    at which the targets add up to mix times all words. One row a source: only this table passes a global window.
    """
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("at", F.col("cap") / F.col("w"))
    fill = Window.orderBy("at", F.col("source").asc_nulls_last())
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("want", F.sum("source_size").over(all_) * F.lit(float(mix)))
    s = s.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(done), F.lit(0.0))))
    # the level rises over the sources it fills, in the order in which they fill, and falls after: the highest is right
    s = s.withColumn("level", F.max("level").over(all_))
    return s.select("source", "source_size", "n", F.least(F.col("cap"), F.col("w") * F.col("level")).alias("target"))


def _unit(*parts: object) -> float:
    """A number in [0, 1) that only depends on parts."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") / 2.0**64


def flight(pi: list[float], size: list[float], seed: object) -> list[float]:
    """Moves pi until at most two are between 0 and 1; sums of pi and of pi * size stay as they were."""
    pi = list(pi)
    live: list[int] = []
    step = 0
    scale = max([1.0, *size])
    for k in range(len(pi)):
        if not EPS < pi[k] < 1 - EPS:
            pi[k] = float(round(pi[k]))
            continue
        live.append(k)
        if len(live) < 3:
            continue
        x = [size[i] / scale for i in live]
        u = [x[2] - x[1], x[0] - x[2], x[1] - x[0]]  # orthogonal to (1, 1, 1) and to x
        if not any(abs(v) > 1e-12 for v in u):
            u = [1.0, -1.0, 0.0]
        _move(pi, live, u, _unit(seed, step))
        step += 1
        live = [i for i in live if EPS < pi[i] < 1 - EPS]
    return pi


def _move(pi: list[float], live: list[int], u: list[float], draw: float) -> None:
    """One step along u or against it, to the first bound either way; the expectation of pi does not change."""
    up = min((1 - pi[i]) / v if v > 0 else pi[i] / -v for i, v in zip(live, u, strict=True) if v)
    down = min(pi[i] / v if v > 0 else (1 - pi[i]) / -v for i, v in zip(live, u, strict=True) if v)
    by = up if draw * (up + down) < down else -down
    for i, v in zip(live, u, strict=True):
        pi[i] += by * v
        if pi[i] < EPS or pi[i] > 1 - EPS:
            pi[i] = float(round(pi[i]))


def landing(pi: list[float], size: list[float], seed: object) -> list[float]:
    """Settles what flight left: first the documents constraint is dropped, then the words constraint."""
    pi = list(pi)
    live = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    if len(live) == 2:
        a, b = live
        top = max(size[a], size[b], 1.0)
        _move(pi, live, [size[b] / top, -size[a] / top] if size[a] or size[b] else [1.0, -1.0], _unit(seed, "words"))
        live = [i for i in live if EPS < pi[i] < 1 - EPS]
    for i in live:
        pi[i] = 1.0 if _unit(seed, "last", i) < pi[i] else 0.0
    return pi


def _fly(df: DataFrame, by: list[str], last: bool) -> DataFrame:
    names = df.columns
    schema = df.schema
    # large documents first, so that those left for the landing are small
    order = [("__size", "descending"), *((c, "ascending") for c in ("__tie", "__id", *common.ADDRESS) if c in names)]

    def block(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=order))
        size = t["__size"].to_pylist()
        seed = (str(t["__tie"][0].as_py()), len(size))
        pi = flight(t["__pi"].to_pylist(), size, seed)
        pi = landing(pi, size, seed) if last else pi
        return t.set_column(t.schema.get_field_index("__pi"), "__pi", pa.array(pi, pa.float64())).select(names)

    return df.groupBy(*by).applyInArrow(block, schema)


def _salted(d: DataFrame, many: int) -> DataFrame:
    """d, a table of materialize(), with __salt: 0, and for rows met more than many times a number by their place in d's files.

    Equal rows are alike, so it does not matter which of them gets which number, only that no block gets them all.
    """
    hot = common.materialize(d.groupBy("__tie").agg(F.count("*").alias("m")).where(F.col("m") > many).select(F.col("__tie").alias("__hot"), F.ceil(F.col("m") / F.lit(many)).alias("m")), "hot")
    n = hot.count()
    if not n:
        return d.withColumn("__salt", F.lit(0).cast("long"))
    row = d.metadataColumn("_metadata")["row_index"]
    d = d.select("*", row.alias("__row"))
    # up to 10,000 hot values are broadcast; more are joined by a shuffle
    d = d.join(F.broadcast(hot) if n <= 10_000 else hot, d["__tie"] == hot["__hot"], "left")
    return d.withColumn("__salt", F.coalesce(F.pmod("__row", "m"), F.lit(0)).cast("long")).drop("__row", "__hot", "m")


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, address: list[Column] | None = None, **targets) -> DataFrame:
    """A row for each row of docs: (id_col, source, size, source_size, target, copies, taken).

    size is the words of the text (null: 0); copies is 0 to the cap; taken is size * copies. Only ids, sizes, sources and
    hashes are written and shuffled. Rows are dealt to blocks and drawn by hashes of their values, so reruns agree; rows
    equal in all of id, source and text are alike and may trade places. A source without words has target 0 and copies 0;
    an empty table gives no rows; columns other than these three are not read, whatever their names. With address
    (see common.addressed) rows carry it too.
    """
    size = F.size(common.words(F.col(text_col))) if size is None else size
    tie = F.xxhash64(F.col(id_col), F.coalesce(F.col(source_col), F.lit("")), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    where = list(common.ADDRESS) if address else []
    d = common.materialize(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), tie.alias("__tie"), *(address or [])), "sizes")
    d = _salted(d, block // 4)
    t = common.materialize(source_targets(d, **targets), "targets")
    d = d.join(t, d["source"].eqNullSafe(t["source"])).select(d["*"], "source_size", "n", "target")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    d = d.withColumn("__whole", F.floor(ratio + F.lit(EPS))).withColumn("__pi", F.greatest(F.lit(0.0), ratio - F.col("__whole")))
    d = d.select("*", F.col("size").cast("double").alias("__size"), F.ceil(F.col("n") / F.lit(block)).alias("__blocks"), F.pmod(F.xxhash64("__tie", "size", "__salt"), F.ceil(F.col("n") / F.lit(block))).alias("__block"))
    level, parts = d, []
    blocks = t.agg(F.max(F.ceil(F.col("n") / F.lit(block)))).head()[0] or 0
    while True:
        last = blocks <= 1
        flown = common.materialize(_fly(level, ["source", "__block"], last), "flight")
        settled = (F.col("__pi") == 0) | (F.col("__pi") == 1)
        parts.append(flown if last else flown.where(settled))
        if last:
            break
        # two of a block are left at most, so block // 4 blocks come together again
        fewer = F.ceil(F.col("__blocks") * F.lit(4) / F.lit(block))
        level = flown.where(~settled).withColumn("__blocks", fewer).withColumn("__block", F.pmod(F.xxhash64("__tie", "size", "__salt", F.lit(1)), F.col("__blocks")))
        level = level.select(flown.columns)
        blocks = -(-blocks * 4 // block)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = (F.col("__whole") + F.col("__pi")).cast("long")
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *where)


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = None, **how) -> DataFrame:
    """docs as the mix takes them: a row for each copy, with its number from 1 in a last column.

    That column is copy_col, which docs must not have (ValueError), or else copy, or the first of copy_2, copy_3 and so on that docs has not.

    Each row of docs is told its own copies by its address, so repeated rows need no group of their own, and texts are
    not shuffled. Columns keep their names and values. An empty table gives no rows.
    """
    if copy_col in docs.columns:
        raise ValueError(f"docs has a column {copy_col} already")
    free = (c for c in ("copy", *(f"copy_{i}" for i in range(2, len(docs.columns) + 3))) if c not in docs.columns)
    copy_col = copy_col or next(free)
    docs, address = common.addressed(docs, "mixed")
    plan = mix(docs, None, id_col, source_col, text_col, address=address, **how)
    taken = common.attach(docs, plan.where("copies > 0").select(*common.ADDRESS, F.col("copies").cast("int").alias("__copies")), "copies")
    return taken.select(*(taken[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(copy_col))
