"""Best synonyms and nearest names by edit distance, term weights and cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import storage


def best_by_similarity(pairs: DataFrame, similarity: Column, keys: list[str], name: str = "entity") -> DataFrame:
    """The name of the largest similarity of each key, ties to the lesser name."""
    d = pairs.withColumn("score", similarity)
    return d.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(name).alias("n"))).alias("x")).select(*keys, F.col("x.n").alias("best_synonym"), (-F.col("x.s")).alias("score"))


def best_synonym(mentions: DataFrame, names: DataFrame, method: str = "levenshtein", vectors: DataFrame | None = None) -> DataFrame:
    """(code, mention, best_synonym, score or distance): of a code's names the one nearest to the mention.

    Distinct (code, mention) pairs are compared once. "title" takes the title; "embedding" reads vectors(text, vector).
    """
    m = mentions.select("code", "mention").dropna().distinct()
    if method == "title":
        return m.join(names.groupBy("code").agg(F.min("title").alias("best_synonym")), "code").withColumn("score", F.lit(1.0))
    n = names.select("code", "entity").distinct()
    if method == "levenshtein":
        return nearest_by_edits(m, n)
    pairs = m.join(n, "code")
    if method == "embedding":
        a, b = (vectors.select(F.col("text").alias(t), F.col("vector").alias(v)) for t, v in (("mention", "__a"), ("entity", "__b")))
        return best_by_similarity(pairs.join(a, "mention").join(b, "entity"), F.round(V.cosine(F.col("__a"), F.col("__b")), 9), ["code", "mention"])
    if method == "tfidf":
        texts = pairs.select(F.col("mention").alias("text")).union(pairs.select("entity")).distinct()
        w = tfidf(texts, "text")
        return best_by_similarity(tfidf_similarity(pairs, w), F.round("similarity", 9), ["code", "mention"])
    raise ValueError(f"unknown method {method}")


def tfidf(texts: DataFrame, text: str, size: int = 3) -> DataFrame:
    """(text, term, weight): character n-grams weighted by tf * ln((1 + n) / (1 + df)) + tf, to unit length."""
    grams = F.expr(f"transform(sequence(1, greatest(1, length({text}) - {size - 1})), i -> substring(lower({text}), i, {size}))")
    tf = texts.select(F.col(text).alias("text"), F.explode(grams).alias("term")).groupBy("text", "term").agg(F.count("*").alias("tf"))
    n = texts.agg(F.count("*").alias("__n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n))  # one row
    w = w.select("text", "term", (F.col("tf") * (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "text").select("text", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_similarity(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs(code, mention, entity) with the dot product of their term weights; pairs that share no term get 0."""
    a = weights.select(F.col("text").alias("mention"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col("text").alias("entity"), "term", F.col("weight").alias("wb"))
    hit = pairs.join(a, "mention").join(b, ["entity", "term"]).groupBy("code", "mention", "entity").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return pairs.join(hit, ["code", "mention", "entity"], "left").fillna(0.0, ["similarity"])


#: Names and mentions of a code that meet at once, and pairs that are compared at once.
NAME_BLOCK, MENTION_BLOCK, PAIRS = 16_384, 512, 65_536


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row each with zeros after its end, and lengths."""
    n = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(int(n.max()), 1)), np.uint32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, n


def _bags(letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often a text has letters of each of 64 classes."""
    on = np.arange(letters.shape[1])[None, :] < n[:, None]
    at = np.arange(len(n))[:, None] * 64 + (letters & 63)
    return np.bincount(at[on].astype(np.int64), minlength=64 * len(n)).reshape(-1, 64).astype(np.int32)


def _edits(a: np.ndarray, n: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of a, of lengths n, and of b, of lengths k: the usual table, a cell of all pairs at a time."""
    a, b = np.ascontiguousarray(a.T[: n.max()]), np.ascontiguousarray(b.T[: k.max()])
    table = np.repeat(np.arange(len(b) + 1, dtype=np.int32)[:, None], len(n), axis=1)
    out = k.astype(np.int32)
    for i, x in enumerate(a):
        corner = table[0].copy()
        table[0] = i + 1
        for j, y in enumerate(b):
            cell = np.minimum(corner + (x != y), np.minimum(table[j + 1], table[j]) + 1)
            corner, table[j + 1] = table[j + 1].copy(), cell
        at = np.flatnonzero(n == i + 1)
        out[at] = table[k[at], at]
    return out


def least_edits(mentions: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the name nearest to each mention, of equals the first.

    Letters that one text has more of than another are a bound of their distance from below. Names are compared in
    the order of this bound, until it passes the least distance found.
    """
    a, n = _letters(mentions)
    b, k = _letters(names)
    mine, theirs = _bags(a, n), _bags(b, k)
    over = np.zeros((len(mentions), len(names)), np.int32)
    for c in np.flatnonzero(theirs.any(axis=0)):
        over += np.maximum(theirs[None, :, c] - mine[:, None, c], 0)
    least = np.maximum(over, over - (k[None, :] - n[:, None])).astype(np.int32)
    best = np.full(len(mentions), np.iinfo(np.int64).max)
    for t in range(int(least.min()), int(least.max()) + 1):
        todo = best // len(names) >= t
        if not todo.any():
            break
        i, j = np.nonzero((least == t) & todo[:, None])
        for s in range(0, len(i), PAIRS):
            x, y = i[s : s + PAIRS], j[s : s + PAIRS]
            np.minimum.at(best, x, _edits(a[x], n[x], b[y], k[y]).astype(np.int64) * len(names) + y)
    return best % len(names), best // len(names)


def nearest_by_edits(mentions: DataFrame, names: DataFrame, name_block: int = NAME_BLOCK, mention_block: int = MENTION_BLOCK) -> DataFrame:
    """(code, mention, best_synonym, distance): of a code's names that of the least edit distance, ties to the lesser name.

    mentions(code, mention) and names(code, entity) are distinct. Both sides of a code are dealt into blocks by its counts,
    so that no code is one task's, and few pairs of two blocks are compared (least_edits); no row a pair is ever made.
    """
    m, n = mentions.select("code", "mention").dropna(), names.select("code", "entity").dropna()
    sizes = n.groupBy("code").agg(F.ceil(F.count("*") / F.lit(name_block)).cast("int").alias("parts"))
    sizes = sizes.join(m.groupBy("code").agg(F.ceil(F.count("*") / F.lit(mention_block)).cast("int").alias("blocks")), "code")
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(name)
    one = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    left = m.join(sizes, "code").select("code", every("parts", "part"), one("mention", "blocks").alias("block"), "mention")
    right = n.join(sizes, "code").select("code", one("entity", "parts").alias("part"), every("blocks", "block"), "entity").toDF("n_code", "n_part", "n_block", "entity")

    def best(key, x: pa.Table, y: pa.Table) -> pa.Table:
        asked, known = x["mention"].to_pylist(), sorted(y["entity"].to_pylist())
        if not asked or not known:
            asked, at, d = [], [], []
        else:
            at, d = least_edits(asked, known)
        columns = [pa.array([key[0].as_py()] * len(asked), key[0].type), pa.array(asked, pa.string()), pa.array([known[i] for i in at], pa.string()), pa.array(d, pa.int32())]
        return pa.Table.from_arrays(columns, ["code", "mention", "best_synonym", "distance"])

    keys = [storage.spread(left, "code", "part", "block").groupBy("code", "part", "block"), storage.spread(right, "n_code", "n_part", "n_block").groupBy("n_code", "n_part", "n_block")]
    met = keys[0].cogroup(keys[1]).applyInArrow(best, f"code {m.schema['code'].dataType.simpleString()}, mention string, best_synonym string, distance int")
    x = met.groupBy("code", "mention").agg(F.min(F.struct("distance", "best_synonym")).alias("x"))
    return x.select("code", "mention", "x.best_synonym", "x.distance")


#: Candidates and queries of a label that meet in one task at once.
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 2_048


def nearest_in_group(queries: DataFrame, candidates: DataFrame, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, label, nearest, score): the other candidate of the largest dot product within each label, ties to the lesser id.

    Both sides of a label are dealt into blocks by its counts, and each pair of blocks meets in one matrix product, of
    which a row a query leaves; no row a pair is ever made, and no label is one task's. Scores are rounded to nine
    decimals, so that equal vectors tie. A query of a label without another candidate has no row.
    """
    sizes = candidates.groupBy("label").agg(F.ceil(F.count("*") / F.lit(candidate_block)).cast("int").alias("parts"))
    sizes = sizes.join(queries.groupBy("label").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks")), "label")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    c = candidates.join(sizes, "label").select("label", one("parts").alias("part"), every("blocks", "block"), "id", "vector")
    q = queries.join(sizes, "label").select("label", every("parts", "part"), one("blocks").alias("block"), "id", "vector")
    q = q.toDF("q_label", "q_part", "q_block", "id", "vector")
    kind = pa.schema([("query_id", pa.int64()), ("label", pa.int32()), ("cand", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table) -> np.ndarray:
        return np.array(t["vector"].to_pylist(), float).reshape(t.num_rows, -1)

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        left = left.sort_by("id")
        ids, mine = left["id"].to_numpy(), right["id"].to_numpy()
        score = np.round(matrix(right) @ matrix(left).T, 9)
        score[mine[:, None] == ids[None, :]] = -np.inf
        at = score.argmax(axis=1)  # the first of equals: the least id
        top = score[np.arange(len(mine)), at]
        ok = top > -np.inf
        return pa.Table.from_arrays([pa.array(mine[ok], pa.int64()), pa.array([key[0].as_py()] * int(ok.sum()), pa.int32()), pa.array(ids[at[ok]], pa.int64()), pa.array(top[ok])], schema=kind)

    met = c.groupBy("label", "part", "block").cogroup(q.groupBy("q_label", "q_part", "q_block")).applyInArrow(best, "query_id long, label int, cand long, score double")
    x = met.groupBy("query_id", "label").agg(F.min(F.struct((-F.col("score")).alias("d"), "cand")).alias("x"))
    return x.select("query_id", "label", F.col("x.cand").alias("nearest"), (-F.col("x.d")).alias("score"))


def rank_candidates(scored: DataFrame, keys: list[str], score: str = "score", tie: str = "entity") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
