"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band of MinHash values: with 40 bands of 8 values, a pair of similarity 0.8 shares one in 99.94% of
cases, one of 0.9 practically always. All candidates are checked on their whole shingle sets, so no link is false.

A band that few share is compared pair by pair. Texts of a crowded band are compared with pivots first, which joins most
families. Crowds that this leaves in several classes are joined exactly, without pairs: see crowds() and linked_within().
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import common

SHINGLE, BANDS, ROWS = 5, 40, 8
#: Bands shared by up to this many texts are compared pair by pair; larger ones are crowds.
PAIR_BUCKET = 16
#: Shingles of a block of a crowd, about.
CROWD_BLOCK = 1 << 21
#: Shingles hashed at once.
PART = 1 << 11
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS + SHINGLE + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE, _PLACE, _ROW = np.split(_ODD, [BANDS * ROWS, BANDS * ROWS + SHINGLE])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, a blank one has none."""
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    of = {x: h(x, 42) for x in set(w)}
    a = np.array([of[x] for x in w], np.uint64)
    k = min(SHINGLE, len(a))
    return np.unique(_mix(sum(_mix(a[i : len(a) - k + 1 + i] * _PLACE[i]) for i in range(k)) + np.uint64(k)))


def minima(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), PART):
        x = s[at : at + PART, None] * _PERMUTE
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values."""
    return _mix((_mix(least.reshape(BANDS, ROWS)) * _ROW).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


#: Share of MinHash values that a pair must have in common to be checked on its whole sets. Over 320 values a pair of
#: similarity 0.8 has a standard deviation of 0.022, so it falls below in one case of ten million.
LEAST_ALIKE = 0.68


@functools.cache
def _udfs():
    @F.pandas_udf("digest long, n int, keys array<long>, signature binary")
    def sketch(text: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in text]
        digest = [int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
        least = [minima(s) if len(s) else None for s in sets]
        keys = [band_keys(x).view(np.int64) if x is not None else np.zeros(0, np.int64) for x in least]
        signature = [(x & np.uint64(255)).astype(np.uint8).tobytes() if x is not None else b"" for x in least]
        return pd.DataFrame({"digest": digest, "n": [len(s) for s in sets], "keys": pd.Series(keys, dtype=object), "signature": signature})

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, BANDS * ROWS) for c in (a, b))
        return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    return sketch, alike


def sketch(text: Column) -> Column:
    """struct(digest, n, keys, signature): equal sets have equal digests, and digest and n of a blank text are 0."""
    return _udfs()[0](text)


MEMBERS = StructType([StructField("digest", LongType()), StructField("members", ArrayType(LongType()))])


def members(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(digest, members) of rows (text, digest): the whole shingle sets."""
    sets = [shingles(t.as_py()).view(np.int64) for t in rows.column(0)]
    ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
    return pa.RecordBatch.from_arrays([rows.column(1), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["digest", "members"])


def bands(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, x) of each band of nodes(digest, n, keys), and of the bands that two or more share (key, c, m, own).

    c is how many share it, m the text of the least digest, and own the one of the least hash of itself and the band.
    """
    k = common.materialize(nodes.select(F.struct(F.col("digest").alias("d"), "n").alias("x"), F.explode("keys").alias("key")), "bands")
    turn = F.struct(F.xxhash64("x.d", "key").alias("h"), "x")
    size = k.groupBy("key").agg(F.count("*").alias("c"), F.min("x").alias("m"), F.min(turn)["x"].alias("own")).where("c > 1")
    return k, common.materialize(size, "sizes")


def candidates(met: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of texts m and x, each (digest, size), that are near enough in size."""
    near = met.where("m.d <> x.d AND 5 * least(m.n, x.n) >= 4 * greatest(m.n, x.n)")
    return near.select(F.least("m.d", "x.d").alias("u"), F.greatest("m.d", "x.d").alias("v")).distinct()


def first_candidates(k: DataFrame, size: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of each text and the least text of each of its bands, near enough in size."""
    return candidates(k.join(size.select("key", "m"), "key"))


def more_candidates(k: DataFrame, size: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of all texts of a band that few share; and of each text of a crowded band and the band's own pivot.

    The bands that two texts share give them as many different pivots. What pivots leave apart is the matter of crowds().
    """
    few = k.join(size.where(F.col("c") <= PAIR_BUCKET).select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("f"))
    pairs = few.select(F.posexplode("f").alias("i", "m"), "f").select("m", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("x"))
    stars = k.join(size.where(F.col("c") > PAIR_BUCKET).select("key", F.col("own").alias("m")), "key").select("m", "x")
    return candidates(pairs.unionByName(stars))


#: Pairs of one text that are checked together.
SPLIT = 256


def _beside(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """pairs(u, v) with value_u and value_v of values(digest, value).

    A text met by very many others goes to the tasks in several copies, each for SPLIT of them about, so that no task
    gets all pairs of a text.
    """
    both = pairs
    for c, other in (("v", "u"), ("u", "v")):
        many = pairs.groupBy(F.col(c).alias("digest")).agg(F.ceil(F.count("*") / F.lit(SPLIT)).cast("int").alias("copies"))
        s = values.join(many, "digest").select(F.col("digest").alias(c), F.col(value).alias(f"{value}_{c}"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
        both = both.join(many.withColumnRenamed("digest", c), c).withColumn("part", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies").join(s, [c, "part"]).drop("part")
    return both


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that share LEAST_ALIKE of their MinHash values; far fewer meet whole sets then."""
    both = _beside(pairs, nodes.select("digest", "signature"), "signature")
    return common.materialize(both.where(_udfs()[1]("signature_u", "signature_v") >= LEAST_ALIKE).select("u", "v"), "alike")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets(digest, members) have a Jaccard similarity of 0.8 or more."""
    both = _beside(pairs, sets, "members")
    return both.where("9L * size(array_intersect(members_u, members_v)) >= 4L * (size(members_u) + size(members_v))").select("u", "v")


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, root) of all nodes: the least digest that links(u, v) lead to."""
    cc = common.connected_components(links)
    d = nodes.select("digest").join(cc, F.col("digest") == F.col("node"), "left")
    return common.materialize(d.select("digest", F.coalesce("component", "digest").alias("root")), "classes")


def merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """classes() after more links, which are followed from class to class: as many rows as join two classes, not as all links."""
    e = links
    for c in ("u", "v"):
        e = e.join(of.select(F.col("digest").alias(c), F.col("root").alias(f"of_{c}")), c)
    cc = common.connected_components(e.select(F.col("of_u").alias("u"), F.col("of_v").alias("v")).where("u <> v").distinct())
    d = of.join(cc, of["root"] == cc["node"], "left")
    return common.materialize(d.select("digest", F.coalesce("component", "root").alias("root")), "classes")


def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (u, v) of different classes."""
    for c in ("u", "v"):
        pairs = pairs.join(of.select(F.col("digest").alias(c), F.col("root").alias(f"of_{c}")), c)
    return common.materialize(pairs.where("of_u <> of_v").select("u", "v"), "rest")


def crowds(k: DataFrame, size: DataFrame, of: DataFrame) -> DataFrame:
    """(digest, root, crowd) of the texts of crowded bands whose texts are in several classes by of(digest, root) so far.

    A link that is still missing joins two texts of such a band. Bands that share a class are one crowd, so that a text is
    compared once and not once a band.
    """
    many = k.join(size.where(F.col("c") > PAIR_BUCKET).select("key"), "key").select("key", F.col("x.d").alias("digest")).join(of, "digest")
    open_ = many.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("key", F.col("a").alias("least"))
    mine = common.materialize(many.join(open_, "key").select("digest", "root", "least").distinct(), "crowds")
    cc = common.connected_components(mine.select(F.col("root").alias("u"), F.col("least").alias("v")).where("u <> v").distinct())
    return mine.select("digest", "root").distinct().join(cc, F.col("root") == F.col("node")).select("digest", "root", F.col("component").alias("crowd"))


def linked_within(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of similarity 0.8 or more that join the classes of some sets: as many as join them, not all.

    side is 0 and 1 for two blocks, of which one's sets are compared with the other's, or all 0 for one block. Shared
    shingles are counted by the sets that have them; a shingle that most sets have is counted by those that lack it, so
    that what all variants of a template have in common costs nothing.
    """
    c = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(c), n)
    _, element, times = np.unique(np.concatenate(sets) if c else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    usual = 2 * times > c
    have = np.zeros((c, int(usual.sum())), bool)
    number = np.cumsum(usual) - 1
    common_ = usual[element]
    have[of[common_], number[element[common_]]] = True
    lack_of, lack = np.nonzero(~have)
    lacking = np.bincount(lack_of, minlength=c)
    some = ~common_ & (times[element] > 1)
    who = np.concatenate([of[some], lack_of])
    what = np.concatenate([element[some], len(times) + lack])
    # the sets of each element, and the elements of each set
    _, what = np.unique(what, return_inverse=True)
    order = np.lexsort((who, what))
    posts = who[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(what, minlength=1))])
    by_set = np.lexsort((what, who))
    mine, start = what[by_set], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=c))])
    root, both = root.copy(), len(set(side.tolist())) > 1
    out = []
    for i in range(c):
        other = root != root[i]
        other[: i + 1] = False
        if both:
            other &= side != side[i]
        if not other.any():
            continue
        e = mine[start[i] : start[i + 1]]
        a, z = first[e], first[e + 1]
        sizes = z - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(e) else np.zeros(0, np.int64)
        shared = np.bincount(posts[at], minlength=c) + have.shape[1] - lacking[i] - lacking
        for j in np.flatnonzero(other & (9 * shared >= 4 * (n[i] + n))):
            if root[i] != root[j]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def crowd_links(members: DataFrame) -> DataFrame:
    """Links (u, v) within the crowds of members(digest, root, crowd, members), which join all of a crowd that is 0.8 alike.

    A crowd is cut into blocks by hash, of bounded shingles on average, and each two blocks meet in one task, which says
    only the links that join classes.
    """
    size = members.groupBy("crowd").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("members")) / F.lit(CROWD_BLOCK))).cast("int").alias("blocks"))
    d = members.join(size, "crowd").withColumn("b", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    d = d.select("crowd", "digest", "root", "members", "b", other).select("crowd", "digest", "root", "members", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        _, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        side = (pdf["b"] != pdf["i"]).to_numpy().astype(int)
        found = linked_within([np.asarray(m, np.int64) for m in pdf["members"]], root, side)
        digest = pdf["digest"].to_numpy()
        pairs = np.sort(np.array([(digest[i], digest[j]) for i, j in found], np.int64).reshape(-1, 2), axis=1)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return d.groupBy("crowd", "i", "j").applyInPandas(link, "u long, v long")
