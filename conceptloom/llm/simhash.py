"""Near-duplicate classes by SimHash fingerprints, searched with Golay codewords.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Fingerprints at most two bits apart agree wholly in
one segment at least, and differ in two bits at most in the segment after it. The perfect Golay code (23, 12, 7) gives
every 23-bit word the indices of the codewords that it or a word one bit from it decodes to: one index for words within
two bits of a codeword, six for the others. Two words at most two bits apart have a word one bit from both, so they
share an index. A key is (segment number, that segment, an index of the next segment): 3 to 18 keys a fingerprint.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, minhash

CUTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Buckets up to this many fingerprints are compared pair by pair; larger ones meet at words one bit away.
PAIR_BUCKET = 32


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of at most three bits of each syndrome."""

    def rest(w: int) -> int:
        for k in range(22, 10, -1):
            if w >> k & 1:
                w ^= GOLAY << (k - 11)
        return w

    unit = [rest(1 << k) for k in range(23)]
    low, high = np.zeros(4096, np.int64), np.zeros(2048, np.int64)
    for k in range(12):
        low[np.arange(4096) >> k & 1 == 1] ^= unit[k]
    for k in range(11):
        high[np.arange(2048) >> k & 1 == 1] ^= unit[12 + k]
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return low, high, error


def golay_index(w: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    low, high, error = _golay()
    return (w ^ error[low[w & 0xFFF] ^ high[w >> 12]]) >> 11


def golay_keys(w: np.ndarray) -> np.ndarray:
    """A row for each word: the indices of the word and of its 23 neighbours; repeats are -1."""
    flips = np.array([0, *(1 << k for k in range(23))], np.int64)
    keys = np.sort(golay_index(w[:, None] ^ flips), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def fingerprint_keys(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.astype(np.int64).view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in CUTS]
    parts = []
    for i in range(3):
        g = golay_keys(seg[(i + 1) % 3])
        parts.append(np.where(g < 0, -1, (i << 34) | (seg[i][:, None] << 12) | g))
    keys = np.concatenate(parts, axis=1)
    return [row[row >= 0] for row in keys]


def simhash(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    join = b" ".join
    for at in range(0, n, 1 << 15):
        some = np.array([h(join(w[i : i + shingle]), 42) for i in range(at, min(n, at + (1 << 15)))], np.uint64)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@functools.cache
def _udfs():
    @F.pandas_udf("long")
    def fingerprint(text: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in text], dtype="int64")

    @F.pandas_udf("array<long>")
    def keys(fp: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_keys(fp.to_numpy(np.int64)), dtype=object)

    @F.pandas_udf("long")
    def wide_fingerprint(text: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, minhash.SHINGLE) for t in text], dtype="int64")

    return fingerprint, keys, wide_fingerprint


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (u, v) that connect all distinct fingerprints fp at most two bits apart.

    Buckets of few fingerprints are compared pair by pair. The fingerprints of a larger bucket are each sent to the 65
    words at most one bit away: two meet at a word exactly if they are at most two bits apart, and each is linked to the
    least that meets there. Work and rows stay in proportion to the fingerprints, and every connection is kept.
    """
    if bits != 2:
        raise ValueError("the keys are built for two bits")
    keys = _udfs()[1]
    every = common.materialize(fps.select("fp", F.explode(keys("fp")).alias("key")), "golay")
    size = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    k = common.materialize(every.join(size, "key"), "golay")
    common.release(every)
    few = k.where(F.col("n") <= PAIR_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("f"))
    pairs = (
        few.select(F.posexplode("f").alias("i", "u"), "f")
        .select("u", F.explode(F.expr("filter(slice(f, i + 2, size(f)), x -> bit_count(x ^ u) <= 2)")).alias("v"))
        .distinct()
    )
    flips = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    crowd = k.where(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    met = crowd.select("fp", F.explode(flips).alias("e")).select("fp", F.col("fp").bitwiseXOR(F.col("e")).alias("w"))
    first = met.groupBy("w").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
    stars = met.join(first.select("w", "m"), "w").where("fp <> m").select(F.col("m").alias("u"), F.col("fp").alias("v")).distinct()
    return pairs.unionByName(stars)


def with_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a last column __fp; null and blank texts have fingerprint zero."""
    common.bounded_batches(docs.sparkSession)
    fingerprint = _udfs()[0]
    return docs.select(*(docs[c] for c in docs.columns), fingerprint(docs[text_col]).alias("__fp"))


def components(fps: DataFrame) -> DataFrame:
    """(fp, __component) of a table of (fp, first): the least first over all fingerprints reachable by links."""
    cc = connected(links(fps))
    of = fps.join(cc, fps["fp"] == cc["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    of = common.materialize(of, "components")
    least = of.groupBy("root").agg(F.min("first").alias("__component"))
    return of.join(least, "root").select("fp", "root", "__component")


connected = common.connected_components


def near_duplicates(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows of a table with __fp (see with_fingerprints) and a last column __component.

    __component is the smallest id reachable over links, the row's own included; null ids count only where a component
    has no other. Rows are never dropped; repeated rows get equal values; an empty table stays empty. Drop the text
    before, if it is not needed after: what is given here is written to the shared folder and shuffled once.
    """
    given = common.materialize(marked, "fingerprints")
    fps = common.materialize(given.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("first")), "fps")
    of = components(fps).select(F.col("fp").alias("__fp"), "__component")
    return given.join(of, "__fp").select(*(given[c] for c in marked.columns), of["__component"])


def fingerprint_candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of nodes(digest, n, fp) whose fingerprints are linked, near enough in size.

    Of a fingerprint's texts each meets the least, and the least ones of two linked fingerprints meet.
    """
    x = F.struct(F.col("digest").alias("d"), "n")
    some = nodes.where("n > 0").select("fp", x.alias("x"))
    least = common.materialize(some.groupBy("fp").agg(F.min("x").alias("m"), F.count("*").alias("c")), "fps")
    same = some.join(least.where("c > 1").select("fp", "m"), "fp").select("m", "x")
    e = links(least.select("fp"))
    e = e.join(least.select(F.col("fp").alias("u"), "m"), "u").join(least.select(F.col("fp").alias("v"), F.col("m").alias("x")), "v").select("m", "x")
    return minhash.candidates(same.unionByName(e))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class: a row of the smallest id, null ids last.

    Classes are the components of pairs whose five-word shingles have a Jaccard similarity of 0.8 or more. SimHash
    fingerprints of the five-word shingles are linked first, as op2's are; at 0.8 many pairs differ in more than two bits,
    so texts that this leaves apart meet by bands of MinHash values (see minhash). All candidates are checked on their
    whole shingle sets. The row is picked by a grouped minimum over narrow rows, so that a class is never
    gathered; texts are scanned where they are and never shuffled. Only one of wholly equal rows stays; texts without a
    word are one class; an empty table stays empty. Columns keep their names and values.
    """
    common.bounded_batches(docs.sparkSession)
    docs, address = common.addressed(docs)
    slim = docs.select(minhash.sketch(docs[text_col]).alias("__s"), _udfs()[2](docs[text_col]).alias("fp"), docs[id_col].alias("id"), *address)
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), *common.ADDRESS).alias("o")
    slim = common.materialize(slim.select("__s.*", "fp", order), "sketches")
    first = [F.first(c).alias(c) for c in ("n", "keys", "signature")]
    nodes = common.materialize(slim.groupBy("digest").agg(F.min("o").alias("o"), F.min("fp").alias("fp"), *first), "nodes")
    common.release(slim)
    k, size = minhash.bands(nodes)

    def with_sets(asked: DataFrame) -> DataFrame:
        """The whole shingle sets of asked(digest, ...), from the texts where they are."""
        where = nodes.join(asked, "digest").select(F.col("digest").alias("__digest"), *(F.col(f"o.{c}").alias(c) for c in common.ADDRESS))
        return common.materialize(common.attach(docs, where, "asked", [text_col], (minhash.MEMBERS, minhash.members)), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = minhash.alike(pairs, nodes)
        sets = with_sets(pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct())
        links = common.materialize(minhash.verified(pairs, sets), "links")
        common.release(sets)
        return links

    # most classes hang together by fingerprints and by the least text of a band, which are checked at once: each round of checks
    # and classes costs the driver dozens of plans, whatever the rows
    of = minhash.classes(nodes, checked(fingerprint_candidates(nodes).unionByName(minhash.first_candidates(k, size)).distinct()))
    common.trim(docs.sparkSession)
    of = minhash.merged(of, checked(minhash.apart(minhash.more_candidates(k, size), of)))
    common.trim(docs.sparkSession)
    crowds = common.materialize(minhash.crowds(k, size, of), "open")
    common.release(k)
    if not crowds.isEmpty():
        sets = with_sets(crowds.select("digest"))
        links = common.materialize(minhash.crowd_links(crowds.join(sets, "digest")), "links")
        common.release(sets)
        of = minhash.merged(of, links)
    best = nodes.select("digest", "o").join(of, "digest").groupBy("root").agg(F.min("o").alias("o")).select(*(F.col(f"o.{c}").alias(c) for c in common.ADDRESS))
    return common.attach(docs, best, "kept")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
