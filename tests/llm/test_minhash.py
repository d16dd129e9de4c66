import random

import numpy as np
import pytest

from conceptloom.llm import minhash, simhash

WORDS = [f"w{i}" for i in range(5000)]


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def edited(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(WORDS)
    return w


def test_keep_one_as_brute_force(spark):
    """Lightly edited copies go, at 0.8 or more over all pairs; looser ones stay. Bits of op2 would keep nearly all."""
    rng = random.Random(8)
    texts = []
    for k in range(60):
        w = rng.choices(WORDS, k=rng.choice((100, 200, 400)))
        texts += [" ".join(w), " ".join(edited(rng, w, k % 8 + 1))]
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for i, j in pairs:
        root[max(i, j)] = min(i, j)
    assert 20 < len(pairs) < 60
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {i for i, r in enumerate(root) if i == r}


def test_large_family(spark):
    """More near copies in a band than are compared pair by pair, and one hot exact copy."""
    rng = random.Random(9)
    w = rng.choices(WORDS, k=300)
    texts = [" ".join(edited(rng, w, 2)) for _ in range(80)] + [" ".join(w)] * 40 + [" ".join(rng.choices(WORDS, k=300)) for _ in range(20)]
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [0, *range(120, 140)]


def test_short_and_blank():
    assert len(minhash.shingles(None)) == len(minhash.shingles(" \t")) == 0
    assert len(minhash.shingles("a b")) == 1 and (minhash.shingles("a b") != minhash.shingles("b a")).all()
    assert len(minhash.shingles("A b c d e f")) == 2 and (minhash.shingles("A b c d e f") == minhash.shingles("a  b c d e\nf")).all()


def test_crowd_at_the_threshold(spark):
    """Texts of one template, about 0.8 alike, in bands far over PAIR_BUCKET: classes as by brute force."""
    rng = random.Random(11)
    w = rng.choices(WORDS, k=120)
    texts = [" ".join(edited(rng, w, rng.choice((1, 1, 2, 2, 3)))) for _ in range(150)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [i for i in range(len(texts)) if top(i) == i]


def removed(texts):
    """How many of texts a row of each class leaves over, by all pairs."""
    sets = [minhash.shingles(t) for t in texts]
    number = {x: k for k, x in enumerate(sorted({x for s in sets for x in s.tolist()}))}
    has = np.zeros((len(texts), len(number)), np.float32)
    for k, s in enumerate(sets):
        has[k, [number[x] for x in s.tolist()]] = 1
    n = has.sum(axis=1)
    shared = has @ has.T
    u, v = np.nonzero(np.triu(9 * shared >= 4 * (n[:, None] + n[None, :]), 1))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return {i for i in range(len(texts)) if top(i) != i}, len(u)


def template(seed, n, words, replaced):
    rng = random.Random(seed)
    w = rng.choices(WORDS, k=words)
    return [" ".join(edited(rng, w, replaced)) for _ in range(n)]


@pytest.mark.parametrize(("n", "words", "replaced"), [(1000, 300, 4), (1000, 300, 5), (2000, 300, 5), (2000, 150, 3)])
def test_crowds_as_brute_force(spark, n, words, replaced):
    """Many variants of one template of which few are 0.8 alike: no class is missed."""
    texts = template(n + words + replaced, n, words, replaced)
    gone, pairs = removed(texts)
    assert pairs > 100
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(range(n)) - kept == gone


@pytest.mark.parametrize("seed", range(5))
def test_blocks_of_a_crowd(seed):
    """Links over one block and over two, with classes that are joined already."""
    texts = template(seed, 60, 60, 1 + seed % 2) + template(seed + 90, 30, 40, 1) + [""] + ["one two", "one two", "x"]
    sets = [minhash.shingles(t).view(np.int64) for t in texts]
    c = len(sets)
    alike = {(i, j) for j in range(c) for i in range(j) if len(sets[i]) + len(sets[j]) and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    rng = np.random.default_rng(seed)
    for side in (np.zeros(c, int), rng.integers(0, 2, c)):
        for root in (np.arange(c), rng.integers(0, 40, c)):
            found = minhash.linked_within(sets, root, side)
            may = {(i, j) for i, j in alike if not side.any() or side[i] != side[j]}
            assert all((i, j) in may and root[i] != root[j] for i, j in found)

            def classes(links, root=root):
                of = root.copy()
                for i, j in links:
                    of[of == of[j]] = of[i]
                return {frozenset(np.flatnonzero(of == x).tolist()) for x in set(of.tolist())}

            assert classes(found) == classes(may) and len(found) == len(classes([])) - len(classes(may))


def test_a_crowd_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD_BLOCK", 8_000)
    texts = template(5, 300, 120, 3)
    gone, pairs = removed(texts)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert pairs and set(range(300)) - kept == gone


def test_attach_over_several_files_and_pieces(spark, tmp_path, monkeypatch):
    """Every row that is asked for is found, wherever it stands in a batch, and what is made of it is its own."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    import pyarrow as pa

    from conceptloom.llm import common

    monkeypatch.setattr(common, "CHUNK_BITS", 3)
    spark.range(300).select("id", F.concat(F.lit("t"), "id").alias("text")).repartition(5).write.parquet(str(tmp_path / "d"))
    docs, address = common.addressed(spark.read.parquet(str(tmp_path / "d")))
    asked = docs.select("id", *address).where("id % 3 = 0").select(F.col("id").alias("want"), *common.ADDRESS)
    assert sorted((r["text"], r["want"]) for r in common.attach(docs, asked, "a", ["text"]).collect()) == sorted((f"t{i}", i) for i in range(0, 300, 3))
    schema = StructType([StructField("want", LongType()), StructField("twice", StringType())])

    def make(b):
        return pa.RecordBatch.from_arrays([b.column(1), pa.array([2 * t.as_py() for t in b.column(0)])], names=["want", "twice"])

    got = common.attach(docs, asked, "b", ["text"], (schema, make)).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"t{i}t{i}") for i in range(0, 300, 3)]
