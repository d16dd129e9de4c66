"""Packing as the sequential fold, whatever the ranges."""

import random

import numpy as np
import pytest

from conceptloom.operators import packing


def fold(lengths, budget, state=-1):
    packs, pack = [], 0
    for n in lengths:
        if state >= 0 and state + n <= budget:
            state += n
        else:
            state, pack = n, pack + 1
        packs.append(pack)
    return packs, state, pack


@pytest.mark.parametrize("seed", range(20))
def test_a_range_from_any_state(seed):
    rng = random.Random(seed)
    budget = rng.choice((0, 5, 20, 100))
    lengths = [rng.choice((0, 0, 1, 3, rng.randint(0, budget + 20))) for _ in range(rng.randint(1, 60))]
    if seed % 2:
        lengths.sort(reverse=True)
    a = np.array(lengths)
    total, first, packs, out = packing.summary(a, budget)
    for state in (-1, *range(budget + 4)):
        want, last, opened = fold(lengths, budget, state)
        assert packing.through(state, total, first, packs, out, budget) == (opened, last)
        assert packing.replay(a, state, budget).tolist() == want


@pytest.mark.parametrize("parts", [1, 7])
def test_packed(spark, parts):
    rng = random.Random(4)
    rows = [("hot", i, rng.choice((0, 3, 10, 50, 120))) for i in range(600)] + [("one", 1, 500), (None, 1, 5), (None, 2, None), ("neg", 1, -4), ("neg", 2, 100)]
    d = spark.createDataFrame(rows, "source string, id int, n int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got = packing.packed(d, ["source"], "n", ["id"], 100).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(((-max(0, n or 0), i) for s, i, n in rows if s == g))
        packs, _, _ = fold([-n for n, _ in own], 100)
        want |= {(g, i): p - 1 for (_, i), p in zip(own, packs, strict=True)}
    assert len(got) == len(rows) and {(r["source"], r["id"]): r["pack"] for r in got} == want
    assert packing.packed(d.limit(0), ["source"], "n", ["id"], 100).count() == 0
