import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from conceptloom.llm import minhash, simhash


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """Least id of each component, over all pairs."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_code():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 3000)
    low, high, error = simhash._golay()
    e = error[low[w & 0xFFF] ^ high[w >> 12]]
    assert all(int(x).bit_count() <= 3 for x in e)
    code = w ^ e
    assert not (low[code & 0xFFF] ^ high[code >> 12]).any()
    counts = (simhash.golay_keys(w) >= 0).sum(axis=1)
    assert set(counts) == {1, 6}


def test_words_two_bits_apart_share_a_key():
    rng = random.Random(3)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.choice((0, 1, 2))):
            b ^= 1 << k
        ka, kb = simhash.fingerprint_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(ka) & set(kb)


def test_awkward_rows(spark, awkward):
    out = simhash.near_duplicates(simhash.with_fingerprints(awkward).select("doc_id", "text", "fingerprint", "key", "__fp")).collect()
    assert len(out) == awkward.count()
    fps = {}
    for n, r in enumerate(out):
        assert r["__fp"] % (1 << 64) == brute_fingerprint(r["text"])
        assert r["fingerprint"] == "x" and r["key"] == "k"
        fps[n] = r["__fp"] % (1 << 64)
    for n, c in brute_components(fps).items():
        same = [out[m]["doc_id"] for m in fps if brute_components(fps)[m] == c and out[m]["doc_id"] is not None]
        assert out[n]["__component"] == min(same, default=None)
        break
    parts = brute_components(fps)
    for n, r in enumerate(out):
        assert r["__component"] == min((out[m]["doc_id"] for m in fps if parts[m] == parts[n] and out[m]["doc_id"] is not None), default=None)


def test_large_buckets_lose_no_link(spark):
    """A chain and a cloud of fingerprints that share keys, larger than the pair limit."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {rng.getrandbits(64) for _ in range(200)}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(table)
    assert edges.where("bit_count(u ^ v) > 2 or u = v").count() == 0
    ids = {f: n for n, f in enumerate(sorted(fps))}
    got = {r["fp"] % (1 << 64): r["root"] for r in simhash.components(table.withColumn("first", F.lit(1))).collect()}
    want = brute_components({n: f for f, n in ids.items()})
    groups = {}
    for f, n in ids.items():
        groups.setdefault(want[n], set()).add(got[f])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_one(spark, awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    texts = [r["text"] for r in rows]
    assert sum(t in (None, "", " \t\n") for t in texts) == 1
    assert [r["doc_id"] for r in rows].count(100) == 1 and 101 not in [r["doc_id"] for r in rows]
    assert simhash.keep_one(awkward.limit(0)).count() == 0


def test_fingerprints_join_texts_of_the_pipeline(spark, monkeypatch):
    """The stage links SimHash fingerprints, and keeps of their links those of similarity 0.8 or more: also without bands."""
    import random

    from conceptloom.llm import minhash

    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=600)
    other = next(" ".join(o) for o in ([*base[:k], "other", *base[k + 1 :]] for k in range(300)) if (simhash.simhash(" ".join(o), 5) ^ simhash.simhash(" ".join(base), 5)).bit_count() <= 2)
    far = " ".join(rng.choices(words, k=600))
    docs = spark.createDataFrame([(1, " ".join(base)), (2, other), (3, far), (4, " ".join(base)), (5, ""), (6, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(minhash, "first_candidates", lambda k, size: none)
    monkeypatch.setattr(minhash, "more_candidates", lambda k, size: none)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 5]


def test_fingerprints_and_bands_are_checked_at_once(spark, monkeypatch):
    """Three rounds of checks and classes filled the driver's memory: two do."""
    rounds = []
    verified = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda *a: rounds.append(1) or verified(*a))
    same = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, same), (2, same + " more"), (3, "another text of a few words"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 4] and len(rounds) == 2
