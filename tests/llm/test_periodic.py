import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from conceptloom.llm import periodic, queries

from ..conftest import DATA


def brute(w, least, power):
    """All (start, length, period): every stretch of equal words p apart, under its least period."""
    found, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(2 * p, power * p, least):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, size, p) for (s, size), p in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def random_words(seed):
    rng = random.Random(seed)
    kind = seed % 5
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    if kind == 1:
        return [rng.choice("abc") for _ in range(rng.randint(1, 120))]
    if kind == 2:
        part = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        return [*"xy", *(part * rng.randint(2, 9))[rng.randint(0, 3) :], *"yxb", *part * 3]
    if kind == 3:
        part = random_words(seed // 5 * 5)
        return part + ["|"] + part + part[: len(part) // 2] + part
    return list(fibonacci(rng.randint(1, 150)))


@pytest.mark.parametrize(("least", "power"), [(2, 2), (6, 4), (5, 3)])
def test_against_brute_force(least, power):
    words = [random_words(seed) for seed in range(400)] + [[], ["a"], ["a"] * 500, list("ab" * 300 + "a"), [str(i) for i in range(50)]]
    coded = [[x.encode() for x in w] for w in words]
    inside = 0
    for w, r in zip(words, periodic.documents(coded, least, power), strict=True):
        want = brute(w, least, power)
        assert [tuple(x) for x in r.tolist()] == want, w
        inside += len(want)
    assert inside > 100


def test_previous_factors_and_blocks():
    for seed in range(60):
        w = random_words(seed)
        s = np.array([ord(c) for c in w] + [0])
        x = periodic.Suffixes(s.copy())
        assert x.order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        length, source = periodic.previous_factors(x)

        def same(i, j, s=s):
            k = 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            return k

        for i in range(len(s)):
            assert length[i] == max((same(i, j) for j in range(i)), default=0)
            assert not length[i] or source[i] < i and same(i, source[i]) >= length[i]
        starts = periodic.blocks(length)
        assert starts[-1] == len(s) and all(e - b == max(1, length[b]) for b, e in zip(starts, starts[1:], strict=False))


def test_inner_runs_are_copies():
    """Runs that meet no border of blocks come from copying alone."""
    w = [*"pqaabaabr", *"qaabaabr", *"pqaabaabrz"]
    s = np.array([ord(c) for c in w] + [0])
    x = periodic.Suffixes(s)
    length, source = periodic.previous_factors(x)
    starts = periodic.blocks(length)
    met = periodic.at_borders(s, x, np.array(starts), 2, 2)
    more = periodic.copied(met, starts, source, 2)
    assert more and sorted([*map(tuple, met.tolist()), *more], key=lambda r: (r[0], r[2])) == sorted(brute(w, 2, 2), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = sorted(brute(w, 6, 4), key=lambda r: (r[0], r[2]))
    drop = {k for s, size, p in runs for k in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: sha256(b).hexdigest()
    rest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *rest, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r["text"] or "") < 40_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    want = [expected(*d) for d in docs]
    assert len(docs) > 150 and any(r[1] for r in want)
    assert [got[r[0]] for r in want] == want


def test_awkward_rows(spark, tmp_path):
    rows = [(i, " ".join(random_words(i))) for i in range(120)] + [(10, None), (11, ""), (12, " \t\r\n"), (None, "a a a a a a"), (None, None), (3, "x  y\tx y\nx y x y"), (3, "x  y\tx y\nx y x y")]
    rows += [(i, "\xa0 b\x85 b\x85 b\x85 b\x85 b\x85 b\x85 \x1c") for i in range(30)]
    spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, runs int, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(*r)) for r in rows)


def test_long_and_small_parts(spark, awkward, monkeypatch):
    """A long periodic text; documents that are worked on in small groups; borders tried a few at a time."""
    monkeypatch.setattr(periodic, "TOGETHER", 50)
    monkeypatch.setattr(periodic, "AT_ONCE", 7)
    words = [[x.encode() for x in random_words(s)] for s in range(40)]
    texts = [b" ".join(w).decode() for w in words]
    out = periodic._batch(texts, 2, 2).to_pylist()
    assert [[tuple(r.values()) for r in d["runs"]] for d in out] == [brute(w, 2, 2) for w in words]
    monkeypatch.undo()
    r = periodic.documents([[b"%d" % (i % 7_001) for i in range(200_000)]], 6, 4)[0]
    assert r.tolist() == [[0, 200_000, 7_001]]
    d = periodic.find(awkward)
    assert d.count() == awkward.count() and d.columns == [*awkward.columns, "__periodic"] and periodic.find(awkward.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(d)
