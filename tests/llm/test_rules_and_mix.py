import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptloom.llm import common, mixing
from conceptloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, awkward):
    more = spark.createDataFrame([(1, "a b c d e f\na b c d e f\n\n a b c d e f"), (2, "x " * 50), (3, "1 2 3 4 5"), (4, "#*|<>$%&& a\n\na\nb"), (5, "a b c d e a b c d e")], "doc_id long, text string")
    for df in (awkward, more):
        for r in q.statistics(df).collect():
            got = tuple(r[f"__{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            assert got == brute(r["text"])
            assert r["__base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])


def test_rules_reject_outliers_only(spark):
    good = [(i, " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(40 + i % 60)), "en", "s") for i in range(400)]
    bad = [(1000 + i, " ".join(f"w%%%{(i * 3 + k * 7) % 991}***" for k in range(50)), "en", "s") for i in range(20)]
    out = q.rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()
    kept = {r["doc_id"]: r["__kept"] for r in out}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)


def test_rules_on_awkward_rows(spark, awkward):
    out = q.rules(awkward)
    assert out.count() == awkward.count() and out.where("__kept is null").count() == 0
    assert out.where("__base_failed and __kept").count() == 0
    assert q.rules(awkward.limit(0)).count() == 0


def test_native_plan(spark, awkward):
    stats = q.statistics(awkward)
    kept = common.materialize(stats, "statistics")
    for df in (stats, q.judge(kept, q.fit(kept))):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text


def shrunk(sums):
    """Means and regularised Cholesky factors of each group from {group: (n, s, q)}, by PRIOR documents of the level above."""
    every = [sum(x[k] for x in sums.values()) for k in range(3)]
    every = [every[1] / every[0], every[2] / every[0]] if every[0] else [np.zeros(4), np.zeros((4, 4))]
    out = {}
    for g, (n, s, c) in sums.items():
        lang = [sum(x[k] for h, x in sums.items() if h[0] == g[0]) for k in range(3)]
        m, e = (((lang[k + 1] + q.PRIOR * every[k]) / (lang[0] + q.PRIOR)) for k in range(2))
        m, e = (s + q.PRIOR * m) / (n + q.PRIOR), (c + q.PRIOR * e) / (n + q.PRIOR)
        cov, low = e - np.outer(m, m), np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                rest = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, 0) + q.FLOOR[i] ** 2) if i == j else rest / low[j, j]
        out[g] = m, low
    return out


def brute_distances(rows):
    """{number of a row: distance} of rows(group, vector) by the method, written with NumPy."""
    groups = {}
    for k, (g, v) in enumerate(rows):
        groups.setdefault(g, []).append((k, v))
    x = {g: np.array([v for _, v in r]) for g, r in groups.items()}
    sums = lambda on: {g: (on[g].sum(), (v[on[g]]).sum(0), v[on[g]].T @ v[on[g]]) for g, v in x.items()}
    far = lambda est: {g: (np.linalg.solve(est[g][1], (v - est[g][0]).T) ** 2).sum(0) for g, v in x.items()}

    def cut(d):
        cells = np.sort(np.floor(np.log2(np.maximum(d, 1e-6)) * 32))
        return 2 ** ((cells[int(np.ceil(q.CORE * len(cells))) - 1] + 1) / 32)

    at = lambda v, p: np.sort(v, 0)[max(0, int(np.ceil(p * len(v))) - 1)]
    first = {g: (at(v, 0.5), np.diag(np.sqrt(((at(v, 0.75) - at(v, 0.25)) / 1.349) ** 2 + np.array(q.FLOOR) ** 2))) for g, v in x.items()}
    runs = []
    for est in (first, shrunk(sums({g: np.ones(len(v), bool) for g, v in x.items()}))):
        for _ in range(q.STEPS):
            d = far(est)
            est = shrunk(sums({g: d[g] <= cut(d[g]) for g in x}))
        d = far(est)
        runs.append({g: (np.log(np.diag(est[g][1])).sum(), d[g] / max(cut(d[g]) / q.CHI_CORE, 1)) for g in x})
    return {k: d for g, r in groups.items() for (k, _), d in zip(r, min((run[g] for run in runs), key=lambda y: y[0])[1], strict=True)}


def test_kept_by_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(700):
        lang, source = ("en", "de", None)[k % 3], ("a", "b", "c", None)[min(3, k % 17)]
        w = ["w" * int(r.integers(2, 9)) + str(r.integers(0, 10**6)) + ("%#" * int(r.integers(1, 5)) if k % 20 == 0 else "") for _ in range(int(r.integers(12, 90)))]
        rows.append((k, " ".join(w) + ("\nsame line\nsame line" if k % 9 == 0 else ""), lang, source))
    out = q.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    fair = [x for x in out if not x["__base_failed"]]
    share = lambda a, b: np.sqrt(a / b)
    vec = [((x["lang"], x["source"]), [np.log(x["__word_chars"] / x["__n_words"]), share(x["__n_symbols"], x["__n_words"]), share(x["__n_dup_lines"], np.sqrt(x["__n_words"])), share(x["__n_repeat_words"], x["__n_words"])]) for x in fair]
    want = brute_distances(vec)
    for k, x in enumerate(fair):
        assert x["__distance"] == pytest.approx(want[k], rel=1e-6, abs=1e-9)
        assert x["__kept"] == (want[k] <= q.CUT)
    assert any(not x["__kept"] for x in fair) and sum(x["__kept"] for x in fair) > 600
    assert not any(x["__kept"] for x in out if x["__base_failed"])


def fill(sizes, weights, mix=1.5, cap=2.0):
    """Water filling by repeated resharing."""
    want, left, out = mix * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        level = (want - sum(out[i] for i in range(len(sizes)) if i not in left)) / sum(weights[i] for i in left)
        over = [i for i in left if weights[i] * level > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = weights[i] * level
            break
        for i in over:
            out[i] = cap * sizes[i]
            left.discard(i)
    return out


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 40, None: 300, "Z": 0}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])
    assert [got[s] for s in order] == pytest.approx(want)


def test_flight_keeps_sums():
    n = 500
    size = [float(1 + (i * i) % 97) for i in range(n)]
    pi = mixing.flight([0.3] * n, size, "s")
    assert sum(0 < p < 1 for p in pi) <= 2
    assert sum(pi) == pytest.approx(0.3 * n) and sum(p * s for p, s in zip(pi, size, strict=True)) == pytest.approx(0.3 * sum(size))
    assert set(mixing.landing(pi, size, "s")) <= {0.0, 1.0}


def test_inclusion_is_unbiased():
    runs = [mixing.landing(mixing.flight([0.4] * 9, [float(k + 1) for k in range(9)], r), [float(k + 1) for k in range(9)], r) for r in range(2000)]
    for k in range(9):
        assert sum(r[k] for r in runs) / 2000 == pytest.approx(0.4, abs=0.05)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (5 + (i * 37) % 90)), f"s{min(i % 7, 3)}") for i in range(3000)] + [(None, None, None), (7, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    a = mixing.mix(docs, block=64).drop("__tie").collect()
    assert len(a) == len(rows) and sorted(map(str, a)) == sorted(map(str, mixing.mix(docs.repartition(3), block=64).drop("__tie").collect()))
    by = {}
    for r in a:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(taken - target) <= 200 for taken, target in by.values())
    taken = mixing.take(docs, block=64)
    assert taken.columns == ["doc_id", "text", "source", "copy"]
    assert taken.count() == sum(r["copies"] for r in a)


def test_mix_awkward(spark, awkward):
    assert mixing.mix(awkward).count() == awkward.count()
    with pytest.raises(ValueError, match="copy"):
        mixing.take(awkward, copy_col="copy")
    assert mixing.take(awkward).columns == [*awkward.columns, "copy_2"] and mixing.take(awkward, copy_col="n").columns[-1] == "n"
    plain = awkward.drop("copy")
    taken = mixing.take(plain)
    assert taken.columns == [*plain.columns, "copy"]
    own = Counter(r for r in (tuple(x) for x in plain.collect()))
    got = Counter(tuple(x)[:-1] for x in taken.collect())
    assert got.keys() <= own.keys() and all(got[r] <= 2 * own[r] for r in got)
    planned = sum(r["copies"] for r in mixing.mix(plain).collect())
    assert sum(got.values()) == planned
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.take(plain.limit(0)).count() == 0


def test_ids_beyond_doubles_beside_null(spark):
    rows = [(2**53 + 1 + 2 * i, "a b c", "s") for i in range(50)] + [(None, "a b", "s")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}


def test_attach(spark):
    docs, address = common.addressed(spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, repeat('x', int(id % 50))) AS text", "id AS __r_"))
    again, same = common.addressed(docs)
    assert again is docs
    table = docs.select("id", *address).where("id % 3 = 1").withColumnRenamed("id", "__id")
    got = common.attach(docs, table, "t").collect()
    assert sorted(r["id"] for r in got) == [i for i in range(5000) if i % 3 == 1]
    assert all(r["id"] == r["__id"] == r["__r_"] and r["text"] == (None if r["id"] % 7 == 0 else "x" * (r["id"] % 50)) for r in got)
    assert common.attach(docs, table.limit(0), "t").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200


def test_one_row_met_very_often(spark):
    rows = [(1, "a b c d", "s")] * 300 + [(i, "a b " * (i % 9), "t") for i in range(2, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, block=16).collect()
    by = {}
    for r in out:
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert len(out) == len(rows) and all(abs(a - b) <= 16 for a, b in by.values())


def test_statistics_among_clashing_names(spark, awkward):
    """Columns named like the helpers keep their values; columns named like the results are refused."""
    d = awkward.withColumns({"__w": F.lit(1), "__h": F.lit("h"), "__s": F.lit(2.5), "__lines": F.lit(None), "__again": F.lit(True)})
    stats = q.statistics(d)
    plain = q.statistics(awkward)
    names = [c for c in plain.columns if c.startswith("__")]
    assert stats.columns == [*d.columns, *names]
    assert sorted(map(repr, stats.select(*awkward.columns, *names).collect())) == sorted(map(repr, plain.collect()))
    assert {tuple(r) for r in stats.select("__w", "__h", "__s", "__again").collect()} == {(1, "h", 2.5, True)}
    with pytest.raises(ValueError):
        q.statistics(d.withColumn("__n_words", F.lit(1)))
