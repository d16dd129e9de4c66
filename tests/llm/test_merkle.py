import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from conceptloom.llm import merkle, queries


def digest(values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def tree(leaves):
    """(root, siblings of each leaf as (side, digest)) of a list of digests."""
    siblings = [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            other = leaves[i ^ 1] if i ^ 1 < len(leaves) else ""
            siblings[k].append((i & 1, other))
            at[k] = i // 2
        leaves = [sha256("".join(leaves[i : i + 2]).encode()).hexdigest() for i in range(0, len(leaves), 2)]
    return leaves[0], siblings


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) to the rows of op12."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, digest(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs.append(tree([h for _, h in groups[g]]))
    root, crown = tree([r for r, _ in subs]) if subs else (None, [])
    out = []
    for g, (sub, paths), top in zip(order, subs, crown, strict=True):
        for (r, leaf), path in zip(groups[g], paths, strict=True):
            whole = path + top
            v = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                v = digest((*r[:3], r[3] + 1, r[4]))
            for side, h in whole:
                v = sha256((h + v if side else v + h).encode()).hexdigest()
            out.append((r[0], leaf, sub, root, sha256("".join(h for _, h in whole).encode()).hexdigest(), v, v == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, pos long, items int, path string, digest string, more int"
ROWS = [(i * 7 % 1009 - 3, f"s{i % 3}", "en", i, f"text {i}") for i in range(700)]
ROWS += [(i, None, "de", None if i % 5 == 0 else i, f"ä {i}") for i in range(40)]
ROWS += [(1, "s", None, 1, None), (None, "s", None, 2, "x"), (None, "s", None, 2, "x"), (5, "", "", 0, ""), (5, "", "", 2**63 - 1, "a:b"), (5, "", "", 0, "")]
ROWS += [(14, "one", "lonely", 3, "w " * 200_000), (21, "s", "ж", 1, "k"), (22, "s", "Z", 1, "k"), (23, "s", "-", 1, "k")]


@pytest.mark.parametrize("n", [0, 1, len(ROWS)])
def test_manifest(spark, tmp_path, n):
    """Two rounds of blocks, nulls, repeated ids and rows, groups of one row, names that clash with helper columns."""
    rows = ROWS[:n]
    spark.createDataFrame([(*r, "g", 1, 2, "p", "d", 3) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    if n > 1:
        assert 0 < sum(not r[-1] for r in got) < n


def test_other_columns(spark):
    """Any columns make a leaf, and a changed proof does not lead to the root."""
    d = spark.createDataFrame([("b", 1, 2.5), ("a", 1, None), ("c", 2, 0.0)], "k string, part int, x double")
    m = merkle.manifest(d, "k", "part", ("k", "x"), {"again": F.upper("k")}).cache()
    assert {r["k"]: r["again"] for r in m.collect()} == {"a": "A", "b": "B", "c": "C"}
    ends = m.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"), (merkle.fold(F.sha2("k", 256), F.col("path")) == F.col("root")).alias("other")).collect()
    assert all(r["own"] for r in ends) and not any(r["other"] for r in ends)
    assert m.where("k = 'a'").select("leaf").head()[0] == sha256(b"1:a-").hexdigest()
