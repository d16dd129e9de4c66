"""Multinomial resampling: exact draws, intervals as NumPy's, all documents and replicates."""

import numpy as np
import pytest

from conceptloom.operators import resample
from conceptloom.plans import queries as Q


def per_doc(spark, n=700):
    rows = [(str(i), "g" if i % 3 else None, i % 4, 4) for i in range(n)] + [(str(i), "h", i // 2 % 2, 1) for i in range(0, n, 2)] + [(None, "g", 1, 2), (None, "h", 0, 1)]
    return spark.createDataFrame(rows, "doc_id string, semantic_group string, num int, den int")


@pytest.mark.parametrize("bucket", [1, 16, 10_000])
def test_every_replicate_draws_as_many_as_documents(spark, bucket):
    got = {r["doc_id"]: r["w"] for r in resample.multinomial_weights(per_doc(spark), 200, bucket_docs=bucket).collect()}
    assert len(got) == 701 and None in got
    w = np.array(list(got.values()))
    assert (w.sum(axis=0) == 701).all()
    # moments of a multinomial: counts have mean 1 and variance 1 - 1/n, two of them a covariance of -1/n
    assert abs(w.mean(axis=1).std() - np.sqrt(1 / 200)) < 0.01 and abs(w.var(axis=1).mean() - 1) < 0.03
    assert abs(np.bincount(w.ravel(), minlength=9)[:4] / w.size - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 0.01


def test_same_draws_whatever_the_partitions(spark):
    a = {r["doc_id"]: r["w"] for r in resample.multinomial_weights(per_doc(spark), 20, bucket_docs=16).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    b = {r["doc_id"]: r["w"] for r in resample.multinomial_weights(per_doc(spark).orderBy("num"), 20, bucket_docs=16).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    c = {r["doc_id"]: r["w"] for r in resample.multinomial_weights(per_doc(spark), 20, seed=7, bucket_docs=16).collect()}
    assert a == b != c


def test_intervals_from_the_weights(spark):
    """Sums made in the tasks are those of the weights, and the interval is NumPy's up to its error over replicates."""
    per = per_doc(spark)
    got = {r["semantic_group"]: (r["low"], r["high"]) for r in resample.bootstrap_ci(per, bucket_docs=64).collect()}
    weights = {r["doc_id"]: np.array(r["w"]) for r in resample.multinomial_weights(per, bucket_docs=64).collect()}
    rows = [tuple(r) for r in per.collect()]
    docs = sorted(weights, key=str)
    free = np.random.default_rng(1).multinomial(len(docs), np.full(len(docs), 1 / len(docs)), size=4000).T
    for g in (None, "g", "h", "overall"):
        mine = [r for r in rows if g == "overall" or r[1] == g]
        ratio = lambda w, mine=mine: sum(w[r[0]] * r[2] for r in mine) / sum(w[r[0]] * r[3] for r in mine)
        assert got[g] == pytest.approx(tuple(np.quantile(ratio(weights), [0.025, 0.975])))
        other = np.quantile(ratio(dict(zip(docs, free, strict=True))), [0.025, 0.975])
        assert np.abs(np.array(got[g]) - other).max() < 0.15 * (other[1] - other[0])


def test_no_documents(spark):
    assert resample.bootstrap_ci(per_doc(spark).limit(0)).count() == 0 and resample.multinomial_weights(per_doc(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap_delta"])
def test_documents_of_any_id_count(spark, monkeypatch, name):
    """Ids from 3,000 up and all 1,000 replicates reach the intervals."""
    a = spark.createDataFrame([(str(i), "m", "g", "x", "x" if i < 3000 else "y", 1) for i in range(2990, 3400)], "doc_id string, mention_id string, semantic_group string, gold_concept_code string, pred_concept_code string, rank int")
    b = a.withColumn("pred_concept_code", Q.F.lit("x"))
    monkeypatch.setattr(Q.A, "predictions", lambda s, d, **k: b if k.get("c") == 8 else a)
    got = {r["semantic_group"]: (r["low"], r["high"]) for r in Q.QUERIES[name](spark, "").collect()}
    w = {r["doc_id"]: np.array(r["w"]) for r in resample.multinomial_weights(a).collect()}
    hit = [i for i in range(2990, 3400) if (i < 3000) == (name == "bootstrap_ci")]
    assert got["g"] == pytest.approx(tuple(np.quantile(sum(w[str(i)] for i in hit) / sum(w.values()), [0.025, 0.975])))
