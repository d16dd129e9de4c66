"""Plans whose rows, readings and tasks' memory grow with the tables and no faster."""

from pyspark.sql import functions as F

from conceptloom.operators import fusion, metrics, resample
from conceptloom.plans import adapters as A
from conceptloom.plans import queries as Q

from .conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fused_ranks_are_not_shuffled(spark):
    """F15, F16: mentions are dealt before they become ten ranks each."""
    for name in ("rank_fusion", "fused_recall"):
        p = plan(Q.QUERIES[name](spark, DATA))
        assert "Exchange hashpartitioning(doc_id" not in p[: p.index("Generate explode")], name


def test_fused_slices_read_what_is_fused_once(spark):
    """training, its counts and the tests read a table, not the order lines again."""
    assert "l_orderkey" not in plan(Q.QUERIES["fused_all_slices"](spark, DATA))


def test_fused_rows_equal_fused_runs(spark):
    runs = [(7, 3, 6), (11, 5, 4)]
    a = fusion.fuse_rows(A.ranked(spark, DATA, runs, swap=True, rich=True), 2)
    b = fusion.fuse([A.enriched(spark, DATA, a=x, b=y, c=z, swap=True) for x, y, z in runs])
    assert sorted(a.collect()) == sorted(b.collect())


def test_paths_are_not_on_every_row(spark):
    """a bucket has one row with its path, and documents are read from a table."""
    docs = spark.range(4000).selectExpr("CAST(id % 2000 AS STRING) AS doc_id", "CAST(id % 3 AS STRING) AS label", "1 AS num")
    d, levels, total = resample._prepared(docs, 256)
    assert (levels, total) == (3, 2000) and d.where("path IS NOT NULL").count() == 8 and d.count() == 4008
    assert "l_orderkey" not in plan(Q.QUERIES["bootstrap_ci"](spark, DATA))


def test_ranks_are_sorted_in_more_tasks_of_more_lines(spark, monkeypatch):
    """F17."""
    monkeypatch.setattr(A, "TASK_MENTIONS", 500)
    n = A.tasks(spark, DATA)
    p = plan(Q.QUERIES["prediction_names"](spark, DATA))
    assert n > 4 and f"ASC NULLS FIRST, {n})" in p and f"hashpartitioning(doc_id" in p and p.count("Exchange hashpartitioning") <= 2


def test_first_row_of_each_rank(spark):
    rows = [("d", "m", r, "c", p, s) for r, p, s in ((1, "b", 0.5), (1, "a", 0.5), (2, "x", None), (2, "y", 0.1), (1, "z", 0.4), (3, "q", 0.9))]
    d = spark.createDataFrame(rows, "doc_id string, mention_id string, rank int, gold_concept_code string, pred_concept_code string, score double")
    assert sorted((r["rank"], r["pred_concept_code"]) for r in metrics.load_predictions(d, 2).collect()) == [(1, "a"), (2, "y")]


def test_words_that_are_no_entity_make_no_rows(spark, tmp_path):
    """offsets and places of entities without a row a word; a word's end is a space or the end of the text."""
    texts = [(1, 0, "Alpha  beta Gamma Delta"), (1, 1, None), (1, 2, " Omega\n Zeta xEta Iota"), (2, 0, "")]
    spark.createDataFrame(texts, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    m = A.mentions(spark, str(tmp_path))
    got = sorted((r["start_span"], r["end_span"], r["mention"], r["entity_idx"]) for r in m.collect())
    assert got[:3] == [(0, 5, "Alpha", 0), (12, 17, "Gamma", 3), (18, 23, "Delta", 4)]
    assert [x[2:] for x in got[3:]] == [("Zeta", 2), ("Iota", 4)]
    assert "posexplode(split(" not in plan(m)


def test_all_at_5_tags_nothing(spark):
    """the slice of all ranks needs no slice of single predictions; order lines are read and dealt once."""
    p = plan(Q.QUERIES["slice_all_at_5"](spark, DATA))
    assert p.count("hashpartitioning(doc_id") == 1 and "repeat" not in p and p.count("FileScan") == 2


def test_paired_slices_read_lines_once(spark):
    """both runs come from one reading, and what meets training are counts of equal rows."""
    p = plan(A.paired(spark, DATA, (6, 8), swap=True))
    assert p.count("lineitem.parquet") == 1 and p.count("hashpartitioning(doc_id") == 1
    assert "l_orderkey" not in plan(Q.QUERIES["paired_delta_slices"](spark, DATA))


def test_counted_slices_equal_tagged_ones(spark):
    """counts of equal rows give the slices of the rows."""
    base, other = (A.enriched(spark, DATA, swap=True, c=c).where("rank = 1") for c in (8, 6))
    train, test = A.split_train(other)
    counts = metrics.counted(A.paired(spark, DATA, (6, 8), swap=True), {"hit": F.col("hit"), "hit_base": F.col("hit_base")}, A.in_training())
    want, got = metrics.paired_delta_slices(base, test, train), metrics.deltas_of_counts(counts)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_fused_slices_read_lines_once(spark):
    """what a mention has goes with its ranks, so that the lines are not read and dealt again for it."""
    top = fusion.fuse_rows(A.fusable(spark, DATA, Q.FUSED, swap=True), 2, keep=A.MENTION)
    p = plan(top)
    assert p.count("lineitem.parquet") == 1 and p.count("hashpartitioning(doc_id") == 1
    rows = fusion.fuse_rows(A.ranked(spark, DATA, Q.FUSED, swap=True, rich=True), 2)
    want = fusion.with_mentions(rows, A.enriched(spark, DATA, swap=True).where("rank = 1"), A.MENTION)
    assert sorted(map(str, top.select(want.columns).collect())) == sorted(map(str, want.collect()))
