"""Streams with late, repeated, expired rows, restarts and windows."""

from datetime import datetime, timedelta

import pytest

from conceptloom.streaming import memory, ordered

START = datetime(2024, 1, 1)
SCHEMA = "doc_id string, mention_order long, target string, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ordered.PROVIDER)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def row(doc, order, minute, target=None):
    return (doc, order, f"{order};" if target is None else target, None if minute is None else START + timedelta(minutes=minute))


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def said(spark, source, out, check, keep_ms=None, files=1):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    q = ordered.ordered_memory(s, "ts", "10 minutes", keep_ms).writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out)
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()
    return sorted((r["doc_id"], r["mention_order"], r["memory"]) for r in spark.read.schema(ordered.ROWS).parquet(out).collect())


BATCHES = [
    [row("a", 2, 2), row("b", 1, 1), row("a", 2, 2), row("a", None, 1), row(None, 1, 1), row("b", 2, None)],
    [row("a", 1, 1), row("a", 3, 6), row("b", 3, 7, "")],
    [row("c", 1, 30)],
    [row("d", 1, 31)],
    [row("a", 9, 3), row("a", 3, 31), row("a", 4, 32)],
    [row("z", 1, 300)],
]
#: a's second row came first; its ninth came behind the watermark of the batch before; its third came twice; z waits for the watermark.
WANT = [("a", 1, "1;"), ("a", 2, "1;2;"), ("a", 3, "1;2;3;"), ("a", 4, "1;2;3;4;"), ("b", 1, "1;"), ("b", 3, "1;"), ("c", 1, "1;"), ("d", 1, "1;")]


def test_late_repeated_and_unordered_rows(rocks, tmp_path):
    source = str(tmp_path / "in")
    for b in BATCHES:
        put(rocks, source, b)
    assert said(rocks, source, str(tmp_path / "out"), str(tmp_path / "check")) == WANT


def test_restart_from_the_checkpoint(rocks, tmp_path):
    """A query that ends after each batch and starts again says what one that runs through says."""
    source = str(tmp_path / "in")
    for b in BATCHES:
        put(rocks, source, b)
        got = said(rocks, source, str(tmp_path / "out"), str(tmp_path / "check"))
    assert got == WANT


def test_expired_documents_start_anew(rocks, tmp_path):
    source = str(tmp_path / "in")
    for b in ([row("a", 1, 1)], [row("x", 1, 120)], [row("a", 2, 125)], [row("x", 2, 300)]):
        put(rocks, source, b)
    kept = said(rocks, source, str(tmp_path / "out"), str(tmp_path / "check"))
    short = said(rocks, source, str(tmp_path / "out2"), str(tmp_path / "check2"), keep_ms=30 * 60_000)
    assert ("a", 2, "1;2;") in kept and ("a", 2, "2;") in short and ("a", 1, "1;") in short


def test_windowed_recall(spark, tmp_path):
    schema = "ts timestamp, semantic_group string, gold_concept_code string, pred_concept_code string"
    rows = [(START, "g", "a", "a"), (START + timedelta(minutes=1), "g", "a", "b"), (START + timedelta(minutes=6), "g", "a", "a"), (START + timedelta(minutes=60), "g", "a", "a")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    d = memory.windowed_recall(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts")
    q = d.writeStream.format("memory").queryName("recall").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r["window"]["start"].minute, r["n"], r["n_correct"]) for r in spark.table("recall").collect()) == [(0, 2, 1), (5, 1, 1)]
