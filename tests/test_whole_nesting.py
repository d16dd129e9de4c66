"""Encoders, observed runs, nested values as paths, and readers over small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptloom import schemas
from conceptloom.functions import nested
from conceptloom.operators import corpus, encoding, observed
from conceptloom.sources import readers, writers


def words(text):
    return [w for w in text.split(" ") if w]


def test_encoded_texts(spark):
    texts = ["b a", "", "a", "b a", None, " ", "long " * 50, "é"] + [f"t{i} {'x ' * (i % 7)}" for i in range(150)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["text"]: r["vector"] for r in encoding.encode(d, "t", encoding.HashedWords, "test", batch=7).collect()}
    assert set(got) == {t for t in texts if t is not None}
    one = encoding.HashedWords()
    for t, v in got.items():
        tokens, _ = one([t])
        want = tokens[0, 1:].mean(axis=0) if words(t) else np.zeros(8)
        assert v == pytest.approx(want.tolist())
    cls = {r["text"]: r["vector"] for r in encoding.encode(d, "t", encoding.HashedWords, "test", "cls", unit=True).collect()}
    assert np.linalg.norm(cls["a"]) == pytest.approx(1) and cls["a"] == pytest.approx((one(["a"])[0][0, 0] / np.linalg.norm(one(["a"])[0][0, 0])).tolist())
    assert encoding.encode(d.limit(0), "t", encoding.HashedWords, "test").count() == 0
    with pytest.raises(ValueError):
        encoding.pooled(np.zeros((1, 1, 1)), np.zeros((1, 1)), "max")


def test_an_encoder_is_loaded_once_a_worker(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return encoding.HashedWords()

    d = spark.range(400).select(F.col("id").cast("string").alias("t"))
    for _ in range(2):
        assert encoding.encode(d, "t", load, f"counted {log}", batch=5).count() == 400
    loads = log.read_text().split()
    assert len(loads) == len(set(loads))


def test_observed(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, kind string")
    writers.parquet(d, str(tmp_path / "in"))
    with pytest.warns(UserWarning, match="nowhere"):
        found, skipped = observed.read_existing(spark, [str(tmp_path / "in"), str(tmp_path / "nowhere")], spark.read.parquet)
    run = observed.counted(found, F.col("kind"), ["a"], skipped, most=F.max("id"))
    got = run.finish(lambda x: writers.parquet(x, str(tmp_path / "out")))
    assert got["rows"] == 4 and got["rejected"] == 2 and got["rejected_kinds"] == ["b", "null"] and got["most"] == 4 and got["skipped"] == 1 and got["rows_per_second"] > 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.warns(UserWarning):
        assert observed.read_existing(spark, [str(tmp_path / "nowhere")], spark.read.parquet) == (None, [str(tmp_path / "nowhere")])
    assert observed.counted(d).finish()["rows"] == 4


EXTRA = ", m map<string,array<double>>, `a.b` struct<x:int,`y#`:string,z:binary>, n int"


def test_pages_there_and_back(spark):
    full = ([("p0", "t", ["a.b", None], [[0, 3]])], [("e", "k", ["x"], [[0, 1], [4, 6]], [("d", "i", None, "", "m")])])
    rows = [
        ("1", "d1", *full, {"k.1": [1.5, None], "k#%": [], "": None}, (1, "#", b"\x00\xff"), 7),
        ("2", None, [], None, {}, (None, None, None), None),
        ("3", "", None, [], None, None, 0),
        ("4", "d", [None, ("p", None, [], None)], [("e", None, None, [None, []], [None])], {"k": None}, None, None),
        ("5", None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, schemas.PAGE + EXTRA)
    long = nested.flattened(d, ["id"])
    back = nested.unflattened(long, ["id"], d.schema)
    assert back.schema.simpleString() == d.schema.simpleString()
    # a row of nulls alone leaves no line
    assert sorted(map(repr, back.collect())) == sorted(repr(r) for r in d.where("id <> '5'").collect())
    at = {(r["id"], r["path"]): r["value"] for r in long.collect()}
    assert at["1", "passages.0.text.0"] == "a.b" and at["1", "entities.0.offsets.1.0"] == "4" and at["1", "m.k%2E1.0"] == "1.5" and at["1", "a%2Eb.y%23"] == "#"
    assert ("1", "passages.0.text.1") not in at and at["2", "passages#"] == "0" and ("3", "passages#") not in at


def test_dotted_columns(spark):
    d = spark.createDataFrame([((1, (2.5, "x")), [1])], "metrics struct<n:int,ner:struct<f1:double,`best run`:string>>, l array<int>")
    out = nested.dotted(d)
    assert out.columns == ["metrics.n", "metrics.ner.f1", "metrics.ner.best run", "l"] and tuple(out.head()) == (1, 2.5, "x", [1])


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code,code_new\nA,B\n")
    (tmp_path / "g.txt").write_text("CAT|GRP|T01|Name one\n")
    assert [tuple(r) for r in readers.corrections(spark, str(tmp_path / "c.csv")).collect()] == [("A", "B")]
    assert [tuple(r) for r in readers.semantic_groups(spark, str(tmp_path / "g.txt")).collect()] == [("CAT", "GRP", "T01", "Name one")]
    for k in ("x", "y"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "r.tsv").write_text('a\tb\n1\t"q\n')
    d = readers.runs(spark, str(tmp_path / "*" / "r.tsv"), "a string, b string")
    assert sorted(r["dataset"] for r in d.collect()) == ["x", "y"]
    assert readers.tsv(spark, str(tmp_path / "x" / "r.tsv"), "a string, b string", quoting=False).head()["b"] == '"q'
    (tmp_path / "p.json").write_text('[{"id": "1", "document_id": "d", "passages": [], "entities": []}]')
    assert readers.pages(spark, str(tmp_path / "p.json")).head()["document_id"] == "d"


def test_strict_entities_and_shuffle(spark):
    e = spark.createDataFrame([(1, "A", [(0, 1)]), (2, "A", [(0, 1), (3, 4)]), (3, "B", [(0, 1)])], "id int, entity_type string, fragments array<struct<start:int,stop:int>>")
    assert {r["id"] for r in readers.strict_entities(e).collect()} == {1, 3} and [r["id"] for r in readers.strict_entities(e, ["B"]).collect()] == [3]
    d = spark.range(50)
    a, b = ([r["id"] for r in readers.shuffled(x, "id", 1).collect()] for x in (d, d.repartition(7)))
    assert a == b != sorted(a) and [r["id"] for r in readers.shuffled(d, "id", 2).collect()] != a
    m = spark.createDataFrame([(f"d{i % 3}", i) for i in range(20)], "doc_id string, mention_order int")
    assert sorted(r["count"] for r in corpus.batches(m, 8).groupBy("batch").count().collect()) == [4, 8, 8]
