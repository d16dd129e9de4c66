"""Readers, writers and streaming forms."""

import zipfile

from pyspark.sql import functions as F

from conceptloom import schemas
from conceptloom.sources import readers, storage, writers
from conceptloom.streaming import memory


def test_zipped_release(spark, tmp_path):
    z = tmp_path / "r.zip"
    lines = ["C1|ENG|P|||||||||MTH|PT|c1|Cœur|x|", "C2|FRE|S|"]
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("r/MRCONSO.RRF", "\n".join(lines) + "\n")
    rows = readers.zipped_rrf(spark, str(z), "r/MRCONSO.RRF", "MRCONSO").orderBy("cui").collect()
    assert rows[0]["term"] == "Cœur" and rows[0]["sab"] == "MTH" and rows[1]["term"] is None


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("001", 'say "x', "NO_CODE")], "id string, t string, code string")
    writers.tsv(df, str(tmp_path / "a"))
    got = readers.tsv(spark, str(tmp_path / "a"), "id string, t string, code string", null="NO_CODE").head()
    assert got["id"] == "001" and got["code"] is None
    writers.json_lines(df, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 1
    made = []
    for _ in range(2):
        storage.read_or_make(spark, str(tmp_path / "c"), lambda: made.append(1) or df)
    assert len(made) == 1


def test_pages_and_escapes(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "1", "document_id": "d", "passages": [], "entities": []}\n')
    assert readers.pages(spark, str(tmp_path / "p.jsonl")).schema.simpleString().startswith("struct<id:string,document_id:string")
    assert schemas.PAGE
    df = spark.createDataFrame([("c\\xc3\\xa9",), ("plain",), (None,)], "t string")
    assert [r["x"] for r in df.select(readers.decode_escapes(F.col("t")).alias("x")).collect()] == ["cé", "plain", None]


def run(spark, df, folder, schema, name, mode="append"):
    df_stream = spark.readStream.schema(schema).parquet(folder)
    q = df(df_stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_streaming(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = [("a", 1, "x;"), ("a", 2, "y;"), ("b", 1, "z;")]
    spark.createDataFrame(rows, "doc_id string, mention_order long, target string").coalesce(1).write.parquet(at)
    got = run(spark, memory.running_memory, at, "doc_id string, mention_order long, target string", "mem")
    assert sorted((r["doc_id"], r["memory"]) for r in got) == [("a", "x;"), ("a", "x;y;"), ("b", "z;")]
    ev = str(tmp_path / "ev")
    spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:01:00'), (2, timestamp'2024-01-01 00:02:00') t(id, ts)").coalesce(1).write.parquet(ev)
    assert len(run(spark, lambda s: memory.first_events(s, ["id"], "ts"), ev, "id int, ts timestamp", "first")) == 2
