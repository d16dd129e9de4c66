"""Entity export and page reading on small frames."""

from conceptloom import schemas
from conceptloom.operators import nerexport, spans


def frames(spark):
    pred = spark.createDataFrame([("d", "p1", "A", 0, 3, "one"), ("d", "p2", "B", 4, 7, "two"), ("e", "p3", "A", 0, 1, "x")], "filename string, pred_mention_id string, label string, start_span int, end_span int, span string")
    gold = spark.createDataFrame([("d", "g1", "A", 0, 3, "One", "c1"), ("d", "g2", "C", 4, 7, "Two", None), ("d", "g3", "A", 9, 10, "z", "c3")], "filename string, gold_mention_id string, label string, start_span int, end_span int, span string, code string")
    return pred, gold


def test_table(spark):
    pred, gold = frames(spark)
    got = {(r["mention_id"], r["label"], r["span"], r["code"], r["ner_status"]) for r in nerexport.table(pred, gold).collect()}
    assert got == {("p1", "A", "one", "c1", "TP"), ("p2", "B", "two", "", "FP"), ("g2", "C", "Two", "", "FN"), ("g3", "A", "z", "c3", "FN"), ("p3", "A", "x", "", "FP")}
    loose = {(r["mention_id"], r["gold_mention_id"], r["label"], r["ner_status"]) for r in nerexport.table(pred, gold, False).collect()}
    assert loose == {("p1", "g1", "A", "TP"), ("p2", "g2", "B", "TP"), ("g3", "g3", "A", "FN"), ("p3", "", "A", "FP")}
    assert {r["ner_status"] for r in nerexport.table(pred).collect()} == {"PRED"} and nerexport.table(pred.limit(0), gold.limit(0)).count() == 0


def test_files(spark, tmp_path):
    pred, gold = frames(spark)
    texts = spark.createDataFrame([("d", "one two z"), ("e", "x"), ("f", "none")], "filename string, text string")
    nerexport.write(str(tmp_path), texts, pred, gold)
    rows = spark.read.parquet(str(tmp_path / "normalization_input")).coalesce(1).collect()
    assert len(rows) == 5 and tuple(rows[0].asDict()) == nerexport.COLUMNS
    back = {r["id"]: r for r in nerexport.labelled_texts(spark.read.parquet(str(tmp_path / "pages")).selectExpr("id", "document_id", "passages", "transform(entities, e -> named_struct('id', e.id, 'type', e.type, 'text', e.text, 'offsets', e.offsets, 'normalized', cast(array() as array<struct<db_name:string,db_id:string>>))) AS entities")).collect()}
    assert [tuple(s) for s in back["d"]["spans"]] == [(0, 3, "A"), (4, 7, "B")] and back["f"]["spans"] == [] and back["e"]["text"] == "x"
    lines = {r["id"]: r for r in spark.read.json(str(tmp_path / "predictions")).collect()}
    assert [e["text"] for e in lines["d"]["entities"]] == ["one", "two"] and lines["f"]["entities"] == []


def test_strict_spans(spark):
    def e(a, b, kind="A"):
        return ("i", kind, ["x"], [[a, b]], [])

    page = ("1", "1", [("p", "t", ["Été: old-time 42nd"], [[0, 18]])], [e(0, 3), e(0, 2), e(5, 8), e(6, 8), e(14, 16), e(14, 18), e(17, 30), e(3, 3), ("i", "A", ["x"], [[0, 3], [5, 8]], []), e(5, 13, "Z")])
    d = spark.createDataFrame([page], schemas.PAGE)
    got = nerexport.labelled_texts(d, seed=1).head()["spans"]
    assert [(s["start"], s["stop"]) for s in got] == [(0, 3), (5, 8), (5, 13), (14, 18)]
    assert [s["label"] for s in nerexport.labelled_texts(d, ["Z"]).head()["spans"]] == ["Z"]


def test_lines():
    text = "One. Two\nthree\n\n four five.\nsix"
    said = lambda spans_: [text[a:b] for a, b in spans_]
    assert said(spans.line_spans(text)) == ["One.", "Two", "three", "four five.", "six"]
    at = text.index("\nthree")
    assert said(spans.line_spans(text, [(at - 3, at + 4)])) == ["One.", "Two\nthree", "four five.", "six"]
    assert said(spans.line_spans(text, [(at, at + 4)]))[1:3] == ["Two", "three"]
    # a mark within an entity still ends a sentence, unlike in sentence_spans()
    assert said(spans.line_spans(text, [(0, 8)])) == ["One.", "Two", "three", "four five.", "six"] and said(spans.sentence_spans(text, [(0, 8)]))[0] == "One. Two"
    assert spans.line_spans("") == spans.line_spans("\n\n") == []
