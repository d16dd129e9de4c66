"""Page-to-row driver and out-of-fold memory on small frames."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conceptloom import schemas
from conceptloom.operators import corpus, crossfit, pagerows

CODE = [("", "C1", "", "", "")]


def page(i, text, entities, split="train"):
    passages = [("p0", "t", [text], [[0, len(text)]])] if text is not None else []
    return (f"i{i}", f"d{i}", passages, entities, split)


def entity(i, kind, text, offsets, code="C1"):
    return (f"e{i}", kind, text, offsets, [("", c, "", "", "") for c in code.split("+")] if code else [])


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        page(1, "Left and right arm broke. The arm hurts.", [entity(0, "B", ["Left", "arm"], [[0, 4], [15, 18]]), entity(1, "B", ["arm"], [[30, 33]]), entity(2, "X", ["arm"], [[30, 33]], "C2")]),
        page(2, "An arm here", [entity(0, "B", ["arm"], [[3, 6]])], "test"),
        page(3, "No entity", []),
        page(4, None, [entity(0, "B", ["lost"], [[0, 4]])]),
        page(5, "Brace bad", [entity(0, "B", ["bad"], [[6, 9]], "C9")], None),
        page(6, "Two codes", [entity(0, "B", ["codes"], [[4, 9]], "C2+C1")]),
        page(7, "w " * 20_000 + "arm.", [entity(0, "B", ["arm"], [[40_000, 40_003]])]),
        (None, None, None, None, "train"),
    ]
    return spark.createDataFrame(rows, schemas.PAGE + ", split string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("C1", "arm"), ("C1", "left arm"), ("C2", "limb"), ("C9", "a}b")], "code string, entity string")


def test_rows(spark, pages, names):
    out, located = pagerows.rows(pages, names)
    by = {}
    for r in out.collect():
        by.setdefault((r["format"], r["doc_id"]), []).append(r)
    short = sorted(by["short", "d1"], key=lambda r: r["mention_id"])
    # the parts of a discontinuous mention are marked one by one; of two entities on one span the last counts
    assert [r["source"] for r in short] == ["[Left] and right [arm] broke.", "The [arm] hurts."]
    assert [r["target"] for r in short] == ["[Left arm]{B} left arm", "[arm]{X} limb"]
    assert by["long", "d1"][0]["source"] == "[Left] and right [arm] broke. The [arm] hurts."
    assert by["long", "d1"][0]["target"] == "[Left arm]{B} left arm<SEP>[arm]{X} limb<SEP>"
    assert sorted(r["target"] for r in by["hybrid_short", "d1"])[-1] == "[Left arm]{B} left arm\n[arm]{X} limb\n"
    assert by["short", "d5"][0]["fault"] == "2 closing braces" and by["short", "d5"][0]["prompt"] is None and by["short", "d5"][0]["split"] is None
    assert by["short", "d6"][0]["target"] == "[codes]{B} codes"
    assert len(by["hybrid_long", "d7"][0]["source"]) == 40_006
    assert not any(d in ("d3", "d4", None) for _, d in by)
    assert Counter(f for f, _ in by) == dict.fromkeys(corpus.FORMATS, 5)
    assert located.where("doc_id = 'd1'").count() == 2


def test_memo_keeps_the_first_name(spark, names):
    """In formats with memory a document keeps the name it took for a code first."""
    p = spark.createDataFrame([page(1, "left arm. arm.", [entity(0, "B", ["left arm"], [[0, 8]]), entity(1, "B", ["arm"], [[10, 13]])])], schemas.PAGE + ", split string")
    out, _ = pagerows.rows(p, names, ("short", "hybrid_short"))
    last = {r["format"]: r["target"] for r in out.where("mention_id = 'd1.2'").collect()}
    assert last == {"short": "[arm]{B} arm", "hybrid_short": "[left arm]{B} left arm\n[arm]{B} left arm\n"}


def test_written_files(spark, pages, names, tmp_path):
    m = pagerows.write(pages, str(tmp_path / "out"), names).collect()
    rows = spark.read.parquet(str(tmp_path / "out/rows"))
    bad = spark.read.parquet(str(tmp_path / "out/quarantine"))
    assert sum(r["rows"] for r in m) == rows.count() and sum(r["quarantined"] for r in m) == bad.count() == 4
    assert (tmp_path / "out/rows/split=test/format=short").is_dir() and rows.where("prompt IS NULL").count() == 0
    lines = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/annotations"))
    assert lines.count() == 6 and {"gold_concept_code", "mention_id", "split"} <= set(lines.columns)
    assert {r["split"] for r in m} == {"train", "test", None}


def test_no_pages_and_no_names(spark, pages, tmp_path):
    assert pagerows.write(pages.limit(0), str(tmp_path / "none"), None).count() == 0
    out, _ = pagerows.rows(pages, None, ("short",), group=F.concat(F.lit("G"), "entity_type"))
    assert out.where("doc_id = 'd1'").select("target").orderBy("target").collect()[0][0] == "[Left arm]{GB} Left arm"


ROWS = [(f"d{i % 23}", f"d{i % 23}.{i}", i, ("arm", "leg", "rare")[min(i % 7, 2) if i % 7 < 2 or i == 6 else i % 2], "B" if i % 3 else None, f"n{i * i % 4}", "c") for i in range(200)]
ROWS += [("d1", "d1.x", 900, None, "B", "n", "c"), ("d1", "d1.y", 901, "arm", "B", None, "c"), (None, "z", 1, "arm", "B", "n9", "c"), ("solo", "solo.1", 1, "only here", "B", "own", "c")]
SCHEMA = "doc_id string, mention_id string, mention_order int, mention string, semantic_group string, name string, code string"


def brute(rows):
    """The most frequent name of a mention and group in the rows of other folds."""
    out = {}
    for r in rows:
        votes = Counter(x["name"] for x in rows if x["fold"] != r["fold"] and (x["mention"], x["semantic_group"]) == (r["mention"], r["semantic_group"]) and x["name"] is not None and x["mention"] is not None)
        out[r["mention_id"]] = min(votes, key=lambda n: (-votes[n], n)) if votes and r["mention"] is not None else None
    return out


def test_out_of_fold(spark):
    got = crossfit.out_of_fold(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS) and {r["mention_id"]: r["pred_name"] for r in got} == brute(got)
    by = {r["mention_id"]: r for r in got}
    assert by["solo.1"]["pred_name"] is None and by["d1.x"]["pred_name"] is None and by["d1.y"]["pred_name"] is not None


def test_no_own_fold_reaches_the_memory(spark):
    """Other names in the documents of one fold change nothing of what that fold is predicted, and something elsewhere."""
    d = spark.createDataFrame(ROWS, SCHEMA)
    before = {r["mention_id"]: (r["fold"], r["pred_name"]) for r in crossfit.out_of_fold(d).collect()}
    reached = 0
    for k in range(5):
        own = [m for m, (f, _) in before.items() if f == k]
        mine = F.coalesce(F.col("mention_id").isin(own), F.lit(False))
        loud = d.where(mine).withColumn("name", F.lit("A")).crossJoin(spark.range(9)).drop("id")
        changed = d.where(~mine).unionByName(loud)
        after = {r["mention_id"]: (r["fold"], r["pred_name"]) for r in crossfit.out_of_fold(changed).collect()}
        assert all(after[m] == before[m] for m in own)
        reached += after != before
    assert reached


def test_training_rows_and_nesting(spark):
    rows = [("a", "a.1", 1, "arm", "B", "gold1", "c1", 0, 3), ("a", "a.2", 2, "leg", "B", "gold}2", "c2", 8, 11), ("a", "a.3", 3, "toe", "B", "gold3", "c3", 16, 19)]
    d = spark.createDataFrame(rows, SCHEMA + ", start_span int, end_span int")
    d = d.withColumns({"fold": F.lit(1), "pred_name": F.when(F.col("mention") == "arm", "gold3"), "passage": F.lit(0), "passage_start": F.lit(0), "passage_stop": F.lit(20), "passage_text": F.lit("arm and leg and toe"), "sentence_start": F.lit(0), "sentence": F.lit("arm and leg and toe")})
    out = {r["mention_id"]: r for r in crossfit.training_rows(d, "hybrid_short").collect()}
    assert set(out) == {"a.1", "a.3"} and out["a.3"]["completion"] == " gold3"
    assert "### Previous Normalizations\n[arm]{B} gold3\n[leg]{B}\n\n### Prediction\n[toe]{B}" in out["a.3"]["prompt"] and "None" in out["a.1"]["prompt"]
    e = crossfit.nested(d).head()["entities"]
    assert [(x["mention_id"], x["db_pred_match"], x["db_pred_id"]) for x in e] == [("a.1", "gold3", "c3"), ("a.2", "", ""), ("a.3", "", "")]


def test_page_rows_are_not_shuffled_for_their_split(spark):
    """Splits meet the mentions: no join stands above the rows of all formats, which hold whole documents and memories."""
    from conceptloom.operators import pagerows
    from conceptloom.plans import training

    out, located = pagerows.rows(*training.nested_pages(spark, "/root/testdata/sf0.001"))
    above, union, _ = out._jdf.queryExecution().optimizedPlan().toString().partition("Union")
    assert union and "Join" not in above
    assert "split" not in located.columns and not [c for c in located.columns if c.startswith("__")]
    assert out.where("split IS NOT NULL").count() == out.count() > 0


def test_nearest_names_without_all_pairs(spark):
    """Blocks of a code meet in tasks of their own, and the least distance and lesser name are those of all pairs."""
    from conceptloom.operators import similarity

    m = [(c, f"{a}{b}é{a}") for c in ("C1", "C2", "") for a in ("x", "Yy", "zé", " ") for b in ("", "pq", "\U0001f600")] + [("C3", "alone"), (None, "x"), ("C1", None)]
    n = [(c, f"{b}{a}{b}") for c in ("C1", "C2", "") for a in ("x", "yy", "é", "z z") for b in ("", "p", "q")] + [("C1", None), (None, "x")]
    m, n = spark.createDataFrame(m, "code string, mention string"), spark.createDataFrame(n, "code string, entity string")
    pairs = m.dropna().distinct().join(n.dropna().distinct(), "code").withColumn("d", F.levenshtein("mention", "entity"))
    want = pairs.groupBy("code", "mention").agg(F.min(F.struct("d", "entity")).alias("x")).select("code", "mention", "x.entity", "x.d")
    got = similarity.nearest_by_edits(m.distinct(), n.distinct(), 5, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = similarity.best_synonym(m, n)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_long_documents(spark):
    """A text is built once and not once a mark, and white space is taken off its end without a look at all of it."""
    from conceptloom.functions import text as T

    p = spark.createDataFrame([page(1, "arm " * 3000, [entity(i, "B", ["arm"], [[4 * i, 4 * i + 3]]) for i in range(3000)])], schemas.PAGE + ", split string")
    out, _ = pagerows.rows(p, None, ("long",))
    marks = out._jdf.queryExecution().optimizedPlan().toString()
    assert marks.count("rpad(") == 1 and out.head()["source"] == "[arm] " * 3000
    ends = [(f"a b{x}{x}",) for x in "\t\n\x0b\x0c\r \x85\xa0       　"] + [("a b",), ("a​",), ("",), (" \n",), (None,)]
    d = spark.createDataFrame(ends, "t string")
    assert d.where(~T.rstrip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)\s+$", ""))).count() == 0
    assert "regexp" not in d.select(T.rstrip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_written_once(spark, pages, names, tmp_path):
    pagerows.write(pages, str(tmp_path / "once"), names)
    assert sorted(x.name for x in (tmp_path / "once").iterdir()) == ["annotations", "manifest", "quarantine", "rows"]
