"""Operators on small frames, and rules that queries over the driver's tables do not reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptloom.functions import text as T
from conceptloom.functions import vectors as V
from conceptloom.operators import corpus, decode, fusion, kb, metrics, resample, similarity, spans


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


def test_codes_and_names(spark):
    assert one(spark, T.normalize_codes(F.col("c")), c=" B + A") == "A+B"
    assert one(spark, T.clean_natural(F.col("c")), c="a [b]{c}\nd") == "a (b)(c) d"
    assert [one(spark, T.strip_unspecified(F.col("c")), c=x) for x in ("Pain NOS", "Pain (NOS)", "Dolor, SAI", "NOSE")] == ["Pain", "Pain", "Dolor", "NOSE"]
    assert [one(spark, T.capitalize_first(F.col("c")), c=x) for x in ("pain", "Pain", "éa", "1a")] == ["Pain", "Pain", "Éa", "1a"]
    assert one(spark, T.prefix_class(F.col("c")), c="A1.1.4.9") == "Virus" and one(spark, T.prefix_class(F.col("c")), c="C") is None
    assert one(spark, T.trailing_number(F.col("c")), c="doc.1.12") == 12 and one(spark, T.trailing_number(F.col("c")), c="doc") == 10**9


def test_titles(spark):
    df = spark.createDataFrame([([], ["HEART", "Heart"], [], ["a"], []), ([], [], [], ["a", "b"], ["c"]), (["p"], ["m"], [], [], []), ([], [], [], ["a", "b"], [])], "p array<string>, m array<string>, e array<string>, f array<string>, s array<string>")
    assert [r["x"] for r in df.select(T.best_title(F.col("p"), F.col("m"), F.col("e"), F.col("f"), F.col("s")).alias("x")).collect()] == ["Heart", "c", "p", None]


def test_prompts(spark):
    row = spark.createDataFrame([("src \n", "[a]{g} x\n[b]{h} y\n")], "source string, target string")
    p = row.select(T.training_prompt(F.col("source"), F.col("target"), "hybrid_long").alias("p")).head()["p"]
    assert p["prompt"] == "### Context\nsrc\n\n### Previous Normalizations\n[a]{g} x\n\n### Prediction\n[b]{h}" and p["completion"] == " y"
    with pytest.raises(Exception, match="unexpected target"):
        row.select(T.training_prompt(F.col("source"), F.lit("no brace"), "short").alias("p")).collect()
    with pytest.raises(ValueError):
        T.training_prompt(F.col("source"), F.col("target"), "other")
    q = row.select(T.inference_prompt(F.col("source"), F.lit("[a]{g}"), F.lit(""), "hybrid_short").alias("q")).head()["q"]
    assert q == "### Context\nsrc\n\n### Previous Normalizations\nNone\n\n### Prediction\n[a]{g}"


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx(1)
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == -1.0
    toks = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert one(spark, V.mean_pool(toks, F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 3.0]
    assert one(spark, V.edit_distance(F.lit("été"), F.lit("ete"))) == 2


def test_sentences():
    text = "First one. Second (no. break) here!\nThird"
    got = [text[a:b] for a, b in spans.sentence_spans(text, [(11, 27)])]
    assert got == ["First one.", "Second (no. break) here!", "Third"]
    assert [*spans.bracket_safe_spans("a [b. c] d. e")] == [(0, 11), (12, 13)]
    assert spans.sentence_spans("") == []


def test_marks_can_be_removed(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(50):
        text = "".join(rng.choice("abc 😀é") for _ in range(30))
        cuts = sorted(rng.sample(range(31), 6))
        rows.append((text, [(cuts[0], cuts[5]), (cuts[1], cuts[2]), (cuts[3], cuts[4])]))
    df = spark.createDataFrame(rows, "t string, s array<struct<start:int,stop:int>>")
    for r in df.select("t", "s", spans.mark_all(F.col("t"), F.col("s")).alias("m")).collect():
        assert r["m"].replace("[", "").replace("]", "") == r["t"] and r["m"].count("[") == 3
    nested = spark.createDataFrame([("abcdef", [(0, 6), (0, 3), (4, 6), (9, 12)])], "t string, s array<struct<start:int,stop:int>>")
    assert nested.select(spans.mark_all(F.col("t"), F.col("s")).alias("m")).head()["m"] == "[[abc]d[ef]]"
    assert nested.select(spans.mark_fragments(F.col("t"), F.slice("s", 2, 2)).alias("m")).head()["m"] == "[abc]d[ef]"


def test_rebuild_and_last_wins(spark):
    df = spark.createDataFrame([([(6, "world"), (0, "hello")],)], "p array<struct<start:int,text:string>>")
    assert df.select(spans.rebuild_text(F.col("p")).alias("x")).head()["x"] == "hello world"
    e = spark.createDataFrame([("d", 0, 3, 1, "first"), ("d", 0, 3, 2, "last")], "doc_id string, start_span int, end_span int, entity_idx int, mention string")
    assert [r["mention"] for r in spans.same_span_last_wins(e).collect()] == ["last"]


def test_completion_spans(spark):
    text = "[a]{g} one<SEP>[b]{h} two"
    got = one(spark, spans.completion_spans(F.col("c")), c=text)
    assert [text[s["start"] : s["stop"]] for s in got] == ["one<SEP>", "two"]  # white space is skipped and a part's own <SEP> belongs to it


def test_memory_is_a_prefix(spark):
    df = spark.createDataFrame([("d", i, f"t{i};", f"p{i};") for i in range(6)], "doc_id string, mention_order int, target string, pred_target string")
    m = [r["memory"] for r in corpus.running_memory(df).orderBy("mention_order").collect()]
    assert all(b.startswith(a) for a, b in zip(m, m[1:], strict=False)) and m[0] == "t0;"
    assert [r["memory"] for r in corpus.running_memory_predicted(df).orderBy("mention_order").collect()][2] == "p0;p1;t2;"


def test_one_code_a_name(spark):
    rng = random.Random(6)
    rows = [(str(rng.randint(1, 30)), f"t{k}", f"n{rng.randint(1, 20)}", "s", "c", f"g{rng.randint(1, 3)}", bool(k % 2), None) for k in range(150)]
    df = spark.createDataFrame(rows, "code string, title string, entity string, sem_name string, category string, grp string, is_main boolean, lang string").dropDuplicates(["code", "entity", "grp"])
    clean, mapping = kb.resolve_by_priority(df, spark.createDataFrame([("5", "g1")], "code string, grp string"))
    per = clean.groupBy("entity", "grp").agg(F.count_distinct("code").alias("k"))
    assert per.where("k > 1").count() == 0 and per.count() == df.select("entity", "grp").distinct().count()
    assert mapping.where("code = chosen_code").count() == 0


def test_corrections(spark):
    e = spark.createDataFrame([("A+B",), ("C",), (None,)], "code string")
    c = spark.createDataFrame([("B", "X")], "code string, code_new string")
    assert sorted(str(r["code"]) for r in corpus.correct_codes(e, c).collect()) == ["A+X", "C", "None"]


def test_bootstrap_as_numpy(spark):
    rng = np.random.default_rng(0)
    docs = [f"d{i:02d}" for i in range(30)]
    num, den = rng.integers(0, 5, 30), rng.integers(5, 9, 30)
    per = spark.createDataFrame([(d, "g", int(a), int(b)) for d, a, b in zip(docs, num, den, strict=True)], "doc_id string, semantic_group string, num int, den int")
    got = {r["semantic_group"]: (r["low"], r["high"]) for r in metrics.bootstrap_ci(per, metrics.bootstrap_weights(spark, docs, 200)).collect()}
    w = np.random.default_rng(42).multinomial(30, np.full(30, 1 / 30), size=200)
    want = np.quantile((w @ num) / (w @ den), [0.025, 0.975])
    assert got["g"] == pytest.approx(tuple(want)) and got["overall"] == pytest.approx(tuple(want))
    loose = {r["semantic_group"]: r["low"] for r in metrics.bootstrap_ci(per, resample.multinomial_weights(per, 400)).collect()}
    assert loose["g"] == pytest.approx(want[0], abs=0.08)


def test_fused_ranks(spark):
    a = spark.createDataFrame([("d", "m", "x", 0.9), ("d", "m", "y", 0.8), ("d", "m", "x", 0.1)], "doc_id string, mention_id string, pred_concept_code string, score double")
    b = spark.createDataFrame([("d", "m", "y", 0.7), ("d", "m", "z", 0.6), ("d", "m", None, 0.5)], "doc_id string, mention_id string, pred_concept_code string, score double")
    assert [(r["pred_concept_code"], r["rank"]) for r in fusion.fuse([a, b]).orderBy("rank").collect()] == [("y", 1), ("x", 2), ("z", 3)]


def test_decoding_uses_memory(spark):
    m = spark.createDataFrame([("d", f"d.{i}", i, w, "G", w) for i, w in enumerate(["heart", "hearts", "zzz"], 1)], "doc_id string, mention_id string, mention_order int, mention string, semantic_group string, source string")
    n = spark.createDataFrame([("G", "Heart", "C1"), ("G", "Heat", "C2")], "grp string, entity string, code string")
    out = {(r["mention_id"], r["rank"]): r for r in decode.decode_with_memory(m, n).collect()}
    assert out["d.1", 1]["pred_concept_code"] == "C1" and out["d.3", 1]["pred_concept_code"] == "NO_CODE"
    assert "[heart]{G} Heart" in out["d.2", 1]["prompt"] and "None" in out["d.1", 1]["prompt"]


def test_methods(spark):
    m = spark.createDataFrame([("c", "heart atack"), ("c", None)], "code string, mention string")
    n = spark.createDataFrame([("c", "heart attack", "T"), ("c", "infarction", "T")], "code string, entity string, title string")
    for method in ("levenshtein", "tfidf"):
        assert similarity.best_synonym(m, n, method).head()["best_synonym"] == "heart attack"
    assert similarity.best_synonym(m, n, "title").head()["best_synonym"] == "T"
    with pytest.raises(ValueError):
        similarity.best_synonym(m, n, "other")


def test_page_round_trip(spark):
    from conceptloom import schemas

    page = ("1", "doc.1", [("p", "t", ["Some text"], [[0, 9]])], [("e", "G", ["Some", "text"], [[0, 4], [5, 9]], [("db", "C1", None, None, None)])])
    p, e = spans.explode_pages(spark.createDataFrame([page], schemas.PAGE))
    r = e.head()
    assert (r["start_span"], r["end_span"], r["mention"]) == (0, 9, "Some text") and p.head()["text"] == "Some text"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("BroadcastExchange")


def test_plans(spark):
    """Runs are dealt by mention once; the hundred most frequent are broadcast."""
    a = spark.createDataFrame([("d", "m", "x", 0.9)], "doc_id string, mention_id string, pred_concept_code string, score double")
    assert exchanges(fusion.fuse([a, a, a]))[0] == 1
    t = spark.createDataFrame([("d", "m", "a", "c", 1)], "doc_id string, mention_id string, mention string, gold_concept_code string, mention_order int")
    assert exchanges(metrics.tag_slices(t, t))[1] >= 2


def test_every_slice_has_rows(spark):
    from conceptloom.plans import queries as Q

    for name in ("metrics_all_slices", "paired_delta_slices", "fused_all_slices"):
        rows = Q.QUERIES[name](spark, "/root/testdata/sf0.01").where("semantic_group = 'overall'").collect()
        assert not [r["slice"] for r in rows if r["n"] == 0], name
