from conceptloom.plans import adapters as A
from conceptloom.plans import queries as Q

from .conftest import DATA


def test_all_names_are_judged(spark):
    assert Q.QUERIES["judge_relations"](spark, DATA).count() == A.names(spark, DATA).count()


def test_answers_are_never_gathered(spark):
    """Answers are as many as prompts, so none of them are broadcast; columns and values are those of a plain join."""
    from conceptloom.operators import judge

    rows = [(1, "p", "n", "c"), (2, "p", "n", "c"), (3, "q", "n", "c"), (4, "r", "", "c"), (5, None, "n", "c")]
    d = judge.judge(spark.createDataFrame(rows, "i int, prompt string, pred_concept_name string, pred_concept_code string"), lambda p: '{"label": "exact"}' if p == "p" else "broken")
    out = {r["i"]: (r["raw"], r["relation"]) for r in d.collect()}
    assert set(d.columns) == {"i", "prompt", "pred_concept_name", "pred_concept_code", "raw", "relation"} and len(out) == 5
    assert out[1] == out[2] == ('{"label": "exact"}', "EXACT") and out[3][0] == "broken" and out[4][0] is None
    assert "Broadcast" not in d._jdf.queryExecution().toString()
    assert "Broadcast" not in Q.QUERIES["judge_relations"](spark, DATA)._jdf.queryExecution().toString()
