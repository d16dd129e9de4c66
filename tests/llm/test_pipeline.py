from pyspark.sql import functions as F

import corpus_pipeline
from conceptloom.llm import common, decontam, simhash

from ..conftest import DATA


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    names = docs.columns
    benchmark = common.table(spark, DATA, "benchmark")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = common.materialize(stage(spark, docs, DATA), "stage")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        if name != "mixing":
            assert docs.columns == names
        if name == "near duplicates":
            fps = [r["__fp"] % (1 << 64) for r in simhash.with_fingerprints(docs).collect()]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
        if name == "decontamination":
            assert decontam.scan_hits(docs, benchmark).where("size(__hits.spans) > 0").count() == 0
    assert docs.columns == [*names, "copy"] and docs.where("copy not in (1, 2)").count() == 0


def test_stages_on_awkward_and_empty_tables(spark, awkward):
    """Nulls, blanks, very long texts, repeated rows and clashing names; then the same table without a row."""
    hidden = {c: F.lit(k) for k, c in enumerate(("__w", "__h", "__s", "__p", "__lines", "__score", "__hits", "__kept", "__f", "__r", "__row"))}
    plain = awkward.withColumns(hidden)
    for docs in (plain, plain.limit(0)):
        names, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, DATA), "stage")
            assert docs.columns == (names if name != "mixing" else [*names, "copy_2"])
            own = {tuple(r)[: len(names)] for r in docs.collect()}
            assert own <= {tuple(r) for r in plain.collect()}
            if name != "mixing":
                assert docs.count() <= n
                n = docs.count()


def test_scratch_tables_are_deleted(spark):
    import os

    docs = common.table(spark, DATA, "documents")
    _, first = corpus_pipeline.STAGES[0]
    kept = common.materialize(first(spark, docs, DATA), "stage")
    held = [p.removeprefix("file://") for p in corpus_pipeline._SCRATCH]
    assert held and all(os.path.exists(p) for p in held)
    corpus_pipeline.STAGES[3][1](spark, kept, DATA)
    assert not any(os.path.exists(p) for p in held) and kept.count() > 0
