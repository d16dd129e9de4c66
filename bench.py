"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from conceptloom.plans import queries as plans

HEADLINE = (
    "recall_by_group", "recall_at_5", "metrics_all_slices", "threshold_prf", "rank_fusion", "paired_delta_point", "echo_error_rate", "ner_prf",
    "kb_best_title", "kb_disambiguate_levels", "kb_resolve_priority", "best_synonym_levenshtein", "top1_dot_by_group", "mention_in_sentence", "format_hybrid_long", "trie_edges", "memory_fold_decode",
    "trie_token_edges", "decode_multiple", "decode_waves", "oof_training_rows", "page_training_rows", "packed_corpus",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {k: plans.QUERIES[k] for k in HEADLINE}
    try:
        from conceptloom.llm import queries as llm

        todo |= llm.queries()
    except ImportError:
        pass
    plans.QUERIES["recall_by_group"](spark, sf).count()  # the first query also starts the engine
    took = {}
    for name, q in todo.items():
        began = time.time()
        q(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
