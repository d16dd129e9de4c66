"""Streaming forms: running memory of documents, and one row an event within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = "doc_id string, mention_order long, target string, memory string"


def first_events(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; a key is remembered as long as late rows may come."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_recall(stream: DataFrame, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Hits and mentions by time window and group, as predictions come in."""
    d = stream.withWatermark(time, delay)
    return d.groupBy(F.window(time, window), "semantic_group").agg(F.count("*").alias("n"), F.count_if(F.col("gold_concept_code") == F.col("pred_concept_code")).alias("n_correct"))


def running_memory(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Each target with its document's targets so far. State is one string a document, dropped keep_ms after its last row.

    Without keep_ms state stays; with it the query keeps running batches to look for timeouts, also when no rows come.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("mention_order")
        out = []
        for r in rows.itertuples(index=False):
            memory += r.target
            out.append((key[0], int(r.mention_order), r.target, memory))
        state.update((memory,))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["doc_id", "mention_order", "target", "memory"])

    return stream.groupBy("doc_id").applyInPandasWithState(update, MEMORY, "memory string", "append", "ProcessingTimeTimeout" if keep_ms else "NoTimeout")
