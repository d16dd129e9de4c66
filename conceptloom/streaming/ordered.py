"""Running memory of documents whose rows come late, out of order and more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROWS = "doc_id string, mention_order long, target string, memory string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedMemory(StatefulProcessor):
    """Holds rows back until the watermark has passed them, says them in order, and forgets idle documents.

    A document's state is a list of rows that wait, a list of what was said, one element a row, and its last time. A
    timer at a row's time lets it go; a timer keep_ms after the last row said clears the document. Both are in event
    time, so a stream that is replayed says the same.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time long, mention_order long, target string")
        self.said = handle.getListState("said", "mention_order long, target string")
        self.last = handle.getValueState("last", "time long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            new = [(int(r.ms), int(r.mention_order), r.target) for r in pdf.itertuples(index=False)]
            self.waiting.appendList(new)
            for at in {t for t, _, _ in new}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if not due:
            if not rest and self.keep_ms and self.last.exists() and self.last.get()[0] + self.keep_ms <= now:
                for state in (self.waiting, self.said, self.last):
                    state.clear()
            return
        lines = list(self.said.get()) if self.said.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        met, memory, out = {n for n, _ in lines}, "".join(t for _, t in lines), []
        fresh, anew = [], False
        for at, order, target in due:
            if self.keep_ms and last is not None and at > last + self.keep_ms:
                met, memory, fresh, anew = set(), "", [], True  # forgotten meanwhile, whether its timer has come or not
            last = at
            if order not in met:
                met.add(order)
                memory += target
                fresh.append((order, target))
                out.append((key[0], order, target, memory))
        if anew:
            self.said.put(fresh)
        elif fresh:
            self.said.appendList(fresh)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.last.update((due[-1][0],))
        if self.keep_ms:
            self.handle.registerTimer(due[-1][0] + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "mention_order", "target", "memory"])

    def close(self) -> None:
        pass


def ordered_memory(stream: DataFrame, time: str, delay: str = "10 minutes", keep_ms: int | None = None) -> DataFrame:
    """Each target with its document's targets so far, of a stream (doc_id, mention_order, target, time): ROWS.

    Rows of a document are said in order of time, then mention_order, once the watermark (delay behind the latest time)
    has passed them; so the micro-batches that bring rows in time do not matter. A mention_order that was said is not said
    again. Rows behind the watermark of the batch before theirs are dropped by the engine; one that comes later than what
    was said but before that is said after it. Null documents, orders and times say nothing, a null target is empty. keep_ms
    after its last row a document is forgotten and starts anew. The session's state store must be RocksDB (PROVIDER).
    """
    d = stream.where(F.col("doc_id").isNotNull() & F.col("mention_order").isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    d = d.select("doc_id", "mention_order", F.coalesce("target", F.lit("")).alias("target"), F.col(time).alias("time"), F.unix_millis(time).alias("ms"))
    return d.groupBy("doc_id").transformWithStateInPandas(OrderedMemory(keep_ms), ROWS, "Append", "EventTime")
