"""Benchmark decontamination: a broadcast set of normalised test word windows, scanned over whole training texts."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words are runs of digits, ASCII letters and all characters beyond ASCII, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Characters of benchmark text broadcast at once; more is scanned in blocks of this size.
BLOCK_CHARS = 8_000_000
HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words start (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), NOT_WORD)
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(pa.array(real)), before[ends]


class WindowSet:
    """Windows of benchmark items by length, as tuples of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        flat, at = word_lists(pa.array([t for _, t in items], pa.string()))
        self.vocab = pc.unique(flat)
        ids = pc.index_in(flat, value_set=self.vocab).to_numpy(zero_copy_only=False).astype(np.int32)
        self.by_length: dict[int, dict[bytes, list[str | None]]] = defaultdict(lambda: defaultdict(list))
        for k, (item, _) in enumerate(items):
            own = ids[at[k] : at[k + 1]]
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found = self.by_length[n][own[i : i + n].tobytes()]
                if item not in found:
                    found.append(item)
        self.by_length = {n: dict(x) for n, x in self.by_length.items()}

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the word spans hit (sorted, not touching) and the items that occur."""
        flat, at = word_lists(texts)
        ids = pc.fill_null(pc.index_in(flat, value_set=self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int32) if len(self.vocab) else np.full(len(flat), -1, np.int32)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        hits: dict[int, list[tuple[int, int, list]]] = defaultdict(list)
        for n, windows in self.by_length.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(known[n:] - known[:-n] == n)
            doc = np.searchsorted(at, full, side="right") - 1
            inside = full + n <= at[doc + 1]
            for i, d in zip(full[inside].tolist(), doc[inside].tolist(), strict=True):
                if (found := windows.get(ids[i : i + n].tobytes())) is not None:
                    hits[d].append((i - int(at[d]), i - int(at[d]) + n, found))
        for d in range(len(at) - 1):
            spans: list[tuple[int, int]] = []
            for a, b, _ in sorted(hits.get(d, ()), key=lambda x: x[:2]):
                if spans and a <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(b, spans[-1][1])
                else:
                    spans.append((a, b))
            yield int(at[d + 1] - at[d]), spans, sorted({i for *_, found in hits.get(d, ()) for i in found if i is not None})


def _scanner(spark: SparkSession, items: list[tuple[str | None, str | None]], window: int):
    shared = spark.sparkContext.broadcast(WindowSet(items, window))
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([{"n_words": n, "spans": [{"start": a, "stop": b} for a, b in spans], "items": found} for n, spans, found in shared.value.scan(texts)], kind)

    return scan


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Benchmark items in blocks whose characters are bounded; a single item longer than the bound is a block of its own."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "") + 16
    if block:
        yield block


def scan_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of docs and a last column __hits: n_words, spans (word numbers, half open) and items.

    A benchmark beyond block_chars characters is broadcast block by block, and each block's pass over docs is written to
    the shared folder, so that what is broadcast at once stays bounded. Null texts have no words; an item without words
    has no window; an item with a null id marks words but is not among items. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    cols = docs.columns
    none = F.lit(None).cast(HITS)
    cur, first = docs.select(F.struct(*(docs[c] for c in cols)).alias("__row"), none.alias("__hits")), True
    todo = blocks(benchmark, item_col, item_text, block_chars)
    block = next(todo, [])
    while True:
        scan = _scanner(spark, block, window)
        found = scan(F.col(f"__row.{text_col}"))
        if first:
            cur = cur.select("__row", found.alias("__hits"))
        else:
            cur = cur.select("__row", "__hits", found.alias("__more")).select("__row", merged("__hits", "__more").alias("__hits"))
        first, block = False, next(todo, None)
        if block is None:
            return cur.select("__row.*", "__hits")
        cur = common.materialize(cur, "hits")


def merged(a: str, b: str) -> Column:
    """Hits of two blocks as one: spans united in order, items without repeats."""
    return F.expr(
        f"""named_struct('n_words', {a}.n_words, 'spans',
        aggregate(array_sort(concat({a}.spans, {b}.spans)), cast(array() as array<struct<start:bigint,stop:bigint>>),
          (acc, x) -> CASE WHEN size(acc) > 0 AND x.start <= element_at(acc, -1).stop
            THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.stop))))
            ELSE concat(acc, array(x)) END),
        'items', array_sort(array_distinct(concat({a}.items, {b}.items))))"""
    )


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """docs without benchmark passages. mode "documents" drops every row with a hit; mode "spans" cuts the words hit, and
    what stands between them, out of the text and keeps the row. Rows without hits stay as they are."""
    cols = docs.columns
    hit = scan_hits(docs, benchmark, text_col, **how)
    if mode == "documents":
        return hit.where(F.size("__hits.spans") == 0).drop("__hits")
    if mode != "spans":
        raise ValueError(f"unknown mode {mode}")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([t if not h["spans"] else cut_words(t, [(s["start"], s["stop"]) for s in h["spans"]]) for t, h in zip(texts.to_pylist(), hits.to_pylist(), strict=True)], pa.string())

    return hit.select(*(cut(F.col(text_col), F.col("__hits")).alias(c) if c == text_col else hit[c] for c in cols))


@functools.cache
def _word():
    import re

    return re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words numbered in spans and what stands between them."""
    at = [m.span() for m in _word().finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


