"""Class-based bigram language model (Brown classes by exchange clustering).

Types of the model: the most frequent training words, buckets that all other words share by their last two characters,
and the end of a text. Both numbers grow as the root of the vocabulary, at every size alike. Every type but the end belongs to one class, so every word has one. A text's
probability is the product of P(class | class before) * P(type | class) * P(word | type); the last factor is 1 but for
words of a suffix bucket, where it is (c + 1) / (N_bucket + V_bucket + 1). All counts are over all training texts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words with a type of their own and suffix buckets, times the root of the vocabulary; classes; exchange rounds; smoothing of class bigrams.
TOP, SUFFIXES, CLASSES, ROUNDS, ALPHA = 16.0, 2.0, 48, 8, 0.1
END = ""  # no word is empty


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z lower-cased, in order, and where each text's words start (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(pa.array(real)), before[ends]


def suffix_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket from the last two characters of each word."""
    if not len(words):
        return np.zeros(0, np.int64)
    tail = pc.utf8_slice_codeunits(words, -2, None).dictionary_encode()
    of = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in tail.dictionary.to_pylist()], np.int64)
    return of[tail.indices.to_numpy()]


@dataclass
class Types:
    """The frequent words of a model, with their training counts."""

    words: pa.Array
    counts: np.ndarray
    suffixes: int

    @property
    def end(self) -> int:
        return len(self.words) + self.suffixes

    def number(self, flat: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Type numbers of all tokens with an end after each text; where texts start in them; which words (of flat) are not frequent."""
        ids = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.words) else np.full(len(flat), -1)
        rare = ids < 0
        if rare.any():
            ids[rare] = len(self.words) + suffix_bucket(flat.filter(pa.array(rare)), self.suffixes)
        out = np.insert(ids, at[1:], self.end)
        return out, at + np.arange(len(at)), rare


def batches(df: DataFrame, work, schema: str, piece_bytes: int = 4 << 20) -> DataFrame:
    """df.mapInArrow(work) over a partition's batches, gathered to pieces of about piece_bytes: what is counted together leaves as one row."""

    def each(it):
        held, size = [], 0
        for b in it:
            held.append(b)
            size += b.nbytes
            if size >= piece_bytes:
                yield from work(gather(held))
                held, size = [], 0
        if held:
            yield from work(gather(held))
        common.trim()  # the worker lives on and serves other tasks

    return df.mapInArrow(each, schema)


def gather(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    names = held[0].schema.names
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k).cast(pa.large_string()) for b in held]) for k in range(len(names))], names)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all texts of train(text); the end of a text is the empty word. Each batch is counted before the shuffle."""

    def count(b: pa.RecordBatch):
        flat, _ = tokens(b.column(0))
        vc = pc.value_counts(flat)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([vc.field(0).cast(pa.string()), pa.array([END])]), pa.concat_arrays([vc.field(1), pa.array([b.num_rows], pa.int64())])], ["word", "n"])

    return batches(train.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def bigram_counts(train: DataFrame, types: Types) -> DataFrame:
    """(a, b, n) of neighbouring types over all texts of train(text), each text after an end."""

    def count(b: pa.RecordBatch):
        flat, at = tokens(b.column(0))
        ids, start, _ = types.number(flat, at)
        before = np.concatenate([[types.end], ids[:-1]])[: len(ids)]
        before[start[:-1]] = types.end
        key, n = np.unique(before * (types.end + 1) + ids, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key // (types.end + 1)), pa.array(key % (types.end + 1)), pa.array(n)], ["a", "b", "n"])

    return batches(train.select("text"), count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contexts(bigrams: tuple[DataFrame, DataFrame], cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of classes after and before each type: two tables of (types, classes), bounded by the model's size.

    bigrams are the same counts twice, once with the rows of a first type together and once with those of a second, so
    that a task sums up nearly all of a type's contexts before they are shuffled.
    """

    # one row a type: bounded by the model, so it is broadcast
    of = F.broadcast(bigrams[0].sparkSession.createDataFrame(pd.DataFrame({"k": cls.astype("int32"), "of": np.arange(len(cls))})))
    out = []
    for d, t, other in zip(bigrams, "ab", "ba", strict=True):
        cells = d.join(of, d[other] == of["of"]).groupBy(F.col(t).cast("int").alias("t"), F.col("k").cast("short").alias("k")).agg(F.sum("n").alias("n"))
        table = np.zeros((len(cls), classes))
        got = cells.toArrow()  # narrow rows, one side at a time: at most a row for each type and class
        table[got["t"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
        out.append(table)
    return out[0], out[1]


def likelihood(pairs: np.ndarray, count: np.ndarray, members: np.ndarray) -> float:
    """Log-likelihood of the training tokens under a class bigram model, without smoothing."""
    log = lambda x: np.log(np.maximum(x, 1e-300))
    return float((pairs * log(pairs)).sum() - (pairs.sum(1) * log(pairs.sum(1))).sum() - (members * log(members)).sum() + (count * log(count)).sum())


def exchange(bigrams: tuple[DataFrame, DataFrame], n_types: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Classes of all types, their counts, class bigram counts and the likelihood after each round.

    A round counts, in one pass over the bigrams, the classes about each type, and moves types to the class under which
    their contexts are likeliest. Half of the types, by turns, may move in a round, so that neighbours do not swap for
    ever; a round that would lower the likelihood is the last and is not kept. The end of a text has the last class.
    """
    end = n_types - 1
    cls = np.arange(n_types) % (classes - 1)
    cls[end] = classes - 1
    best, told = None, []
    for turn in range(rounds + 1):
        right, left = contexts(bigrams, cls, classes)
        count = right.sum(1)
        pairs = np.zeros((classes, classes))
        np.add.at(pairs, cls, right)
        members = np.bincount(cls, count, classes)
        value = likelihood(pairs, count, members)
        if best is not None and value < best[3]:
            break
        told.append(value)
        best = cls.copy(), count, pairs, value
        soft = pairs + ALPHA
        after = np.log(soft / soft.sum(1, keepdims=True))
        # what follows the type, what comes before it, and the type itself, if it were in each class
        score = right @ after.T + left @ after - count[:, None] * np.log(members + 1)[None, :]
        score[:, classes - 1] = -np.inf
        want = score.argmax(1)
        may = (np.arange(n_types) * 2654435761 >> 7) % 2 == turn % 2
        moved = may & (np.arange(n_types) != end) & (count > 0) & (score[np.arange(n_types), want] > score[np.arange(n_types), cls] + 1e-9)
        if not moved.any() and turn:
            break
        cls = np.where(moved, want, cls)
    return best[0], best[1], best[2], told


@dataclass
class Model:
    types: Types
    step: np.ndarray  # log10 P(class | class before)
    cls: np.ndarray
    emit: np.ndarray  # log10 of P(type | class), and for suffix buckets less log10(N_bucket + V_bucket + 1)
    tokens: int
    vocabulary: int
    end_count: int


def fit(train: DataFrame, top: int | None = None, suffixes: int | None = None, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of train(text) and its table of (word, c).

    Repeated rows count each time, null texts are empty, other columns are not read, and an empty table gives a model
    that knows the end of a text only. Words of equal counts go by their spelling.
    """
    counts = common.materialize(word_counts(train), "words")
    n, v = counts.where("c > 0").agg(F.sum("c"), F.count("*")).head()
    root = math.sqrt(v or 0)
    top = math.ceil(TOP * root) if top is None else top
    suffixes = max(1, math.ceil(SUFFIXES * root)) if suffixes is None else suffixes
    end_count = counts.where(F.col("word") == END).agg(F.sum("c")).head()[0] or 0
    frequent = counts.where((F.col("word") != END) & (F.col("c") > 0)).orderBy(F.desc("c"), "word").limit(top).toArrow()
    types = Types(frequent["word"].combine_chunks().cast(pa.large_string()), frequent["c"].to_numpy().astype(np.int64), suffixes)
    after = common.materialize(bigram_counts(train, types).repartition("a"), "bigrams")
    before = common.materialize(after.repartition("b"), "bigrams")
    cls, count, pairs, _ = exchange((after, before), types.end + 1, classes, rounds)
    common.release(after)
    common.release(before)

    shared = train.sparkSession.sparkContext.broadcast(types)

    def bucket_sizes(b: pa.RecordBatch):
        w = b.column(0).cast(pa.large_string())
        keep = pc.invert(pc.is_in(w, value_set=shared.value.words)) if len(shared.value.words) else pa.array([True] * len(w))
        k, size = np.unique(suffix_bucket(w.filter(keep), suffixes), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(size)], ["k", "v"])

    kinds = np.zeros(suffixes)
    for r in batches(counts.where((F.col("word") != END) & (F.col("c") > 0)).select("word"), bucket_sizes, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toLocalIterator():
        kinds[r["k"]] = r["v"]
    smooth = count.copy()
    rare = slice(len(types.words), types.end)
    smooth[rare] += 1  # a bucket that training never met stays possible
    members = np.bincount(cls, smooth, classes)
    emit = np.log10(np.maximum(smooth, 1e-300) / np.maximum(members[cls], 1e-300))
    emit[rare] -= np.log10(count[rare] + kinds + 1)
    emit[types.end] = 0.0
    soft = pairs + ALPHA
    return Model(types, np.log10(soft / soft.sum(1, keepdims=True)), cls, emit, int(n or 0), int(v or 0), int(end_count)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of docs and the columns __n_tokens, __n_known, __base_score, __score (log10).

    Frequent words are scored where the texts are; each text's other words leave once with their number, meet their
    counts in a join on the word, and come back as sums. A word outside the frequent ones holds at most a 1/top share of
    the training tokens, so no key of this join is hot on either side. Null texts are empty: one end.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = "n_tokens long, known long, base double, score double, rare array<struct<word:string,n:bigint>>"
    item = pa.struct([("word", pa.string()), ("n", pa.int64())])
    whole = pa.struct([("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(item))])

    @F.arrow_udf(kind)
    def local(texts: pa.Array) -> pa.Array:
        m = shared.value
        flat, at = tokens(texts)
        ids, start, rare = m.types.number(flat, at)
        cls = m.cls[ids]
        before = np.concatenate([[m.cls[m.types.end]], cls[:-1]])[: len(cls)]
        before[start[:-1]] = m.cls[m.types.end]
        c1 = np.zeros(m.types.end + 1)
        c1[: len(m.types.words)] = np.log10(m.types.counts + 1.0)
        c1[m.types.end] = np.log10(m.end_count + 1.0)
        frequent = (ids < len(m.types.words)).astype(np.int64)
        frequent[start[1:] - 1] = m.end_count > 0
        per = lambda x: np.add.reduceat(x, start[:-1]) if len(start) > 1 else x[:0]
        n = np.diff(start)
        base = per(c1[ids]) - n * np.log10(m.tokens + m.vocabulary + 1.0)
        total = per(m.step[before, cls] + m.emit[ids])
        # the rare words of each text, once each
        where = np.flatnonzero(rare)
        enc = flat.filter(pa.array(rare)).dictionary_encode()
        doc = np.searchsorted(at, where, side="right") - 1
        width = max(1, len(enc.dictionary))
        key, times = np.unique(doc * width + enc.indices.to_numpy(), return_counts=True)
        offsets = np.searchsorted(key // width, np.arange(len(at)), side="left").astype(np.int32)
        pairs = pa.StructArray.from_arrays([enc.dictionary.cast(pa.string()).take(pa.array(key % width)), pa.array(times.astype(np.int64))], fields=list(item))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(per(frequent)), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pairs)], fields=list(whole))

    cols = docs.columns
    d = docs.select(F.struct(*(docs[c] for c in cols if c != text_col)).alias("__row"), local(docs[text_col]).alias("__l")) if len(cols) > 1 else docs.select(F.struct(F.lit(0)).alias("__row"), local(docs[text_col]).alias("__l"))
    d = common.materialize(d.select(F.monotonically_increasing_id().alias("__rid"), "__row", "__l"), "scores")
    rare = d.select("__rid", F.explode("__l.rare").alias("x")).select("__rid", "x.word", "x.n")
    found = rare.join(counts.where(F.col("word") != END), "word", "left")
    sums = found.groupBy("__rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("k"))
    d = d.join(sums, "__rid", "left")
    s, k = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return d.select("__row.*", F.col("__l.n_tokens").alias("__n_tokens"), (F.col("__l.known") + k).alias("__n_known"), (F.col("__l.base") + s).alias("__base_score"), (F.col("__l.score") + s).alias("__score"))


def perplexity(scored: DataFrame) -> float:
    """Of rows of score(): 10 to the mean negative log10 probability of a token."""
    total, n = scored.agg(F.sum("__score"), F.sum("__n_tokens")).head()
    return 10 ** (-total / n) if n else float("nan")
