"""Vectors of texts from an encoder that is loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similarity

#: encoder(texts) -> (a list of token vectors, texts x tokens x size; a mask, texts x tokens, 1 for tokens that count).
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: Encoders of a worker, by key; they serve all its tasks.
_LOADED: dict[str, Encoder] = {}


def loaded(key: str, load: Callable[[], Encoder]) -> Encoder:
    """The encoder of a worker: tasks reach it through this function, as their own copies of globals end with them."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def pooled(tokens: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """A vector a text: "mean" of the tokens whose mask is 1, zeros if none is, or "cls", the first token."""
    if how == "cls":
        return tokens[:, 0] if tokens.shape[1] else np.zeros((len(tokens), tokens.shape[2]))
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    m = mask.astype(float)
    return np.einsum("btd,bt->bd", tokens, m) / np.maximum(m.sum(axis=1, keepdims=True), 1.0)


def encode(texts: DataFrame, text: str, load: Callable[[], Encoder], key: str, pooling: str = "mean", batch: int = 64, unit: bool = False) -> DataFrame:
    """(text, vector) of the distinct texts of a column; load() makes the encoder, once a worker for each key.

    Each task gets its texts in order of length, so the texts of a batch need little padding; vectors of a batch leave
    as one buffer. Null texts have no vector, an empty text has one. With unit, vectors have length 1, zeros stay.
    """
    d = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    d = d.repartition("text").sortWithinPartitions(F.length("text"), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(key, load)
        for b in it:
            for at in range(0, b.num_rows, batch):
                some = b.column(0).slice(at, batch)
                v = pooled(*encoder(some.to_pylist()), pooling).astype(np.float64)
                if unit:
                    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    v = v / np.where(n == 0, 1.0, n)
                ends = pa.array(np.arange(0, v.size + 1, max(1, v.shape[1]))[: len(v) + 1], pa.int32())
                yield pa.RecordBatch.from_arrays([some, pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["text", "vector"])

    return d.mapInArrow(run, "text string, vector array<double>")


def best_synonym(mentions: DataFrame, names: DataFrame, load: Callable[[], Encoder], key: str, pooling: str = "mean") -> DataFrame:
    """(code, mention, best_synonym, score) by cosine of encoded texts: both sides' distinct texts are encoded once and joined back."""
    from ..sources import storage

    both = mentions.select(F.col("mention").alias("text")).unionByName(names.select(F.col("entity").alias("text")))
    vectors = storage.materialize(encode(both, "text", load, key, pooling), "vectors")
    return similarity.best_synonym(mentions, names, "embedding", vectors)


class HashedWords:
    """An encoder of exact numbers, without a model: a word's vector has the octal digits of its MD5's first 24 bits, less 3.

    The first token is the text as a whole, masked out of the mean like padding.
    """

    size = 8

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import hashlib

        words = [[t, *(w for w in t.split(" ") if w)] for t in texts]
        longest = max(map(len, words))
        out, mask = np.zeros((len(texts), longest, self.size)), np.zeros((len(texts), longest))
        for i, ws in enumerate(words):
            for k, w in enumerate(ws):
                h = int(hashlib.md5(w.encode()).hexdigest()[:6], 16)
                out[i, k] = [(h >> 3 * j & 7) - 3 for j in range(self.size)]
                mask[i, k] = k > 0
        return out, mask
