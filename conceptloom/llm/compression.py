"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into short pieces, and each piece is compressed under both dictionaries. The normalised difference of the
compressed sizes, (bad - good) / (bad + good), is taken over the whole text and, as a page of junk may stand in a good
text, at three quantiles of its pieces; a weighted logistic regression on labelled texts that the dictionaries were not
made of calibrates these differences, and nothing else, to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, labelled

#: Labelled texts of each class at most, and their characters; bytes of a dictionary and of the pieces it is trained on; level.
PER_CLASS, MAX_CHARS, DICT_BYTES, TRAINED, LEVEL = 3000, 12_000_000, 65_536, 2048, 3
#: Bytes of the pieces that are compared, in two sizes; quantiles of the pieces' differences; penalty of the calibration.
PIECES, QUANTILES, RIDGE = (128, 1024), (0.1, 0.5, 0.9), 1e-3


def dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on pieces of texts; of too few pieces, their last bytes as they are."""
    pieces = [b[i : i + TRAINED] for t in texts if (b := t.encode("utf-8", "surrogatepass")) for i in range(0, len(b), TRAINED)]
    try:
        return zstd.train_dictionary(min(size, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstd.ZstdError:
        return b"".join(pieces)[-size:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        def under(d: bytes):
            return zstd.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, **({"dict_data": zstd.ZstdCompressionDict(d)} if d else {}))

        self.good, self.bad = under(good), under(bad)

    def differences(self, text: str | None) -> list[float]:
        """For each size of pieces: the normalised difference over the text, and the quantiles of its pieces' (of no piece: 0)."""
        b = (text or "").encode("utf-8", "surrogatepass")
        out: list[float] = []
        for size in PIECES:
            pieces = [b[i : i + size] for i in range(0, len(b), size)]
            if not pieces:
                out += [0.0] * (1 + len(QUANTILES))
                continue
            g = np.array([len(self.good.compress(x)) for x in pieces], float)
            d = np.array([len(self.bad.compress(x)) for x in pieces], float)
            out.append(float((d.sum() - g.sum()) / (d.sum() + g.sum())))
            out += [float(x) for x in np.quantile((d - g) / (d + g), QUANTILES)]
        return out


WIDTH = len(PIECES) * (1 + len(QUANTILES))


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        k = z.shape[1]
        return np.column_stack([np.ones(len(z)), z, *(z[:, i] * z[:, j] for i in range(k) for j in range(i, k))])

    def probability(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(differences) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Newton steps; the ridge spares the first column, the intercept."""
    beta = np.zeros(x.shape[1])
    w = w / w.sum()
    r = np.full(x.shape[1], ridge)
    r[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + r * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(r + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return beta


def fit(s: labelled.Sample) -> Model:
    """Every other text of a class makes its dictionary; the rest calibrate. Without both classes all get the share of label 1."""
    w = np.array(s.weights()) if s.labels else np.zeros(0)
    groups = {y: [i for i, v in enumerate(s.labels) if v == y] for y in (0, 1)}
    terms = 1 + WIDTH + WIDTH * (WIDTH + 1) // 2
    if min(map(len, groups.values())) < 2:
        share = (s.totals[1] + 0.5) / (sum(s.totals.values()) + 1)
        return Model(b"", b"", np.zeros(WIDTH), np.ones(WIDTH), np.array([np.log(share / (1 - share)), *[0.0] * (terms - 1)]))
    made = [dictionary([s.texts[i] for i in groups[y][::2]]) for y in (1, 0)]
    rest = sorted(i for y in (0, 1) for i in groups[y][1::2])
    c = Compressors(*made)
    x = np.array([c.differences(s.texts[i]) for i in rest])
    m = Model(*made, x.mean(0), x.std(0) + 1e-6, np.zeros(terms))
    m.weights = logistic(m.design(x), np.array([s.labels[i] for i in rest], float), w[rest])
    return m


def score_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)
    kept: dict[str, Compressors] = {}

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        if "c" not in kept:
            kept["c"] = Compressors(m.good, m.bad)
        return pd.Series(m.probability(np.array([kept["c"].differences(t) for t in text]).reshape(-1, WIDTH)))

    return score


def classify(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """All rows and columns of docs, whatever their names, and a last column __score in 0 to 1.

    Null texts are scored as empty ones, and all empty texts alike; very long texts are compressed whole, a piece at a
    time; equal texts get equal scores and repeated rows stay; an empty table stays empty, and labels of one class only
    give every text that class's share.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    model = fit(labelled.sample(docs, labels, label_col, train, per_class, max_chars, id_col, text_col))
    common.trim()
    return docs.select(*(docs[c] for c in docs.columns), score_udf(spark, model)(docs[text_col]).alias("__score"))
