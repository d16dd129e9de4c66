"""Toxicity: a sparse logistic classifier of words and word beginnings, regularised by counterfactuals.

Each sentence of a labelled text that mentions an identity term is repeated with the term swapped for every other term of
its set in the same language, and neutral template sentences are made with every term and with a word for a person. The
squared change of the score from one to the other is penalised, so no term gains weight from the company it keeps, and a
neutral mention of a group scores as a mention of anyone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, labelled

#: Labelled texts of each class at most, and their characters.
PER_CLASS, MAX_CHARS = 3000, 8_000_000
#: Beginnings of a word that are features, beside the word; the log-likelihood ratio that a feature's texts must show.
PREFIXES, LEAST_RATIO = (3, 4, 5, 6, 7, 8), 12.0
#: Weights of the absolute size of weights and of the squared change under swaps; steps.
SPARSE, FAIR, STEPS = 5e-5, 2.0, 1200
#: Sets of identity terms by language; terms of a set in one language can stand for each other.
IDENTITY_TERMS = (
    {"en": ("woman", "man", "girl", "boy"), "de": ("frau", "mann", "mädchen", "junge"), "fr": ("femme", "homme", "fille", "garçon"), "es": ("mujer", "hombre", "chica", "chico")},
    {"en": ("women", "men", "girls", "boys"), "de": ("frauen", "männer"), "fr": ("femmes", "hommes"), "es": ("mujeres", "hombres")},
    {"en": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), "de": ("christ", "moslem", "jude", "hindu", "buddhist"), "fr": ("chrétien", "musulman", "juif", "hindou", "bouddhiste"), "es": ("cristiano", "musulmán", "judío", "budista")},
    {"en": ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), "de": ("christen", "moslems", "juden"), "fr": ("chrétiens", "musulmans", "juifs"), "es": ("cristianos", "musulmanes", "judíos")},
    {"en": ("gay", "lesbian", "straight", "bisexual", "transgender"), "de": ("schwul", "lesbisch", "bisexuell"), "fr": ("gay", "lesbienne", "bisexuel"), "es": ("gay", "lesbiana", "bisexual")},
    {"en": ("black", "white", "asian", "african", "european", "american", "latino", "arab"), "de": ("schwarz", "weiß"), "fr": ("noir", "blanc", "arabe"), "es": ("negro", "blanco", "árabe")},
    {"en": ("german", "french", "spanish", "english", "turkish", "polish", "russian", "chinese", "mexican"), "de": ("deutsch", "französisch", "türkisch", "polnisch"), "fr": ("allemand", "français", "turc", "polonais"), "es": ("alemán", "francés", "turco", "polaco")},
    {"en": ("blind", "deaf", "disabled", "autistic"), "de": ("blind", "taub", "behindert"), "fr": ("aveugle", "sourd", "handicapé"), "es": ("ciego", "sordo", "discapacitado")},
    {"en": ("old", "young", "elderly"), "de": ("alt", "jung"), "fr": ("vieux", "jeune"), "es": ("viejo", "joven")},
    {"en": ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"), "de": ("migrant", "migranten", "flüchtling", "ausländer"), "fr": ("immigré", "immigrés", "réfugié", "étranger"), "es": ("inmigrante", "inmigrantes", "refugiado", "extranjero")},
)
#: Neutral sentences with a place for a term, and a word for a person, by language.
NEUTRAL = {
    "en": ("person", ("My neighbour is {} and works at the library.", "We met a {} family at the station this morning.", "She wrote about {} people in her town.")),
    "de": ("mensch", ("Mein Nachbar ist {} und arbeitet in der Bücherei.", "Wir haben heute am Bahnhof {} getroffen.")),
    "fr": ("personne", ("Mon voisin est {} et travaille à la bibliothèque.", "Nous avons rencontré {} à la gare ce matin.")),
    "es": ("persona", ("Mi vecino es {} y trabaja en la biblioteca.", "Hoy encontramos a {} en la estación.")),
}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def parts(word: str) -> list[str]:
    """Features of a word: itself, and its beginnings marked by a star."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def levels(counts: Counter) -> set[str]:
    """A beginning shared by two or by three different words of a text counts as a feature more each time."""
    return {f if k == 1 else f"{f}{k}" for f, c in counts.items() for k in range(1, min(c, 3) + 1)}


def text_features(words: set[str]) -> set[str]:
    return levels(Counter(f for w in words for f in parts(w)))


def sentences(text: str | None) -> list[set[str]]:
    return [text_words(x) for x in SENTENCE.split(text or "") if x]


def swaps(text: str | None, terms=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """For each mention of an identity term in a sentence, and each other term of its set and language: the words of the
    text that the swap removes, and those that it adds. A word that stands in another sentence too is not removed."""
    found = {t for group in terms for of in group.values() for t in of}
    parts_ = sentences(text)
    if not any(w & found for w in parts_):
        return []
    met = Counter(w for x in parts_ for w in x)
    out = []
    for words in parts_:
        for group in terms:
            for of in group.values():
                for term in words.intersection(of):
                    for other in of:
                        if other != term and other not in words:
                            out.append(({term} if met[term] == 1 else set(), {other} if other not in met else set()))
    return [x for x in out if x[0] or x[1]]


def change(counts: Counter, gone: set[str], come: set[str]) -> tuple[set[str], set[str]]:
    """(features that go, features that come) as words of a text go and come; counts are those of the beginnings of its words.

    Levels are those of the whole text: of two words that share a beginning one takes the second level of it along.
    """
    after = Counter({f: counts[f] for w in gone | come for f in parts(w)})
    before = levels(+after)
    after.subtract(f for w in gone for f in parts(w))
    after.update(f for w in come for f in parts(w))
    then = levels(+after)
    return before - then, then - before


def changes(text: str | None, terms=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """The features of a text that each swap removes, and those that it adds."""
    found = swaps(text, terms)
    if not found:
        return []
    counts = Counter(f for w in text_words(text) for f in parts(w))
    return [change(counts, gone, come) for gone, come in found]


def template_changes(terms=IDENTITY_TERMS, neutral=None) -> list[tuple[set[str], set[str]]]:
    """changes() of the neutral sentences: features of one sentence alone, and of the other alone."""
    both = [(text_features(a), text_features(b)) for a, b in template_pairs(terms, neutral)]
    return [(a - b, b - a) for a, b in both]


def template_swaps(terms=IDENTITY_TERMS, neutral=None) -> list[tuple[set[str], set[str]]]:
    """For each neutral sentence: the words of it with a term against those with a word for a person, and with every other term."""
    return [(a - b, b - a) for a, b in template_pairs(terms, neutral)]


def template_pairs(terms=IDENTITY_TERMS, neutral=None) -> list[tuple[set[str], set[str]]]:
    """The words of each neutral sentence with a term, and with a word for a person or another term."""
    out = []
    for lang, (anyone, lines) in (neutral or NEUTRAL).items():
        for line in lines:
            plain = text_words(line.format(anyone))
            for group in terms:
                of = group.get(lang, ())
                for k, term in enumerate(of):
                    own = text_words(line.format(term))
                    out.append((own, plain))
                    for other in of[k + 1 :]:
                        its = text_words(line.format(other))
                        out.append((own, its))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    @property
    def bases(self) -> set[str]:
        """Features without their levels."""
        return {f.rstrip("23") for f in self.weights}

    def score(self, words: set[str]) -> float:
        """The margin of a text with these words."""
        return self.bias + sum(self.weights.get(f, 0.0) for f in sorted(text_features(words)))


#: Shares of the words whose features are counted by name at once.
SHARES = 64


class Vocabulary:
    """Words by number: each word's string is kept once, however many texts hold it, and a text is an array of numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def encode(self, words: set[str]) -> np.ndarray:
        return np.fromiter((self.number.setdefault(w, len(self.number)) for w in sorted(words)), np.int32, len(words))


def _counts(texts: list[np.ndarray], vocabulary: Vocabulary, labels: list[int], n: list[int], least: float, always: set[str]) -> tuple[list[set[str]], set[str]]:
    """The features of each text that tell the labels apart by a ratio of least, or belong to a word of always, and their names.

    All features are counted by name. A word's features begin with its first three letters, so words are taken by these
    letters, a share of them at a time, and memory is bounded by that share's features.
    """
    words = list(vocabulary.number)
    share_of = np.fromiter((sum(map(ord, w[:3])) * 31 % SHARES for w in words), np.int8, len(words))
    kept: list[set[str]] = [set() for _ in texts]
    names: set[str] = set()
    sure = {f if k == 1 else f"{f}{k}" for w in always for f in parts(w) for k in (1, 2, 3)}
    for share in range(SHARES):
        met = [Counter(), Counter()]
        own = [t[share_of[t] == share].tolist() for t in texts]
        for t, y in zip(own, labels, strict=True):
            met[y].update(levels(Counter(f for i in t for f in parts(words[i]))))
        good = {f for f in met[0].keys() | met[1].keys() if f in sure or met[0][f] + met[1][f] >= 3 and ratio(met[0][f], met[1][f], *n) >= least}
        names |= good
        if good:
            for k, t in enumerate(own):
                kept[k] |= levels(Counter(f for i in t for f in parts(words[i]))) & good
    return kept, names


def _rows(sets: list[set[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    cols = [np.fromiter((index[f] for f in sorted(s) if f in index), np.int64) for s in sets]
    return np.concatenate([np.zeros(0, np.int64), *cols]), np.concatenate([np.zeros(0, np.int64), *(np.full(len(c), i) for i, c in enumerate(cols))])


def fit(s: labelled.Sample, terms=IDENTITY_TERMS, sparse: float = SPARSE, fair: float = FAIR, steps: int = STEPS) -> Model:
    """Accelerated proximal gradient steps on the weighted logistic loss, the swap penalty and the absolute weights.

    Without both classes every text gets the share of label 1.
    """
    share = (s.totals[1] + 0.5) / (sum(s.totals.values()) + 1)
    if len(set(s.labels)) < 2:
        return Model({}, float(np.log(share / (1 - share))))
    y = np.array(s.labels, float)
    w = np.array(s.weights())
    w /= w.sum()
    n = [s.labels.count(0), s.labels.count(1)]
    plus, minus = [], []
    vocabulary = Vocabulary()
    texts = [vocabulary.encode(text_words(t)) for t in s.texts]
    for t in s.texts:
        for gone, come in changes(t, terms):
            plus.append(gone)
            minus.append(come)
    for gone, come in template_changes(terms):
        plus.append(gone)
        minus.append(come)
    mentioned = {t for group in terms for of in group.values() for t in of}
    sets, known = _counts(texts, vocabulary, s.labels, n, LEAST_RATIO, mentioned & vocabulary.number.keys())
    del texts, vocabulary
    names = sorted(known)
    index = {f: i for i, f in enumerate(names)}
    col, row = _rows(sets, index)
    (pc, pr), (mc, mr) = _rows(plus, index), _rows(minus, index)
    dc, dr, dv = np.concatenate([pc, mc]), np.concatenate([pr, mr]), np.concatenate([np.ones(len(pc)), -np.ones(len(mc))])
    k, pairs = len(names), max(1, len(plus))
    bias = float(np.log(share / (1 - share)))

    def margins(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[col], len(y)) + v[k]

    def swapped(v: np.ndarray) -> np.ndarray:
        return np.bincount(dr, dv * v[dc], pairs)

    def back(gap: np.ndarray, change: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, gap[row], k) + 2 * fair / pairs * np.bincount(dc, dv * change[dr], k), gap.sum())

    # the largest curvature, by power steps, gives a safe step
    v = np.ones(k + 1)
    for _ in range(30):
        v = back(w / 4 * margins(v), swapped(v))
        v /= (curve := max(1e-9, float(np.linalg.norm(v))))
    rate = 0.9 / curve
    beta = np.append(np.zeros(k), bias)
    ahead, t = beta.copy(), 1.0
    for _ in range(steps):
        gap = w * (1 / (1 + np.exp(-np.clip(margins(ahead), -30, 30))) - y)
        new = ahead - rate * back(gap, swapped(ahead))
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * sparse, 0)
        if (ahead - new) @ (new - beta) > 0:
            t = 1.0  # the last step went uphill: lose the momentum
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - beta)
        beta, t = new, t2
    return Model({f: float(b) for f, b in zip(names, beta[:k], strict=True) if b}, float(beta[k]))


def ratio(c0: int, c1: int, n0: int, n1: int) -> float:
    """Twice the log-likelihood ratio of a feature met in c0 of n0 and c1 of n1 texts against one met alike in both."""

    def part(c: int, n: int, p: float) -> float:
        return (c * np.log(c / (n * p)) if c else 0.0) + ((n - c) * np.log((n - c) / (n * (1 - p))) if n > c else 0.0)

    p = (c0 + c1) / (n0 + n1)
    return 2 * (part(c0, n0, p) + part(c1, n1, p)) if 0 < p < 1 else 0.0


def score_udf(spark, model: Model, remembered: int = 500_000):
    shared = spark.sparkContext.broadcast(model)
    known: dict[str, tuple[str, ...]] = {}

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        weights, bias = shared.value.weights, shared.value.bias
        bases = shared.value.bases
        out = []
        for t in text:
            met: Counter = Counter()
            for w in text_words(t):
                if (found := known.get(w)) is None:
                    if len(known) >= remembered:
                        known.clear()
                    found = known[w] = tuple(f for f in parts(w) if f in bases)
                if found:
                    met.update(found)
            out.append(bias + sum(weights.get(f, 0.0) for f in sorted(levels(met))))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))))

    return score


def classify(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """All rows and columns of docs, whatever their names, and a last column __score in 0 to 1.

    Null texts are scored as empty ones; very long texts are scored whole, as the set of their words; equal texts get
    equal scores and repeated rows stay; an empty table stays empty, and labels of one class only give every text that
    class's share.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    model = fit(labelled.sample(docs, labels, label_col, train, per_class, max_chars, id_col, text_col))
    common.trim()
    return docs.select(*(docs[c] for c in docs.columns), score_udf(spark, model)(docs[text_col]).alias("__score"))
