"""Token counts of a unigram tokenizer, without making tokens.

An Aho-Corasick automaton over the vocabulary finds all pieces that end at each character of a word; a Viterbi pass
carries the best score and the number of pieces to each place. Ties and unknown characters follow the rules of the
unigram model of the public `tokenizers` library: of equal scores the piece that starts first stays, an unknown
character costs ten less than the least score, and a run of unknown characters is one token.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose counts a worker keeps.
REMEMBERED = 400_000
SPACE = "▁"
#: Fixed value: what an unknown character scores below the least piece.
UNKNOWN = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


@dataclass
class Counter:
    vocabulary: list[tuple[str, float]]
    known: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.machine = ahocorasick.Automaton()
        for piece, score in self.vocabulary:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in self.vocabulary), default=0.0) - UNKNOWN

    def word(self, w: str) -> tuple[int, int]:
        """(tokens, unknown tokens) of a word."""
        n = len(w)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        if len(self.machine):
            for end, (size, score) in self.machine.iter(w):
                ends[end].append((size, score))
                if size == 1:
                    single[end] = True
        # to each place: best score, pieces, unknown runs, whether the last piece is unknown
        best: list[tuple[float, int, int, bool]] = [(0.0, 0, 0, False)]
        for i in range(n):
            top = None
            found = ends[i]
            if len(found) > 1:
                found.sort(reverse=True)  # the longest starts first
            for size, score in found:
                s = best[i + 1 - size]
                total = s[0] + score
                if top is None or total > top[0]:
                    top = (total, s[1] + 1, s[2], False)
            if not single[i]:
                s = best[i]
                total = s[0] + self.unknown
                if top is None or total > top[0]:
                    top = (total, s[1] + (not s[3]), s[2] + (not s[3]), True)
            best.append(top)
        return best[n][1], best[n][2]

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, unknown tokens) of a text. Spaces start words; no piece reaches over one."""
        if not text:
            return 0, 0
        t = text.replace(" ", SPACE)
        if t[0] != SPACE:
            t = SPACE + t
        tokens = unknown = 0
        for w in t.split(SPACE)[1:]:
            if (r := self.known.get(w)) is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                r = self.word(SPACE + w)
                if len(w) < 100:
                    self.known[w] = r
            tokens += r[0]
            unknown += r[1]
        return tokens, unknown


def count(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text") -> DataFrame:
    """All rows and columns of docs and the columns __n_tokens and __n_unknown. Null and empty texts have no token."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    made: dict[str, Counter] = {}

    @F.pandas_udf("n_tokens long, n_unknown long")
    def tokens(text: pd.Series) -> pd.DataFrame:
        if "c" not in made:
            made["c"] = Counter(shared.value)
        return pd.DataFrame([made["c"].text(t) for t in text], columns=["n_tokens", "n_unknown"], dtype="int64")

    d = docs.select(*(docs[c] for c in docs.columns), tokens(docs[text_col]).alias("__t"))
    return d.select(*(d[c] for c in docs.columns), d["__t.n_tokens"].alias("__n_tokens"), d["__t.n_unknown"].alias("__n_unknown"))
