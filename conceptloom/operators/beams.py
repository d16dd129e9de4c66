"""Decoding over tries of token ids: several answers, beams, and many documents at once.

A search asks for scores and waits: it is a generator of requests. A task runs the searches of up to batch_size documents
side by side and answers what all of them ask for in one call of the scorer; as one document ends, the next one enters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import storage
from .tokentrie import END, PLUS, SEP, Choices, Shelf, TokenTrie


@dataclass
class Request:
    """What one search wants to know: the log-probabilities of the tokens that may follow."""

    prompt: str
    mention: str
    prefix: list[int]
    choices: Choices
    #: How many of the best tokens the search can use, and the score so far, turned round.
    beams: int = 1
    rank: float = 0.0

    @property
    def allowed(self) -> list[int]:
        return self.choices.ids.tolist()


#: The best tokens of a request with their log-probabilities, by falling score, ties by token.
Best = list[tuple[int, float]]
#: scorer(requests) -> for each request a log-probability of each of its allowed tokens, in one call. A scorer that knows
#: the best tokens without a look at all has best(requests) -> a Best of each, which is asked in its place.
Scorer = Callable[[list[Request]], list[list[float]]]
Search = Generator[list[Request], list[Best], object]


def best_of(request: Request, scores: list[float]) -> Best:
    """The best tokens by scores of all."""
    s, ids = np.asarray(scores, float), request.choices.ids
    if len(s) != len(ids):
        raise ValueError(f"{len(s)} scores for {len(ids)} tokens")
    rank, at = request.rank - s, np.arange(len(s))
    if len(s) > 4 * request.beams:
        at = np.flatnonzero(rank <= np.partition(rank, request.beams - 1)[request.beams - 1])
    at = at[np.argsort(rank[at], kind="stable")][: request.beams]
    return list(zip(ids[at].tolist(), s[at].tolist(), strict=True))


@dataclass(order=True)
class Beam:
    """A sequence under way, best first: by falling score, then by tokens."""

    rank: float
    tokens: list[int]
    logs: list[float] = field(compare=False)
    place: object = field(compare=False)
    names: list[tuple] = field(compare=False)

    @property
    def total(self) -> float:
        return -self.rank


@dataclass
class Answer:
    names: list[tuple[str | None, str | None]]
    tokens: list[int]
    #: Mean log-probability of all tokens, and exp of the mean without PLUS, SEP and END.
    score: float
    confidence: float


def search(trie: TokenTrie, prompt: str, mention: str, beams: int = 1, multiple: bool = False, max_tokens: int = 256) -> Search:
    """A beam search over one or more names of a trie: the best answers, up to beams of them.

    Where a name may end the next token is SEP, which ends the answer, or with multiple PLUS, after which the next name
    starts at the root. Each step keeps the beams best sequences by total score, ties by tokens; those that end are
    answers. Answers are ranked by the mean score of their tokens. The search is over when no sequence is open, or when
    it has beams answers of which none can be passed: scores are at most 0, so an open sequence's mean over max_tokens
    tokens bounds it. A sequence of max_tokens that has not ended is given up.
    """
    open_ = [Beam(0.0, [], [], trie.root(), [])]
    ends = (PLUS, SEP) if multiple else (SEP,)
    done: list[Answer] = []
    while open_:
        live, requests = [], []
        for b in open_:
            choices = trie.choices(b.place, ends)
            if len(choices.ids):
                live.append(b)
                requests.append(Request(prompt, mention, b.tokens, choices, beams, b.rank))
        if not requests:
            break
        grown = []
        for b, best in zip(live, (yield requests), strict=True):
            grown += [(b.rank - s, [*b.tokens, t], s, b) for t, s in best]
        grown.sort(key=lambda x: x[:2])
        open_ = []
        for rank, tokens, s, b in grown[:beams]:
            logs = [*b.logs, s]
            if tokens[-1] in (PLUS, SEP):
                names = [*b.names, trie.name(trie.step(b.place, END))]
                if tokens[-1] == SEP:
                    own = [x for x, t in zip(logs, tokens, strict=True) if t not in (PLUS, SEP, END)]
                    done.append(Answer(names, tokens, -rank / len(tokens), math.exp(sum(own) / max(1, len(own)))))
                elif len(tokens) < max_tokens:
                    open_.append(Beam(rank, tokens, logs, trie.root(), names))
            elif len(tokens) < max_tokens:
                open_.append(Beam(rank, tokens, logs, trie.step(b.place, tokens[-1]), b.names))
        done.sort(key=lambda a: (-a.score, a.tokens))
        done = done[:beams]
        if len(done) == beams and all(b.total / max_tokens <= done[-1].score for b in open_):
            break
    return done


def run(searches: Iterable[Search], scorer: Scorer, batch_size: int = 8) -> Iterator[object]:
    """What each search returns, as they end; up to batch_size are open, and each round of theirs is one call of the scorer."""
    waiting = iter(searches)
    live: list[tuple[Search, list[Request]]] = []

    def enter() -> Iterator[object]:
        while len(live) < batch_size and (s := next(waiting, None)) is not None:
            try:
                live.append((s, next(s)))
            except StopIteration as end:
                yield end.value

    yield from enter()
    while live:
        asked = [r for _, requests in live for r in requests]
        scores = scorer.best(asked) if hasattr(scorer, "best") else [best_of(r, s) for r, s in zip(asked, scorer(asked), strict=True)]
        at, still = 0, []
        for s, requests in live:
            mine = scores[at : at + len(requests)]
            at += len(requests)
            try:
                still.append((s, s.send(mine)))
            except StopIteration as end:
                yield end.value
        live[:] = still
        yield from enter()


ROWS = "doc_id string, mention_id string, rank int, pred_concept_name string, pred_concept_code string, n_answers int, n_tokens int, score double, confidence double, prompt string"


def _document(shelf: Shelf, rows: list, beams: int, multiple: bool, context_format: str) -> Search:
    """The rows of a document's predictions; each mention's prompt has those before it, where the format has a memory."""
    memory, out = "", []
    remembers = context_format in T.MEMORY_FORMATS
    for r in rows:
        opening = f"[{r.mention}]{{{r.semantic_group}}}"
        head = f"### Context\n{(r.source or '').rstrip()}\n\n"
        middle = f"### Previous Normalizations\n{memory.rstrip() or 'None'}\n\n" if remembers else ""
        prompt = f"{head}{middle}### Prediction\n{opening}"
        trie = shelf(None if pd.isna(r.semantic_group) else r.semantic_group)
        found = yield from search(trie, prompt, r.mention or "", beams, multiple)
        names = ["<+>".join(n or "" for n, _ in a.names) for a in found]
        for k, (a, name) in enumerate(zip(found, names, strict=True), 1):
            codes = sorted({c for _, c in a.names if c is not None})
            out.append((r.doc_id, r.mention_id, k, name, "+".join(codes) or "NO_CODE", len(a.names), len(a.tokens), a.score, a.confidence, prompt))
        if not found:
            out.append((r.doc_id, r.mention_id, 1, "NO_PREDICTION", "NO_CODE", 0, 0, 0.0, 0.0, prompt))
        if remembers:
            memory += f"{opening} {names[0] if names else 'NO_PREDICTION'}\n"
    return out


def _by_document(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The rows of one document after another, from batches in which a document's rows are neighbours."""
    held: list = []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if held and held[0].doc_id != r.doc_id:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def decode(mentions: DataFrame, manifest: str, scorer: Scorer, beams: int = 1, multiple: bool = False, batch_size: int = 8, context_format: str = "short") -> DataFrame:
    """Ranked predictions of mentions(doc_id, mention_id, mention_order, mention, semantic_group, source) over the tries at manifest.

    A document's mentions are decoded in order. In memory formats each prompt has the best names before it; a task
    searches for up to batch_size documents at once, so a call of the scorer serves all of them and a task holds their
    rows only. In other formats mentions do not wait for each other: each is a document of its own. Several answers to a
    mention are joined by <+>, their distinct codes sorted and joined by +. A mention of a group without names gets
    NO_PREDICTION and NO_CODE; null documents are one document.
    """
    shelf = Shelf(manifest)
    columns = [c.split()[0] for c in ROWS.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = _by_document(batches)
        if context_format not in T.MEMORY_FORMATS:
            documents = ([r] for rows in documents for r in rows)
        searches = (_document(shelf, rows, beams, multiple, context_format) for rows in documents)
        held: list[tuple] = []
        for rows in run(searches, scorer, batch_size):
            held += rows
            if len(held) >= 1_000:
                yield pd.DataFrame(held, columns=columns)
                held = []
        yield pd.DataFrame(held, columns=columns)

    d = mentions.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "mention_id", "mention_order", "mention", "semantic_group", "source")
    d = storage.spread(d, "doc_id").sortWithinPartitions("doc_id", "mention_order", "mention_id")
    return d.mapInPandas(work, ROWS)


class SamePlace:
    """A scorer without a model, of exact numbers: a token scores by its id, better where the mention's own words have it.

    The mention is split at <+> and spaces; PLUS stands for each <+> and SEP for its end. The token that the mention has
    at this place scores -(1 + id % 7) / 8, any other -4 - (1 + id % 7) / 8; each line of memory in the prompt
    takes another 1 / 16 off.
    """

    def __init__(self, ids: Callable[[str], list[int]]):
        self.ids = ids
        self.calls = 0
        self._own: dict[str, list[int]] = {}
        self._lines: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_own": {}, "_lines": {}}

    def _wanted(self, r: Request) -> tuple[int, float]:
        """The mention's own token at this place, and what the prompt's memory takes off."""
        for kept in (self._own, self._lines):
            if len(kept) > 4_096:
                kept.clear()
        if r.mention not in self._own:
            self._own[r.mention] = [t for k, p in enumerate(r.mention.split("<+>")) for t in ([PLUS] if k else []) + self.ids(p)] + [SEP]
        if r.prompt not in self._lines:
            _, _, after = r.prompt.partition("### Previous Normalizations\n")
            self._lines[r.prompt] = after.partition("\n\n")[0].count("]{") / 16
        own = self._own[r.mention]
        return own[len(r.prefix)] if len(r.prefix) < len(own) else SEP, self._lines[r.prompt]

    def __call__(self, requests: list[Request]) -> list[list[float]]:
        self.calls += 1
        out = []
        for r in requests:
            want, lines = self._wanted(r)
            out.append([(0.0 if t == want else -4.0) - (1 + t % 7) / 8 - lines for t in r.allowed])
        return out

    def best(self, requests: list[Request]) -> list[Best]:
        """The best of __call__(): the wanted token, then the others in an order that is the same for all requests of a place."""
        self.calls += 1
        out = []
        for r in requests:
            want, lines = self._wanted(r)
            ids = r.choices.ids
            at = int(np.searchsorted(ids, want))
            found = at < len(ids) and ids[at] == want
            tokens = [want] if found else []
            if len(tokens) < r.beams:
                others = r.choices.made("same place", lambda x: x[np.argsort((x % 7).astype(np.int8), kind="stable")])[: r.beams + 1].tolist()
                tokens += [t for t in others if t != want]
            out.append([(t, (0.0 if t == want else -4.0) - (1 + t % 7) / 8 - lines) for t in tokens[: r.beams]])
        return out


def word_ids(text: str) -> list[int]:
    """hashed_words() of a text on the Python side, without the end."""
    import hashlib

    from .tokentrie import FIRST

    return [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) + FIRST for w in text.split(" ")]
