"""BPE encoding by guess and check, and decoding.

Words are first cut greedily: at each place the longest token of the vocabulary. A cut is what the merges give exactly if
every token is (merging its own letters gives it) and no merge reaches over a border of two neighbours. The check walks
both merge trees at a border backwards in time, for all borders of a batch at once: while the left token's last part x and
the right token's first part y stand side by side, merging (x, y) must not come before either is merged with its other
neighbour. Only words with a border that fails are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, filterfalse

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs of letters between white space after which a worker forgets those it has not met since, and the longest it keeps, in bytes.
REMEMBERED, LONG = 400_000, 100
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Later than any merge.
NEVER = np.int64(1) << 40
NONE = 1 << 40
#: Stands where a word ends; words over bytes do not have it.
END = "\0"
#: Letters of a word up to which merging looks through a list; longer words have a heap.
SHORT = 40
#: Fixed value: the pattern by which the known files cut words. Runs of printable ASCII are cut together with its ASCII part.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_CUT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\na-z0-9]+")
_PRINTABLE = re.compile(rb"[!-~]+")


@dataclass
class Merges:
    """Tokens and merges of a vocabulary whose tokens are numbered 0 to n - 1."""

    #: Token of each letter inside of a word, and of each letter that ends one.
    inner: dict[str, int]
    ends: dict[str, int]
    #: (left, right, token) by rank.
    steps: list[tuple[int, int, int]]

    def __post_init__(self):
        n = 1 + max(chain(self.inner.values(), self.ends.values(), (s[2] for s in self.steps)), default=0)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.born = np.full(n, -1, np.int64)
        self.rank = {(a, b): k for k, (a, b, _) in reversed(list(enumerate(self.steps)))}
        self.into = [t for _, _, t in self.steps]
        self.machine = None
        spelt = {t: (c, False) for c, t in self.inner.items()} | {t: (c, True) for c, t in self.ends.items()}
        #: Whether time can be read off the ranks: a token has one merge, and its parts are made before it.
        self.ordered = len(self.rank) == len(self.steps)
        for k, (a, b, t) in enumerate(self.steps):
            self.ordered &= t not in spelt and a in spelt and b in spelt
            if a not in spelt or b not in spelt or t in spelt:
                continue
            self.left[t], self.right[t], self.born[t] = a, b, k
            spelt[t] = (spelt[a][0] + spelt[b][0], spelt[b][1])
        self.spelt = spelt
        pairs = sorted((a * n + b, k) for (a, b), k in self.rank.items())
        self.keys, self.ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        self.whole = self._whole()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * len(self.left) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def fits(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge reaches over the border of tokens a and b before the time until, when they may be merged with each other."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        gone_a = np.full(len(a), NEVER) if until is None else until.copy()
        gone_b = gone_a.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self._rank(x, y)
            # at equal ranks the leftmost merge comes first: the one inside of a, but not the one inside of b
            bad = (r < NEVER) & (r < gone_a[live]) & (r <= gone_b[live])
            ok[live[bad]] = False
            born_x, born_y = self.born[x], self.born[y]
            live = live[~bad & (np.maximum(born_x, born_y) >= 0)]
            x, y = a[live], b[live]
            later = self.born[x] > self.born[y]
            i, j = live[later], live[~later]
            gone_a[i], a[i] = self.born[a[i]], self.right[a[i]]
            gone_b[j], b[j] = self.born[b[j]], self.left[b[j]]
        return ok

    def _whole(self) -> np.ndarray:
        """Tokens that merging their own letters gives."""
        ok = np.ones(len(self.left), bool)
        made = np.flatnonzero(self.born >= 0)
        ok[made] = self.fits(self.left[made], self.right[made], self.born[made])
        for t in made[np.argsort(self.born[made])]:
            ok[t] = ok[t] and ok[self.left[t]] and ok[self.right[t]]
        return ok

    def guess(self, words: list[str]) -> list[list[int]]:
        """The longest token at each place of each word; none for a word whose end no such token meets.

        An Aho-Corasick automaton walks over all words in one string; where a word ends stands a letter of its own, which
        the tokens that close words end in.
        """
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for t, (spelt, closes) in self.spelt.items():
                self.machine.add_word(spelt + END if closes else spelt, (t, closes))
            self.machine.make_automaton()
        out: list[list[int]] = []
        own: list[int] = []
        ends = list(accumulate(len(w) + 1 for w in words))
        k, end = 0, ends[0] if words else 0
        for at, (t, closes) in self.machine.iter_long(END.join([*words, ""])):
            while at >= end:
                out.append([])
                own = []
                k += 1
                end = ends[k]
            own.append(t)
            if closes:
                out.append(own)
                own = []
                k += 1
                end = ends[k] if k < len(ends) else end
        return out + [[] for _ in range(len(words) - len(out))]

    def merged(self, word: str) -> list[int]:
        """The tokens of a word, merge by merge: the least rank first, of equal ranks the leftmost."""
        if not word:
            return []
        tokens = [self.inner[c] for c in word[:-1]] + [self.ends[word[-1]]]
        return self._by_list(tokens) if len(tokens) <= SHORT else self._by_heap(tokens)

    def _by_list(self, tokens: list[int]) -> list[int]:
        rank, into = self.rank.get, self.into
        ranks = [rank(x, NONE) for x in zip(tokens, tokens[1:])]  # noqa: B905
        while ranks and (r := min(ranks)) != NONE:
            i = ranks.index(r)
            tokens[i] = t = into[r]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((tokens[i - 1], t), NONE)
            if i < len(ranks):
                ranks[i] = rank((t, tokens[i + 1]), NONE)
        return tokens

    def _by_heap(self, tokens: list[int]) -> list[int]:
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := self.rank.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else n
            if j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = self.into[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := self.rank.get((tokens[k], tokens[after[k]]))) is not None:
                    heapq.heappush(heap, (q, k, tokens[k], tokens[after[k]]))
        return [t for t in tokens if t >= 0]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word: guesses, checked together, and merges of those that fail."""
        guesses = self.guess(words) if self.ordered else [[] for _ in words]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        of = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        failed = np.array([not g for g in guesses], bool)
        failed[of[~self.whole[flat]]] = True
        side = np.flatnonzero(of[1:] == of[:-1])
        failed[of[side[~self.fits(flat[side], flat[side + 1])]]] = True
        for k in np.flatnonzero(failed):
            guesses[k] = self.merged(words[k])
        return guesses


class Encoder:
    """Encodes texts with a file of the `tokenizers` library: BPE over bytes, words with an end, white space dropped."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        bpe, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        cuts = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        drops = [p for p in cuts if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
        if bpe["type"] != "BPE" or not suffix or bpe.get("continuing_subword_prefix") or bpe.get("ignore_merges") or bpe.get("dropout") or not drops or spec.get("decoder"):
            raise ValueError("only BPE files with word ends, words without white space and no decoder are known")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are known")
        vocab = bpe["vocab"]
        letters = {t for t in vocab if len(t) == 1}
        split = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        self.merges = Merges({c: vocab[c] for c in letters}, {c: vocab[c + suffix] for c in letters if c + suffix in vocab}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in split])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(set(t) & set(" \t\n\x0b\f\r") for t in self.added):
            raise ValueError("added tokens with white space are not known")
        self.names = {t: w for w, t in vocab.items()} | {t: w for w, t in self.added.items()}
        self.find = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.marks = re.compile(self.find.pattern.encode()) if self.added else None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.known_cut = kinds == ["NFC", "Replace", "Lowercase"] and [p["pattern"].get("Regex") for p in drops] == [CUT] and [p["type"] for p in cuts] == ["Split", "ByteLevel"]
        whole = Tokenizer.from_str(model)
        self.clean, self.cut = whole.normalizer, whole.pre_tokenizer
        #: The ids of runs, as 32-bit numbers: those met since kept was full last, and those met before that.
        self.kept: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _words(self, text: str) -> list[str]:
        return [w for w, _ in self.cut.pre_tokenize_str(self.clean.normalize_str(text) if self.clean else text)]

    def _cut(self, texts: list[str]) -> list[list[str]]:
        """_words() of each text without ASCII white space, all in one call where none has other white space either."""
        whole = self.clean.normalize_str("\n".join(texts)) if self.clean else "\n".join(texts)
        lengths = [len(t) + 1 for t in whole.split(" ")]
        if len(lengths) != len(texts):
            return [self._words(t) for t in texts]
        out: list[list[str]] = [[] for _ in texts]
        ends = list(accumulate(lengths))
        k = 0
        for w, (a, _) in self.cut.pre_tokenize_str(whole):
            while a >= ends[k]:
                k += 1
            out[k].append(w)
        return out

    def _parts(self, run: bytes) -> Iterator[str | int]:
        """The words and added tokens of a run of letters without ASCII white space; nothing reaches from one run to another."""
        text, at = run.decode("utf-8"), 0
        for m in self.find.finditer(text):
            yield from self._words(text[at : m.start()])
            yield self.added[m.group()]
            at = m.end()
        yield from self._words(text[at:])

    def _learn(self, runs: set[bytes]) -> None:
        plain, other, parts = [], [], {}
        marked = self.marks is not None and self.marks.search(b"\n".join(runs)) is not None
        for r in runs:
            if marked and self.marks.search(r):
                parts[r] = list(self._parts(r))
            elif self.known_cut and _PRINTABLE.fullmatch(r):
                plain.append(r)
            else:
                other.append(r)
        parts |= zip(other, self._cut([r.decode() for r in other]), strict=True)
        own: list[str] = []
        ends = iter(plain)
        if plain:
            for w in _ASCII_CUT.findall(b"\n".join([*plain, b""]).decode().lower()):
                if w == "\n":
                    parts[next(ends)] = own
                    own = []
                else:
                    own.append(w)
        words = list({p for ps in parts.values() for p in ps if isinstance(p, str)})
        tokens: dict[str | int, bytes] = {w: array("i", t).tobytes() for w, t in zip(words, self.merges.encode(words), strict=True)}
        tokens |= {t: array("i", [t]).tobytes() for t in self.added.values()}
        for r, ps in parts.items():
            self.kept[r] = tokens[ps[0]] if len(ps) == 1 else b"".join([tokens[p] for p in ps])

    def texts(self, texts: Iterable[str | bytes | None]) -> list[np.ndarray]:
        """The token ids of each text, given as text or as UTF-8. New runs are learnt together, for a megabyte of text at a time."""
        ids: list[list[np.ndarray]] = []
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for k, text in enumerate(texts):
            ids.append([])
            for piece in pieces(text.encode("utf-8") if isinstance(text, str) else text or b""):
                held.append((k, piece.split()))
                size += len(piece)
                if size >= PIECE:
                    self._look_up(held, ids)
                    held, size = [], 0
        self._look_up(held, ids)
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in ids]

    def _look_up(self, held: list[tuple[int, list[bytes]]], ids: list[list[np.ndarray]]) -> None:
        if len(self.kept) >= REMEMBERED:
            self.kept, self.before = {}, self.kept
        new = set(filterfalse(self.kept.__contains__, chain.from_iterable(runs for _, runs in held)))
        if new:
            again = new & self.before.keys()
            self.kept.update((r, self.before[r]) for r in again)
            if new := new - again:
                self._learn(new)
        for k, runs in held:
            ids[k].append(np.frombuffer(b"".join(map(self.kept.__getitem__, runs)), np.int32))
        for r in new:
            if len(r) > LONG:
                del self.kept[r]


_GAP = re.compile(rb"[ \t-\r]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """text in pieces of size bytes and up to the next white space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(len(text), at + size))
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


#: The encoder of a worker; it serves all its tasks, so that words are learnt once.
_MADE: dict[str, Encoder] = {}


def encoder(key: str, model) -> Encoder:
    """The encoder of a broadcast file, by the file's digest."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(model.value)
    return _MADE[key]


def joined(ids: pa.ListArray, spelt: pa.Array) -> pa.Array:
    """The tokens of each list, one space between two; ids without a token are left out."""
    flat, rows = ids.flatten(), pc.list_parent_indices(ids)
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(spelt))), False)
    if not pc.all(known).as_py():
        flat, rows = flat.filter(known), rows.filter(known)
    words = spelt.take(flat)
    counts = np.bincount(rows.filter(words.is_valid()).to_numpy(), minlength=len(ids))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), words.drop_null())
    return pc.if_else(ids.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))


class Bpe:
    """Column functions over one vocabulary file, which goes to the workers as a broadcast of a few megabytes."""

    def __init__(self, docs: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            model = f.read()
        common.bounded_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast(model)
        names = Encoder(model).names
        key = hashlib.sha256(model.encode()).hexdigest()

        spelt = docs.sparkSession.sparkContext.broadcast(pa.array([names.get(k) for k in range(max(names) + 1)], pa.string()))

        def lists(text: pa.Array) -> pa.ListArray:
            ids = encoder(key, shared).texts(text.cast(pa.large_binary()).to_pylist())
            ends = np.cumsum([0, *map(len, ids)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))

        @F.arrow_udf("array<int>")
        def encode(text: pa.Array) -> pa.Array:
            return lists(text)

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            return joined(ids, spelt.value)

        @F.arrow_udf("ids array<int>, decoded string")
        def both(text: pa.Array) -> pa.Array:
            ids = lists(text)
            return pa.StructArray.from_arrays([ids, joined(ids, spelt.value)], names=["ids", "decoded"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """The ids of a text's tokens; a null text has none, like an empty one. The strings of added tokens are those tokens."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The tokens of ids as text, one space between two; ids that no token has are left out. Null for null."""
        return self._decode(ids)

    def both(self, text: Column) -> Column:
        """struct(ids, decoded) of a text, whose tokens are made once."""
        return self._both(text)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs and last columns __ids and __decoded: the tokens of the whole text, and the text they stand for.

    path is a file of the `tokenizers` library on the driver. A text is worked on in pieces of a megabyte, so very long
    texts are whole; repeated rows get equal values; an empty table stays empty; docs must not have columns of these two
    names (ValueError).
    """
    if {"__ids", "__decoded"} & set(docs.columns):
        raise ValueError("docs has a column __ids or __decoded already")
    d = docs.select(*(docs[c] for c in docs.columns), Bpe(docs, path).both(docs[text_col]).alias("__t"))
    return d.select(*(d[c] for c in docs.columns), d["__t.ids"].alias("__ids"), d["__t.decoded"].alias("__decoded"))
