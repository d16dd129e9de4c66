"""Runs: stretches of words that repeat with a period, as long as they go.

The words of some documents are numbered, each document with numbers of its own and a number for its end, and form one
sequence. Sorting by doubled prefixes gives its suffix array and a name for each stretch of 1, 2, 4, ... words, by which
common extensions of two places are measured. From suffix array and longest common prefixes of neighbours follow the
longest previous factor of each place and the blocks of the Lempel-Ziv parse. A run that meets a border of blocks has no
longer period than the two blocks beside it, or it would have made the first block longer: extensions to both sides of
each border find it (Main). All others lie inside of a block and are copied from the place that the block repeats, from
left to right by their starts (Kolpakov and Kucherov).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that are worked on together; a longer document is worked on alone.
TOGETHER = 1 << 17
#: Borders and periods that are tried at once.
AT_ONCE = 1 << 19


class Suffixes:
    """Suffix array of a sequence, and the names of its stretches of 2^k letters at level k, as far as two are alike.

    The last letter must occur once only. Equal names are equal stretches; the names of a level sort like the stretches.
    """

    def __init__(self, s: np.ndarray):
        n = len(s)
        order = np.argsort(s, kind="stable")
        self.order = order
        names = np.empty(n, np.int32)
        slots = np.arange(n)
        names[order], slots = self._heads(s[order], slots)
        self.names = [names]
        h = 1
        while len(slots):
            at = order[slots]
            key = names[at].astype(np.int64) * n + names[at + h]
            by = np.argsort(key, kind="stable")
            at = at[by]
            order[slots] = at
            names = names.copy()
            names[at], slots = self._heads(key[by], slots)
            self.names.append(names)
            h *= 2
        if len(self.names) > 1:
            self.names.pop()  # no two are alike

    @staticmethod
    def _heads(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of equal sorted keys for each, and the slots whose keys are not alone."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        alone = np.bincount(group, minlength=1)[group] == 1 if len(keys) else new
        return slots[np.flatnonzero(new)][group], slots[~alone]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the sequence has in common from places i and j on."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the sequence has in common before places i and j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            some = (a >= 0) & (b >= 0)
            step = (some & (self.names[k][np.where(some, a, 0)] == self.names[k][np.where(some, b, 1)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i


def previous_factors(x: Suffixes) -> tuple[list[int], list[int]]:
    """For each place the length of the longest stretch that began earlier too, and where it began.

    The earlier place with the longest common prefix is the nearest earlier one before or after in the suffix array.
    """
    n = len(x.order)
    length, source = [0] * n, [0] * n
    like = np.flatnonzero(x.names[0][x.order[1:]] == x.names[0][x.order[:-1]]) + 1
    lcp = np.zeros(n, np.int64)
    lcp[like] = x.ahead(x.order[like - 1], x.order[like])
    # only stretches of the array whose neighbours have something in common matter
    inner = np.zeros(n, bool)
    inner[like] = inner[like - 1] = True
    at = np.flatnonzero(inner)
    open_: list[tuple[int, int, int]] = []  # (place, common with the nearest earlier one before, that place)
    for place, common_ in zip([*x.order[at].tolist(), -1], [*lcp[at].tolist(), 0], strict=True):
        while open_ and (open_[-1][0] > place or common_ == 0):
            p, before, where = open_.pop()
            if common_ > before:
                length[p], source[p] = common_, place
            else:
                length[p], source[p] = before, where
            common_ = min(common_, before)
        open_.append((place, common_, open_[-1][0] if open_ else -1))
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Where the blocks of the Lempel-Ziv parse start, and the end."""
    starts, at, n = [], 0, len(length)
    while at < n:
        starts.append(at)
        at += length[at] or 1
    return [*starts, n]


def at_borders(s: np.ndarray, x: Suffixes, borders: np.ndarray, least: int, power: int) -> np.ndarray:
    """Rows (start, length, period) of the runs that meet a border of blocks."""
    n = len(s)
    sizes = np.diff(borders)
    tried = sizes + np.concatenate([[0], sizes[:-1]])  # periods tried at the start of each block, and at the end
    at, tried = borders[1:], np.concatenate([tried[1:], sizes[-1:]])
    total = np.concatenate([[0], np.cumsum(tried)])
    found = [np.zeros((0, 3), np.int64)]
    for a in range(0, int(total[-1]), AT_ONCE):
        f = np.arange(a, min(int(total[-1]), a + AT_ONCE))
        b = np.searchsorted(total, f, side="right") - 1
        period, b = f - total[b] + 1, at[b]
        for i in (b - period, b):  # a period at least before the border, or after it
            j = i + period
            can = np.flatnonzero((i >= 0) & (j < n))
            i, j, p = i[can], j[can], period[can]
            can = np.flatnonzero((s[i] == s[j]) | ((i > 0) & (s[i - 1] == s[j - 1])))
            i, j, p = i[can], j[can], p[can]
            start, end = i - x.back(i, j), j + x.ahead(i, j)
            ok = end - start >= np.maximum(least, power * p)
            found.append(np.stack([start, end - start, p], axis=1)[ok])
    return _primitive(np.concatenate(found))


def _primitive(runs: np.ndarray) -> np.ndarray:
    """The runs by start and length, each with its least period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def copied(met: np.ndarray, starts: list[int], source: list[int], least: int) -> list[tuple[int, int, int]]:
    """The runs inside of blocks: copies of those where the block was before, which may be copies themselves."""
    known = [tuple(r) for r in met.tolist()]
    first = [r[0] for r in known]
    copies: list[tuple[int, int, int]] = []
    places: list[int] = []
    for b, e in zip(starts, starts[1:], strict=False):
        if e - b < least + 2:
            continue
        shift = b - source[b]
        i, j = bisect_right(first, b - shift), bisect_right(places, b - shift)
        end = e - shift
        while True:
            # the runs of the earlier place by their starts; a block that repeats itself meets its own copies here
            here = known[i] if i < len(known) and known[i][0] < end else None
            there = copies[j] if j < len(copies) and copies[j][0] < end else None
            if here is None and there is None:
                break
            if there is None or here is not None and here[0] <= there[0]:
                start, size, period = here
                i += 1
            else:
                start, size, period = there
                j += 1
            if start + size < end:
                copies.append((start + shift, size, period))
                places.append(start + shift)
    return copies


def runs(s: np.ndarray, least: int = 2, power: int = 2) -> np.ndarray:
    """All runs (start, length, period) of a sequence whose last letter is its own, by start and period.

    A run is as long as it goes with its least period; those of least letters and power periods at least are given.
    """
    if len(s) < 2:
        return np.zeros((0, 3), np.int64)
    x = Suffixes(s)
    length, source = previous_factors(x)
    starts = blocks(length)
    met = at_borders(s, x, np.array(starts), least, power)
    more = copied(met, starts, source, max(least, power))
    out = np.concatenate([met, np.array(more, np.int64).reshape(-1, 3)])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def documents(words: list[list[bytes]], least: int, power: int) -> list[np.ndarray]:
    """The runs of each document of some."""
    numbers, next_, starts = [], 0, []
    for w in words:
        starts.append(len(numbers))
        own = {x: k for k, x in enumerate(dict.fromkeys(w), next_)}
        numbers.extend(map(own.__getitem__, w))
        next_ += len(own)
        numbers.append(next_)
        next_ += 1
    found = runs(np.array(numbers, np.int64), least, power)
    cuts = np.searchsorted(found[:, 0], starts)
    return [part - [start, 0, 0] for part, start in zip(np.split(found, cuts[1:]), starts, strict=True)] if words else []


def kept(words: list[bytes], found: np.ndarray) -> bytes:
    """The words, one space between two, without those that a run contains after its first period."""
    if not len(found):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(texts: Iterable[str | None], least: int, power: int) -> pa.StructArray:
    found: list[np.ndarray] = []
    collapsed: list[bytes] = []
    held: list[list[bytes]] = []

    def work() -> None:
        for w, r in zip(held, documents(held, least, power), strict=True):
            found.append(r)
            collapsed.append(kept(w, r))
        held.clear()

    size = 0
    for t in texts:
        w = (t or "").encode("utf-8").split()
        if held and size + len(w) > TOGETHER:
            work()
            size = 0
        held.append(w)
        size += len(w)
    work()
    flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, each), pa.array([c.decode() for c in collapsed], pa.string())], names=["runs", "collapsed"])


def find(docs: DataFrame, least: int = 6, power: int = 4, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs and a last column __periodic: struct(runs, collapsed).

    runs are the text's maximal stretches of words with a least period of which they are power times as long at least,
    and of least words: start, length and period in words, by start, then period. collapsed is the text, its words one
    space apart, without those that a run contains after its first period. Words end at ASCII white space. Null, empty
    and blank texts have no run and collapse to an empty text; texts are whole, however long: a worker holds a few
    numbers for each word and power of two up to the longest repeat. Repeated rows get equal values, an empty table
    stays empty; docs must not have a column of that name (ValueError).
    """
    if "__periodic" in docs.columns:
        raise ValueError("docs has a column __periodic already")
    if power < 2:
        raise ValueError("a run is two periods long at least")
    common.bounded_batches(docs.sparkSession)

    @F.arrow_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def periodic(text: pa.Array) -> pa.Array:
        return _batch((t.as_py() for t in text), least, power)

    return docs.withColumn("__periodic", periodic(docs[text_col]))
