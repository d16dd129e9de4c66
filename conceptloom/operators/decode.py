"""Constrained decoding: prefix edges, allowed continuations, running memory and parsed predictions."""

from __future__ import annotations

import bisect
import difflib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import storage

END = "</s>"
MEMORY_BONUS = 0.01
#: Names bounded at once by their common subsequence with a mention, and how long a name may be for that.
LCS_BLOCK, LCS_LENGTH = 1 << 11, 64
#: scorer(prompt, mention, candidates, memory) -> (candidate, score) pairs, best first.
Scorer = Callable[[str, str, list[str], str], list[tuple[str, float]]]


def sequences(names: DataFrame) -> DataFrame:
    """(grp, seq): word sequences of a group's names, with an end."""
    return names.select("grp", F.concat(F.split(T.clean_natural(F.col("entity")), " "), F.array(F.lit(END))).alias("seq")).distinct()


def trie_edges(seqs: DataFrame) -> DataFrame:
    """(grp, prefix, next) of every step of every sequence."""
    d = seqs.select("grp", "seq", F.explode(F.sequence(F.lit(0), F.size("seq") - 1)).alias("i"))
    return d.select("grp", F.slice("seq", 1, F.col("i")).alias("prefix"), F.get("seq", F.col("i")).alias("next")).distinct()


def allowed_next(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes(grp, prefix) with the sorted continuations; none for prefixes that are no beginning."""
    a = edges.groupBy("grp", "prefix").agg(F.array_sort(F.collect_set("next")).alias("allowed"))
    return prefixes.join(a, ["grp", "prefix"], "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


def trie_sequences(edges: DataFrame) -> DataFrame:
    """(grp, seq): all whole sequences of a prefix table: prefixes that may end."""
    return edges.where(F.col("next") == END).select("grp", F.col("prefix").alias("seq")).distinct()


def parse_predictions(outputs: DataFrame, names: DataFrame, multiple: bool = False) -> DataFrame:
    """outputs(id, semantic_group, output) with pred_concept_name and pred_concept_code.

    The name is what follows the last '} '; its code is that of the group's dictionary, else NO_CODE. With multiple, the
    parts between <+> have a code each; NO_CODE is left out if another was found, and codes are joined in order.
    """
    d = outputs.withColumn("pred_concept_name", T.predicted_name(F.col("output")))
    n = names.select(F.col("grp").alias("semantic_group"), F.col("entity").alias("__name"), F.col("code").alias("__code"))
    part = F.explode(F.split("pred_concept_name", r"<\+>")) if multiple else F.col("pred_concept_name")
    p = d.select("id", "semantic_group", part.alias("__name")).withColumn("__name", T.strip(F.col("__name")))
    found = p.join(n, ["semantic_group", "__name"], "left").groupBy("id").agg(F.array_sort(F.collect_set("__code")).alias("__codes"))
    code = F.when(F.size("__codes") > 0, F.array_join("__codes", "+")).otherwise(F.lit("NO_CODE"))
    return d.join(found, "id", "left").withColumn("pred_concept_code", F.coalesce(code, F.lit("NO_CODE"))).drop("__codes")


def similarity_scorer(prompt: str, mention: str, candidates: list[str], memory: str) -> list[tuple[str, float]]:
    """A scorer without a model: string similarity, names already in memory a little better; names without any are left out."""
    m = mention.lower()
    ratios = ((c, difflib.SequenceMatcher(None, m, c.lower()).ratio()) for c in candidates)
    scored = [(c, r + (MEMORY_BONUS if f"}} {c}" in memory else 0.0)) for c, r in ratios if r > 0]
    return sorted(scored, key=lambda x: (-x[1], x[0]))


class NearestNames:
    """The best of similarity_scorer over all names of a group, without scoring those that their letters rule out.

    Letters in common bound the similarity from above; names are scored from the highest bound on, until no bound left can
    reach the best found. Memory adds at most MEMORY_BONUS, so a short list a mention serves for any memory; it is kept.
    """

    def __init__(self, names: list[str]):
        self.names, self.kept = names, {}
        low = [n.lower() for n in names]
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(low))))}
        self.counts = np.zeros((len(self.letters), len(names)), np.uint16 if max(map(len, low), default=0) < 1 << 16 else np.int32)
        for k, n in enumerate(low):
            for c in n:
                self.counts[self.letters[c], k] += 1
        self.sizes = np.array([len(n) for n in low])
        self.low = low
        self.codes = np.zeros((len(names), min(LCS_LENGTH, max(self.sizes, default=0))), np.uint8)
        if len(self.letters) < 256:
            for k, n in enumerate(low):
                self.codes[k, : len(n)] = [self.letters[c] + 1 for c in n[:LCS_LENGTH]] if len(n) <= LCS_LENGTH else 0

    def _tighter(self, m: str, at: np.ndarray) -> np.ndarray:
        """Bounds of some names by the longest common subsequence, which the matching blocks are part of; 1 where it is not known."""
        if not 0 < len(m) <= 63 or len(self.letters) >= 256:
            return np.ones(len(at))
        # bit-parallel, a word of 64 bits a name: a zero bit of v for each letter of the subsequence
        masks = np.zeros(256, np.uint64)
        for i, c in enumerate(m):
            if c in self.letters:
                masks[self.letters[c] + 1] |= np.uint64(1 << i)
        v = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
        codes = self.codes[at]
        for j in range(codes.shape[1]):
            u = v & masks[codes[:, j]]
            v = (v + u) | (v - u)
        length = len(m) - np.bitwise_count(v & np.uint64((1 << len(m)) - 1)).astype(np.int64)
        return np.where(self.sizes[at] <= LCS_LENGTH, 2.0 * length / (self.sizes[at] + len(m)), 1.0)

    def _bounds(self, m: str) -> np.ndarray:
        common = np.zeros(len(self.names), np.int64)
        for c in set(m) & self.letters.keys():
            common += np.minimum(self.counts[self.letters[c]], m.count(c))
        bound = 2.0 * common / np.maximum(1, self.sizes + len(m))
        if not m:
            bound[self.sizes == 0] = 1.0  # two empty texts are alike
        return bound

    @staticmethod
    def _blocks(bound: np.ndarray) -> Iterator[np.ndarray]:
        """Places by falling bound, a block at a time; the rest is sorted only if it is asked for."""
        rest = np.arange(len(bound))
        while len(rest) > LCS_BLOCK:
            cut = np.argpartition(-bound[rest], LCS_BLOCK - 1)
            yield rest[cut[:LCS_BLOCK]]
            rest = rest[cut[LCS_BLOCK:]]
        yield rest

    def _short(self, m: str, beams: int) -> list[tuple[str, float]]:
        """The names that can be among the best for some memory, with their similarity."""
        bound = self._bounds(m)
        top: list[float] = []
        found = []
        for block in self._blocks(bound):
            best = bound[block].max(initial=0.0)
            if best <= 0 or len(top) == beams and best + MEMORY_BONUS < -top[-1] - 1e-9:
                break
            tight = np.minimum(bound[block], self._tighter(m, block))
            by = np.argsort(-tight, kind="stable")
            for k, b in zip(block[by].tolist(), tight[by].tolist(), strict=True):
                if b <= 0 or len(top) == beams and b + MEMORY_BONUS < -top[-1] - 1e-9:
                    break
                ratio = difflib.SequenceMatcher(None, m, self.low[k]).ratio()
                if ratio > 0:
                    found.append((self.names[k], ratio))
                    bisect.insort(top, -ratio)
                    del top[beams:]
        least = -top[-1] - MEMORY_BONUS - 1e-9 if len(top) == beams else 0.0
        return [x for x in found if x[1] >= least]

    def best(self, mention: str, memory: str, beams: int) -> list[tuple[str, float]]:
        key = (mention.lower(), beams)
        if key not in self.kept:
            if len(self.kept) >= 10_000:
                self.kept.clear()
            self.kept[key] = self._short(*key)
        scored = [(name, r + (MEMORY_BONUS if f"}} {name}" in memory else 0.0)) for name, r in self.kept[key]]
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:beams]


class Groups:
    """Names by group, read from the shared folder one group at a time; a worker keeps the last few."""

    def __init__(self, path: str, keep: int = 16):
        self.path, self.keep, self.held = path, keep, {}

    @staticmethod
    def write(names: DataFrame) -> str:
        """Writes names(grp, entity, code), the least code of a name, in a folder for each group, and returns the path."""
        path = storage.fresh_path(names.sparkSession, "names")
        d = names.where("entity is not null AND grp is not null").groupBy("grp", "entity").agg(F.min("code").alias("code"))
        d.withColumn("__g", F.md5("grp")).repartition("__g").write.partitionBy("__g").parquet(path)
        return path

    def __call__(self, group: str | None, make: Callable[[dict[str, str]], object]):
        """What make() makes of the group's names and codes."""
        if group not in self.held:
            while len(self.held) >= self.keep:
                del self.held[next(iter(self.held))]
            self.held[group] = make(self._names(group))
        return self.held[group]

    def _names(self, group: str | None) -> dict[str, str]:
        import hashlib

        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        if group is None:
            return {}
        fs, root = pafs.FileSystem.from_uri(self.path)
        at = f"{root}/__g={hashlib.md5(group.encode()).hexdigest()}"
        found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        rows = [r for x in found if x.path.endswith(".parquet") for r in pq.ParquetFile(fs.open_input_file(x.path)).read(["entity", "code"]).to_pylist()]
        return {r["entity"]: r["code"] for r in sorted(rows, key=lambda r: r["entity"])}


class Trie:
    """All word sequences of a group's names; grows by add()."""

    def __init__(self, names: Iterable[str] = ()):
        self.root: dict = {}
        self._sorted: dict[int, list[str]] = {}
        for n in names:
            self.add(n)

    def add(self, name: str) -> None:
        self._sorted.clear()
        at = self.root
        for word in [*name.split(" "), END]:
            at = at.setdefault(word, {})

    def allowed(self, prefix: Iterable[str]) -> list[str]:
        """The sorted words that may follow a prefix; none where it is no beginning. The list is kept: it is not to be changed."""
        at = self.root
        for word in prefix:
            if (at := at.get(word)) is None:
                return []
        if len(at) < 2:
            return list(at)
        if id(at) not in self._sorted:
            self._sorted[id(at)] = sorted(at)
        return self._sorted[id(at)]


#: step_scorer(prompt, mention, prefix, allowed) -> a log-score of each word that is allowed next. A scorer that knows the
#: best words without a look at all has best(prompt, mention, prefix, allowed, n) -> up to n (word, score), by falling score, ties in word order.
StepScorer = Callable[[str, str, list[str], list[str]], list[float]]


def same_place(prompt: str, mention: str, prefix: list[str], allowed: list[str]) -> list[float]:
    """A step scorer without a model: 0 for the mention's own word at this place (its end after its last one), else -1."""
    want = _own_word(mention, prefix)
    return [0.0 if w == want else -1.0 for w in allowed]


def _own_word(mention: str, prefix: list[str]) -> str:
    words = mention.split(" ")
    return words[len(prefix)] if len(prefix) < len(words) else END


def _best_at_place(prompt: str, mention: str, prefix: list[str], allowed: list[str], n: int) -> list[tuple[str, float]]:
    want = _own_word(mention, prefix)
    at = bisect.bisect_left(allowed, want)
    found = [(want, 0.0)] if at < len(allowed) and allowed[at] == want else []
    return [*found, *((w, -1.0) for w in allowed[: n + 1] if w != want)][:n]


same_place.best = _best_at_place


def beam_search(trie: Trie, score: StepScorer, prompt: str, mention: str, beams: int) -> list[tuple[str, float]]:
    """The names that a beam search over the trie ends in, with their scores, best first, ties in word order.

    Each step extends every open beginning by all words that the trie allows and keeps the beams best; only whole names
    of the trie can come out.
    """
    best = getattr(score, "best", None)
    open_: list[tuple[float, list[str]]] = [(0.0, [])]
    while any(not seq or seq[-1] != END for _, seq in open_):
        grown = []
        for total, seq in open_:
            if seq and seq[-1] == END:
                grown.append((total, seq))
                continue
            words = trie.allowed(seq)
            if best:
                scored = best(prompt, mention, seq, words, beams) if words else []
            else:
                scored = zip(words, score(prompt, mention, seq, words) if words else [], strict=True)
            grown += [(total + s, [*seq, w]) for w, s in scored]
        open_ = sorted(grown, key=lambda x: (-x[0], x[1]))[:beams]
    return [(" ".join(seq[:-1]), total) for total, seq in open_]


def decode_constrained(mentions: DataFrame, names: DataFrame, score: StepScorer = same_place, beams: int = 1) -> DataFrame:
    """Ranked predictions of mentions(mention_id, mention, semantic_group, prompt) over the whole trie of their group.

    (mention_id, pred_concept_name, pred_concept_code, score, rank); mentions of a group without names get NO_PREDICTION
    and NO_CODE. Names are read from the shared folder by group, so neither the driver nor a worker holds them all.
    """
    groups = Groups(Groups.write(names))

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                group = None if pd.isna(r.semantic_group) else r.semantic_group
                codes, trie = groups(group, lambda of: (of, Trie(of)))
                ranked = beam_search(trie, score, r.prompt or "", r.mention or "", beams) or [("NO_PREDICTION", 0.0)]
                out += [(r.mention_id, n, codes.get(n) or "NO_CODE", float(s), k) for k, (n, s) in enumerate(ranked, 1)]
            yield pd.DataFrame(out, columns=["mention_id", "pred_concept_name", "pred_concept_code", "score", "rank"])

    return mentions.select("mention_id", "mention", "semantic_group", "prompt").mapInPandas(decode, "mention_id string, pred_concept_name string, pred_concept_code string, score double, rank int")


def decode_with_memory(mentions: DataFrame, names: DataFrame, scorer: Scorer = similarity_scorer, beams: int = 5, context_format: str = "hybrid_short", step: StepScorer | None = None) -> DataFrame:
    """Ranked predictions of mentions(doc_id, mention_id, mention_order, mention, semantic_group, source).

    A document's mentions are decoded in order, each with what was predicted before it; documents are independent. The
    candidates of a mention are all names of its group; with a step scorer they come from a beam search over the group's
    trie. Names are read from the shared folder by group. Mentions for which nothing is found get NO_CODE.
    """
    groups = Groups(Groups.write(names))
    fast = scorer is similarity_scorer
    schema = "doc_id string, mention_id string, mention string, semantic_group string, source string, target string, previous string, pred_concept_name string, pred_concept_code string, score double, rank int"

    def document(pdf: pd.DataFrame) -> pd.DataFrame:
        memory, out = "", []
        for r in pdf.sort_values(["mention_order", "mention_id"]).itertuples(index=False):
            group = None if pd.isna(r.semantic_group) else r.semantic_group
            of, near, trie = groups(group, lambda x: (x, NearestNames(list(x)) if fast and step is None else None, Trie(x) if step else None))
            opening = f"[{r.mention}]{{{r.semantic_group}}}"
            source = r.source or ""
            prompt = f"### Context\n{source.rstrip()}\n\n### Previous Normalizations\n{memory.rstrip() or 'None'}\n\n### Prediction\n{opening}" if step or not fast else ""
            if step:
                ranked = beam_search(trie, step, prompt, r.mention, beams)
            elif fast:
                ranked = near.best(r.mention, memory, beams)
            else:
                ranked = scorer(prompt, r.mention, list(of), memory)[:beams]
            for k, (name, score) in enumerate(ranked or [("NO_PREDICTION", 0.0)], 1):
                out.append((str(r.doc_id), r.mention_id, r.mention, r.semantic_group, source, opening, memory, name, of.get(name) or "NO_CODE", float(score), k))
            if context_format != "short":
                memory += f"{opening} {ranked[0][0] if ranked else 'NO_PREDICTION'}\n"
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    d = storage.spread(mentions, "doc_id").groupBy("doc_id").applyInPandas(document, schema)
    form = context_format if context_format in T.MEMORY_FORMATS else "hybrid_short"
    prompt = T.inference_prompt(F.col("source"), F.col("target"), F.col("previous"), form)
    return d.withColumn("prompt", prompt).select("doc_id", "mention_id", "mention", "semantic_group", "prompt", "pred_concept_name", "pred_concept_code", "score", "rank")
