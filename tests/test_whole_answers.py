"""Token tries against nested dicts, and searches for several answers against enumerated sequences."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conceptloom.operators import beams, tokentrie
from conceptloom.operators.tokentrie import END, PLUS, SEP, TokenTrie

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def random_sequences(seed, n=60):
    rng = random.Random(seed)
    return sorted({tuple([rng.randint(16, 20) for _ in range(rng.randint(1, 5))] + [END]) for _ in range(n)})


def nested(sequences):
    out = {}
    for s in sequences:
        for i in range(len(s)):
            out.setdefault(s[:i], set()).add(s[i])
    return out


@pytest.mark.parametrize("seed", range(8))
def test_get_like_nested_dicts(seed):
    sequences = random_sequences(seed)
    tries = [TokenTrie.of(sequences), TokenTrie.of(sequences[:20]).extended(TokenTrie.of(sequences[20:])), TokenTrie.of(sequences[::2]).extended(TokenTrie.of(sequences[1::2] + sequences[:5]))]
    want = nested(sequences)
    for t in tries:
        assert sorted({tuple(s) for s in t.sequences()}) == sequences
        for prefix in itertools.chain(want, [(99,), (16, 99), sequences[0]]):
            assert t.get(prefix) == sorted(want.get(prefix, ()))
    assert len(tries[0]) == len(sequences) and TokenTrie([]).get([]) == [] and TokenTrie.of([]).find([16]) is None


def test_spliced():
    other = TokenTrie.of([(30, 31, END)])
    s = tokentrie.Spliced(TokenTrie.of([(16, 17, END), (20, 18, END)]), 20, other)
    assert s.get([]) == [16, 30] and s.get([16]) == [17] and s.get([30]) == [31] and s.get([40]) == []
    assert tokentrie.Spliced(TokenTrie.of([(16, END)]), 99, other).get([]) == [16]


def test_a_million_names_are_small():
    rng = np.random.default_rng(1)
    n, k = 1_000_000, 6
    t = np.concatenate([rng.integers(16, 50_000, (n, k)), np.zeros((n, 1))], axis=1).astype(np.int32)
    t = t[np.lexsort(t.T[::-1])]
    names = pa.array([f"name {i}" for i in range(n)])
    rows = pa.table({"ids": pa.ListArray.from_arrays(pa.array(np.arange(0, n * (k + 1) + 1, k + 1), pa.int32()), pa.array(t.ravel())), "entity": names, "code": names})
    trie = TokenTrie([rows])
    assert len(trie) == n and trie.nbytes < 200e6
    for i in (0, 1, 500_000, n - 1):
        assert trie.step(trie.find(t[i, :k]), END) is not None and trie.name(trie.find(t[i])) == (f"name {i}", f"name {i}")
    assert trie.get([]) == sorted(set(t[:, 0].tolist()))


@pytest.fixture(scope="module")
def names(spark):
    rows = [(g, f"{a} {b}{' of' if i % 2 else ''} {c}", f"c{i % 13}") for i, (g, a, b, c) in enumerate(itertools.product(["hot"], "river stone héron".split(), "a b c".split(), "blue red [x] 12".split()))]
    rows += [("small", "one", "z"), ("small", "one", "b"), ("small", "", "e"), (None, "lost", "n"), ("small", None, "n"), ("other", "x y", None)]
    return spark.createDataFrame(rows, "grp string, entity string, code string")


@pytest.mark.parametrize(("rows", "parts"), [(1 << 18, 1), (5, 3)])
def test_written_tries(spark, names, rows, parts):
    """Tokens of a public vocabulary; a group in many segments and tasks; the least name of a sequence; groups of few names."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    path = tokentrie.write(names, tokentrie.vocabulary(names, VOCABULARY), rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    shelf = tokentrie.Shelf(path, 1)
    want = {}
    for r in names.where("grp is not null and entity is not null").collect():
        clean = r["entity"].translate(str.maketrans("{}[]", "()()"))
        ids = tuple(i + tokentrie.FIRST for i in t.encode(clean, add_special_tokens=False).ids) + (END,)
        key = want.setdefault(r["grp"], {})
        key[ids] = min(key.get(ids, (clean, r["code"])), (clean, r["code"]), key=str)
    for g, of in want.items():
        trie = shelf(g)
        assert sorted(map(tuple, trie.sequences())) == sorted(of) and len(trie.segments) >= len(of) / rows
        assert all(trie.name(trie.find(ids)) == x for ids, x in of.items())
        assert len(shelf._held) == 1
    assert len(shelf("nowhere")) == len(shelf(None)) == 0
    manifest = spark.read.parquet(path)
    e = {(r["grp"], tuple(r["prefix"]), r["next"]) for r in tokentrie.edges(manifest, path).collect()}
    assert e == {(g, ids[:i], ids[i]) for g, of in want.items() for ids in of for i in range(len(ids))}
    if rows == 5:
        assert manifest.where("grp = 'hot'").count() > 5 and manifest.agg(F.max("rows")).head()[0] <= 5


def test_no_names(spark, names):
    path = tokentrie.write(names.where("false"))
    assert len(tokentrie.Shelf(path)("hot")) == 0 and tokentrie.edges(spark.read.parquet(path), path).count() == 0


# --- searches -----------------------------------------------------------------------------------------------------


def score(seed, prefix, token):
    """An exactly specified log-probability of at most zero."""
    h = int(hashlib.md5(repr((seed, tuple(prefix), token)).encode()).hexdigest()[:6], 16)
    return -(1 + h % 64) / 16


def scorer(seed):
    return lambda requests: [[score(seed, r.prefix, t) for t in r.allowed] for r in requests]


def every_answer(sequences, most_names):
    """All answers of up to so many names as token sequences."""
    bodies = [s[:-1] for s in sequences]
    for n in range(1, most_names + 1):
        for names in itertools.product(bodies, repeat=n):
            yield tuple(itertools.chain.from_iterable((PLUS, *b) if k else b for k, b in enumerate(names))) + (SEP,)


def level_by_level(answers, seed, beams_, max_tokens):
    """A beam search over a list of all answers: no trie, no automaton."""
    total = {(): 0.0}
    done = []
    for n in range(1, max_tokens + 1):
        grown = {a[:n] for a in answers if len(a) >= n and a[: n - 1] in total and a[: n - 1][-1:] != (SEP,)}
        ranked = sorted((-(total[g[:-1]] + score(seed, g[:-1], g[-1])), g) for g in grown)[:beams_]
        total = {g: -r for r, g in ranked}
        done += [(-(-r / len(g)), g) for r, g in ranked if g[-1] == SEP]
        done = sorted(done)[:beams_]
        total = {g: x for g, x in total.items() if g[-1] != SEP}
        if not total or len(done) == beams_ and all(x / max_tokens <= -done[-1][0] for x in total.values()):
            break
    return [(g, -s) for s, g in done]


@pytest.mark.parametrize("beam", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("seed", range(6))
def test_beams_against_a_list_of_all_answers(seed, beam):
    sequences = random_sequences(seed, 7)
    trie = TokenTrie.of(sequences, [(f"n{i}", f"c{i}") for i in range(len(sequences))])
    for multiple, most in ((False, 1), (True, 3)):
        limit = 9
        answers = [a for a in every_answer(sequences, most if not multiple else 4) if len(a) <= 40]
        got = next(beams.run([beams.search(trie, "", "", beam, multiple, limit)], scorer(seed)))
        want = level_by_level(answers, seed, beam, limit)
        assert [(tuple(a.tokens), a.score) for a in got] == [(g, pytest.approx(s, abs=1e-12)) for g, s in want]
        for a in got:
            own = [score(seed, a.tokens[:i], t) for i, t in enumerate(a.tokens) if t not in (PLUS, SEP)]
            assert a.confidence == pytest.approx(math.exp(sum(own) / len(own)))
            parts = " ".join(map(str, a.tokens[:-1])).split(f" {PLUS} ")
            assert [n for n, _ in a.names] == [f"n{sequences.index(tuple(map(int, p.split())) + (END,))}" for p in parts]


def test_wide_beams_find_the_best_of_all():
    sequences = random_sequences(3, 6)
    trie = TokenTrie.of(sequences)
    got = next(beams.run([beams.search(trie, "", "", 5_000, False, 9)], scorer(3)))
    want = sorted((-sum(score(3, a[:i], t) for i, t in enumerate(a)) / len(a), a) for a in every_answer(sequences, 1))
    assert [tuple(a.tokens) for a in got] == [a for _, a in want]


def test_empty_name_and_no_names():
    trie = TokenTrie.of([(END,), (16, END)], [("", "e"), ("x", "c")])
    got = next(beams.run([beams.search(trie, "", "", 3)], lambda rs: [[0.0 if t == SEP else -1.0 for t in r.allowed] for r in rs]))
    assert [(a.names, a.tokens) for a in got] == [([("", "e")], [SEP]), ([("x", "c")], [16, SEP])]
    assert list(beams.run([beams.search(TokenTrie([]), "", "")], scorer(1))) == [[]]
    assert list(beams.run([], scorer(1))) == []


def test_documents_share_calls():
    """A call serves all live documents; they enter as others end; rows are those of one document at a time."""
    sequences = random_sequences(5, 30)
    trie = TokenTrie.of(sequences)
    entered = []

    def searches():
        for i in range(20):
            entered.append(i)
            yield document(i)

    def document(i):
        out = []
        for m in range(1 + i % 4):
            out.append((yield from beams.search(trie, f"{i}", f"{m}", 2)))
        return i, [[a.tokens for a in x] for x in out]

    seen, ahead = [], []

    def counting(requests):
        seen.append(len({r.prompt for r in requests}))
        ahead.append(len(entered) - len(finished))
        return [[score(r.prompt + r.mention, r.prefix, t) for t in r.allowed] for r in requests]

    results = {}
    for size in (1, 4, 50):
        seen.clear(), ahead.clear(), entered.clear()
        finished = []
        for r in beams.run(searches(), counting, size):
            finished.append(r)
        results[size] = (sorted(finished), len(seen), max(seen), max(ahead))
    assert results[1][0] == results[4][0] == results[50][0]
    assert results[1][2] == 1 and results[4][2] == 4 and results[50][2] == 20
    assert results[4][3] <= 5 and results[50][1] < results[4][1] < results[1][1] / 3


def test_awkward_mentions(spark, names):
    path = tokentrie.write(names)
    rows = [("d1", "1", 1, "river a blue", "hot", "ctx"), ("d1", "2", 2, None, "hot", None), ("d1", "3", 3, "one", "small", ""), ("d2", "4", 1, "gone", "nowhere", "c"), (None, "5", 1, "x", None, "c"), (None, "5", 1, "x", None, "c"), ("d3", "6", 1, "w " * 3000, "hot", "c")]
    m = spark.createDataFrame(rows, "doc_id string, mention_id string, mention_order int, mention string, semantic_group string, source string")
    for form in ("short", "hybrid_short"):
        out = beams.decode(m, path, beams.SamePlace(beams.word_ids), beams=2, multiple=True, context_format=form).where("rank = 1").collect()
        by = {r["mention_id"]: r for r in out}
        assert len(out) == 7 and by["1"]["pred_concept_name"] == "river a blue" and by["3"]["pred_concept_code"] == "b"
        assert by["4"]["pred_concept_name"] == by["5"]["pred_concept_name"] == "NO_PREDICTION" and by["5"]["pred_concept_code"] == "NO_CODE"
        assert ("[river a blue]{hot} river a blue" in by["3"]["prompt"]) == (form == "hybrid_short")
    assert beams.decode(m.limit(0), path, beams.SamePlace(beams.word_ids)).count() == 0


def test_ranks_of_a_mention_are_dealt_once(spark):
    """Loading and recall at five share one exchange by mention."""
    from conceptloom.operators import metrics

    rows = [(f"d{i}", f"d{i}.1", r, 1.0 / r, "A" if r == 3 else "B", "A", "G") for i in range(20) for r in range(1, 6)]
    raw = spark.createDataFrame(rows, "doc_id string, mention_id string, rank int, score double, pred_concept_code string, gold_concept_code string, semantic_group string")
    out = metrics.recall_at_k(metrics.load_predictions(raw, 5))
    assert {(r["semantic_group"], r["n"], r["n_correct"]) for r in out.collect()} == {("G", 20, 20), ("overall", 20, 20)}
    out = metrics.recall_at_k(metrics.load_predictions(raw, 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
