"""Decoding reaches every name of the group, and equals brute force over all of them."""

import random

from pyspark.sql import functions as F

from conceptloom.operators import decode

MENTION = "doc_id string, mention_id string, mention_order int, mention string, semantic_group string, source string"


def test_nearest_names_as_brute_force():
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abcdeéx ", k=rng.randint(1, 9))).title() for _ in range(400)})
    index = decode.NearestNames(names)
    memory = "".join(f"[q]{{G}} {n}\n" for n in rng.sample(names, 25))
    for _ in range(150):
        m = "".join(rng.choices("abcdexyz", k=rng.randint(0, 8)))
        for mem in ("", memory):
            assert index.best(m, mem, 5) == decode.similarity_scorer("", m, names, mem)[:5]


def test_all_names_are_reachable(spark):
    """A best name of another beginning, and one past the 50 nearest by edit distance."""
    far = [("H", f"ab{i:02d}", f"X{i}") for i in range(60)] + [("H", "abcdefghijklmnop", "LONG")]
    n = spark.createDataFrame([("G", "the heart", "C1"), ("G", "zz", "C2"), *far], "grp string, entity string, code string")
    m = spark.createDataFrame([("d", "d.1", 1, "heart", "G", ""), ("d", "d.2", 2, "abcdefg", "H", "")], MENTION)
    for scorer in (decode.similarity_scorer, lambda *a: decode.similarity_scorer(*a)):
        out = {r["mention_id"]: r["pred_concept_code"] for r in decode.decode_with_memory(m, n, scorer).where("rank = 1").collect()}
        assert out == {"d.1": "C1", "d.2": "LONG"}


def test_beam_search_as_brute_force():
    """With beams enough for every name the search ranks all names of the trie by their summed scores."""
    rng = random.Random(5)
    names = sorted({" ".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(60)})
    trie = decode.Trie(names)

    def score(prompt, mention, prefix, allowed):
        return [-((hash_of(" ".join([*prefix, w])) % 97) / 10) for w in allowed]

    def hash_of(x):
        return sum((i + 1) * ord(c) for i, c in enumerate(x))

    def total(name):
        words = [*name.split(" "), decode.END]
        return sum(score("", "", words[:k], [words[k]])[0] for k in range(len(words)))

    got = decode.beam_search(trie, score, "", "m", beams=1000)
    assert sorted(n for n, _ in got) == names
    assert [round(s, 9) for _, s in got] == sorted((round(total(n), 9) for n in names), reverse=True)
    assert trie.allowed(["no"]) == [] and decode.beam_search(decode.Trie(), score, "", "m", 3) == []
    trie.add("zz top")
    assert "zz" in trie.allowed([]) and trie.allowed(["zz", "top"]) == [decode.END]


def test_constrained_awkward(spark):
    m = spark.createDataFrame([("1", "a b", "G", None), ("2", None, "G", ""), ("3", "a", None, ""), ("4", "a", "none", "")], "mention_id string, mention string, semantic_group string, prompt string")
    n = spark.createDataFrame([("G", "a b", "C2"), ("G", "a b", "C1"), ("G", "c", None), (None, "x", "C9"), ("G", None, "C8")], "grp string, entity string, code string")
    out = {r["mention_id"]: (r["pred_concept_name"], r["pred_concept_code"]) for r in decode.decode_constrained(m, n).collect()}
    assert out == {"1": ("a b", "C1"), "2": ("a b", "C1"), "3": ("NO_PREDICTION", "NO_CODE"), "4": ("NO_PREDICTION", "NO_CODE")}
    assert decode.decode_constrained(m.limit(0), n).count() == 0


def test_run_names_and_options(spark):
    from conceptloom.functions import text as T

    ids = ["m_human_only_short_no_constraint_best", "m_human_only_short_constraint_last", "m_other_short_constraint_last", "plain", "m_human_only_short_constraint"]
    out = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(T.run_id_parts(F.col("x"))).collect()]
    assert out[0].asDict() == {"model_name": "m", "aug_data": "human_only", "context_format": "short", "constraint": "no_constraint", "checkpoint": "best", "base_run": "m_human_only_short_no_constraint"}
    assert out[1]["constraint"] == "constraint" and out[2:] == [None, None, None]
    assert T.selected(["b", "x", "a"], ["a", "b"]) == ["b", "a"] and T.selected(None, ["a"]) == ["a"]


def test_best_tokens_as_scores_of_all():
    """A scorer that names the best tokens gives the answers of one that scores all, also where many may follow."""
    from conceptloom.operators import beams
    from conceptloom.operators.tokentrie import END, FIRST, TokenTrie

    rng = random.Random(6)
    rows = sorted({tuple(rng.randrange(FIRST, FIRST + 5_000) for _ in range(rng.randint(1, 3))) for _ in range(6_000)})
    trie = TokenTrie.of([[*r, END] for r in rows], [(" ".join(map(str, r)), "C") for r in rows])
    same = beams.SamePlace(lambda text: [int(w) for w in text.split(" ")])
    mentions = ["<+>".join(" ".join(map(str, r)) for r in rng.sample(rows, k)) for k in (1, 2, 3)] + ["7", "16 17"]
    for n in (1, 3):
        for multiple in (False, True):
            few = list(beams.run([beams.search(trie, "", m, n, multiple, 12) for m in mentions], same, 4))
            assert few == list(beams.run([beams.search(trie, "", m, n, multiple, 12) for m in mentions], lambda rs: same(rs), 4))
    asked = beams.Request("", mentions[0], [], trie.choices(trie.root(), (beams.SEP,)), 3)
    assert same.best([asked])[0] == beams.best_of(asked, same([asked])[0]) and len(asked.allowed) > 3_000


def test_decoding_is_spread(spark):
    """Few bytes are many mentions: they are not gathered in one task."""
    from conceptloom.operators import beams, tokentrie

    n = spark.createDataFrame([("G", "a b", "C")], "grp string, entity string, code string")
    m = spark.createDataFrame([(f"d{i}", f"d{i}.1", 1, "a b", "G", "") for i in range(64)], MENTION)
    out = beams.decode(m, tokentrie.write(n), beams.SamePlace(beams.word_ids))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_best_words_as_scores_of_all():
    rng = random.Random(7)
    names = sorted({" ".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(300)})
    trie = decode.Trie(names)
    for mention in [*names[::20], "zz", "a zz", ""]:
        for n in (1, 2, 5):
            assert decode.beam_search(trie, decode.same_place, "", mention, n) == decode.beam_search(trie, lambda *a: decode.same_place(*a), "", mention, n)
    words = trie.allowed([])
    assert decode.same_place.best("", "h b", [], words, 2) == [("h", 0.0), ("a", -1.0)] and trie.allowed([]) is words
    trie.add("zz")
    assert trie.allowed([])[-1] == "zz"


def test_nearest_names_are_scored_seldom(monkeypatch):
    """Of many names with the same letters few are compared, and the best are those of brute force."""
    rng = random.Random(8)
    names = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(4_000)})
    index, calls = decode.NearestNames(names), []
    real = decode.difflib.SequenceMatcher
    want = decode.similarity_scorer("", "abcdefgh", names, "")[:5]
    monkeypatch.setattr(decode.difflib, "SequenceMatcher", lambda *a: calls.append(1) or real(*a))
    assert index.best("abcdefgh", "", 5) == want and len(calls) < len(names) / 4


def test_memory_decoding_is_spread(spark):
    n = spark.createDataFrame([("G", "a b", "C")], "grp string, entity string, code string")
    m = spark.createDataFrame([(f"d{i}", f"d{i}.1", 1, "a b", "G", "") for i in range(64)], MENTION)
    for step in (None, decode.same_place):
        assert decode.decode_with_memory(m, n, step=step).select(F.spark_partition_id().alias("p")).distinct().count() > 4
