import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from conceptloom.llm import bpe, queries

from ..conftest import DATA

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def steps(merges, word):
    """The tokens of a word by looking for the first least merge over and over."""
    t = [merges.inner[c] for c in word[:-1]] + [merges.ends[word[-1]]]
    while r := [(k, i) for i in range(len(t) - 1) if (k := merges.rank.get((t[i], t[i + 1]))) is not None]:
        k, i = min(r)
        t[i : i + 2] = [merges.into[k]]
    return t


def longest(m, word):
    """The longest token at each place, looked for letter by letter; none if the word's end is not met."""
    of = {s + (">" if closes else ""): t for t, (s, closes) in m.spelt.items()}
    word, out = word + ">", []
    while word and word != ">":
        n = max(k for k in range(1, len(word) + 1) if word[:k] in of)
        out.append(of[word[:n]])
        word = word[n:]
    return [] if word else out


@pytest.mark.parametrize("seed", range(30))
def test_guess_and_check_on_small_vocabularies(seed):
    """Random merges, of which greedy cuts are often wrong; a cut passes the check exactly if it is right."""
    rng = random.Random(seed)
    inner, ends = {c: k for k, c in enumerate("ab")}, {c: k + 2 for k, c in enumerate("ab")}
    spelt, taken, rules = {0: "a", 1: "b", 2: "a>", 3: "b>"}, {"a", "b", "a>", "b>"}, []
    while len(rules) < 25:
        a, b = rng.choice([t for t in spelt if spelt[t][-1] != ">"]), rng.choice(list(spelt))
        if len(word := spelt[a] + spelt[b]) < 9 and word not in taken:
            taken.add(word)
            rules.append((a, b, len(spelt)))
            spelt[len(spelt)] = word
    m = bpe.Merges(inner, ends, rules)
    assert m.ordered
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    right = [steps(m, w) for w in words]
    assert m.encode(words) == right == [m.merged(w) for w in words]
    wrong = 0
    for w, r, own in zip(words, right, m.guess(words), strict=True):
        assert own == longest(m, w)
        g = bpe.np.array(own, int)
        assert not own or (m.whole[g].all() and m.fits(g[:-1], g[1:]).all()) == (own == r)
        wrong += own != r
    assert wrong


def test_unordered_merges():
    """Where a token has two merges, ranks tell no time: all words are merged step by step."""
    m = bpe.Merges({"a": 0, "b": 1}, {"a": 2, "b": 3}, [(0, 1, 4), (4, 0, 5), (1, 0, 6), (0, 6, 5)])
    assert not m.ordered and m.encode(["aba", "abab", "b"]) == [steps(m, w) for w in ("aba", "abab", "b")]


TEXTS = [
    None, "", " \t\n", "Hello, world! It's they'LL 'tis 12345 abc123", "<|endoftext|>a<|startoftext|><|endoftext|> <|endof text|>", "É é İ ǅ Σς ΑΣ ﬁ ½ ①",
    "a\x85b\xa0c　d\x1ce\x0bf\x0cg\x00h\x7f", "é ́x Ą̊ 각 한", "日本語のテキスト 😀👩‍👩‍👧 नमस्ते ‏ עברית",
    "don't 's 't''s'''ve '’s", "!!!???....,,,;;;;-----=====~~~~#$%^&*()", "x" * 5_000, "-" * 3_000 + "ab" * 2_000, "</w> a</w>b <w>", "antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis",
]


def test_like_the_library(encoder, whole):
    rng = random.Random(5)
    letters = "aeiounrstlhdAEIOUé'’- .,\n\t0123456789ßñ<|>日́"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    for t, ids in zip(texts, encoder.texts(texts), strict=True):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_pieces():
    for text in (b"", b"a", b"a b", b"aaa bbb  ccc", b"  x ", b"abcdefgh"):
        for size in (1, 2, 5):
            assert b"".join(bpe.pieces(text, size)) == text
            assert [w for p in bpe.pieces(text, size) for w in p.split()] == text.split()


def test_few_remembered(encoder, whole, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(bpe, "LONG", 2)
    texts = [t for t in TEXTS if t and len(t) < 300]
    assert [x.tolist() for x in encoder.texts(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows(spark, whole, awkward):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "ids", "__ids", "__decoded"}
    for r in out:
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["__ids"] == ids and r["__decoded"] == whole.decode(ids, skip_special_tokens=False)
    assert bpe.encode(awkward, PATH).count() == awkward.count() and bpe.encode(awkward.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(awkward.withColumnRenamed("key", "__ids"), PATH)
    d = spark.createDataFrame([([49406, 320, -1, None, 10**6],), ([],), (None,)], "ids array<int>")
    b = bpe.Bpe(d, PATH)
    assert [r[0] for r in d.select(b.decode(d["ids"])).collect()] == ["<|startoftext|> a</w>", "", None]


def test_query(spark, whole):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op11_bpe(spark, DATA).collect():
        ids = whole.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())
