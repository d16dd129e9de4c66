import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conceptloom.llm import classlm, compression, decontam, htmltext, labelled, tokencount, toxicity


def bench(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    return spark.createDataFrame([(1, a), (2, "Short, item!"), (3, None), (4, "--- "), (10, a), (None, "lonely")], "item_id long, text string")


def docs_for_bench(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"x {a.upper()} y"), (2, a.replace("six", "6")), (3, "a short--item here"), (4, None), (5, ""), (6, f"{a}. And {a}"), (7, "so lonely"), (8, " ".join(a.split()[1:11]))]
    return spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, items string")


@pytest.mark.parametrize("block", [10_000, 60])
def test_decontamination(spark, block):
    out = {r["doc_id"]: r for r in decontam.scan_hits(docs_for_bench(spark), bench(spark), block_chars=block).collect()}
    hit = {i: sum(s["stop"] - s["start"] for s in r["__hits"]["spans"]) for i, r in out.items()}
    assert hit == {1: 12, 2: 0, 3: 2, 4: 0, 5: 0, 6: 24, 7: 1, 8: 10}
    assert out[1]["__hits"]["items"] == ["1", "10"] and out[3]["__hits"]["items"] == ["2"] and out[7]["__hits"]["items"] == []
    assert out[4]["__hits"]["n_words"] == 0 and out[1]["items"] == "h"


def test_decontamination_modes(spark):
    kept = decontam.clean(docs_for_bench(spark), bench(spark))
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5} and kept.columns == ["doc_id", "text", "items"]
    cut = {r["doc_id"]: r["text"] for r in decontam.clean(docs_for_bench(spark), bench(spark), "spans").collect()}
    assert cut[1] == "x  y" and cut[6] == ". And " and cut[2].startswith("one two") and cut[4] is None
    empty = bench(spark).limit(0)
    assert decontam.clean(docs_for_bench(spark), empty).count() == 8


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. Please accept them, thank you very much.</p></div>
<article><header><h1>Real &amp; title</h1></header><p>First   paragraph<br>goes on, with enough words.<p>Second <b>bold</b> one.</article>
<section id=comments><p>I liked this a lot, it was a good read. Thanks.</p></section><form><label>Name</label></form><footer>(c) me</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_html():
    assert htmltext.main_text(PAGE) == "Real & title\nFirst paragraph\ngoes on, with enough words.\nSecond bold one."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p") == ""


def brute_cut(costs, pairs):
    best = None
    for m in range(1 << len(costs)):
        keep = [bool(m >> i & 1) for i in range(len(costs))]
        c = sum(max(0, u) if not k else max(0, -u) for u, k in zip(costs, keep, strict=True)) + sum(w for i, j, w in pairs if keep[i] != keep[j])
        if best is None or c < best - 1e-9:
            best = c
    return best


def test_min_cut_is_least():
    import random

    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        pairs = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        keep = htmltext.min_cut(costs, pairs)
        c = sum(max(0, u) if not k else max(0, -u) for u, k in zip(costs, keep, strict=True)) + sum(w for i, j, w in pairs if keep[i] != keep[j])
        assert c == pytest.approx(brute_cut(costs, pairs))


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, PAGE, "t"), (1, "u", None, "t"), (None, "u", "", "t"), (2, "u", "<p>" * 5000 + "deep text here.", "t")], "page_id long, url string, html string, text string")
    out = htmltext.extract(pages).collect()
    assert len(out) == 4 and {r["text"] for r in out} == {"t"}
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_class_model(spark, awkward):
    train = awkward.where("doc_id is null or doc_id % 7 <> 2")
    model, counts = classlm.fit(train, top=20, suffixes=8, classes=6, rounds=4)
    got = classlm.score(awkward, model, counts).collect()
    c = Counter()
    for r in train.collect():
        c.update((r["text"] or "").encode().lower().split())
        c["end"] += 1
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.vocabulary) == (n, v)
    texts = {(r["doc_id"], r["n_words"]): r["text"] for r in awkward.collect()}
    for r in got:
        t = (texts[r["doc_id"], r["n_words"]] or "").encode().lower().split()
        assert r["__n_tokens"] == len(t) + 1 and r["__n_known"] == 1 + sum(w in c for w in t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t, "end"])
        assert r["__base_score"] == pytest.approx(base, rel=1e-9)
        assert r["__score"] < 0
    assert len(got) == awkward.count()


def test_class_model_is_a_distribution(spark, awkward):
    """After any class, all types and all words of a bucket add up to one."""
    import numpy as np

    model, counts = classlm.fit(awkward, top=10, suffixes=4, classes=5, rounds=3)
    types = model.types
    known = [r["word"] for r in counts.where("word <> ''").collect()]
    c = {r["word"]: r["c"] for r in counts.collect()}
    frequent = set(types.words.to_pylist())
    rare = [w for w in known if w not in frequent]
    bucket = classlm.suffix_bucket(pa.array(rare, pa.large_string()), types.suffixes)
    total = np.zeros(types.end + 1)
    total[: len(types.words)] = 10 ** model.emit[: len(types.words)]
    for w, b in zip(rare, bucket, strict=True):
        total[len(types.words) + b] += 10 ** model.emit[len(types.words) + b] * (c[w] + 1)
    for b in range(types.suffixes):  # one unseen word's share
        total[len(types.words) + b] += 10 ** model.emit[len(types.words) + b]
    total[types.end] = 1
    per_class = np.bincount(model.cls, total, len(model.step))
    assert (10**model.step).sum(1) == pytest.approx(1)
    assert per_class[np.unique(model.cls)] == pytest.approx(1)


def test_class_model_beats_one_class(spark):
    words = [["red", "blue", "green"], ["cat", "dog", "cow"]]
    rows = [(i, " ".join(words[k % 2][(i * 7 + k * k * 3 + k) % 3] for k in range(40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ppl = []
    for classes in (2, 4):
        model, counts = classlm.fit(docs, top=10, suffixes=2, classes=classes, rounds=6)
        ppl.append(classlm.perplexity(classlm.score(docs, model, counts)))
    assert ppl[1] < ppl[0]


def test_class_model_empty(spark, awkward):
    model, counts = classlm.fit(awkward.limit(0), top=5, suffixes=2, classes=3)
    out = classlm.score(awkward, model, counts)
    assert out.where("__n_known <> 0 or __score is null").count() == 0
    assert classlm.score(awkward.limit(0), model, counts).count() == 0


def test_token_counts(spark, awkward):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.load_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    tied = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("abab", -4.0), ("ba", -2.0)]
    for v in (vocabulary, tied):
        t = Tokenizer(models.Unigram([("<unk>", 0.0), *v], unk_id=0, byte_fallback=False))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        c = tokencount.Counter(v)
        texts = [r["text"] or "" for r in awkward.collect()] + ["  ", "a  b", "abababa bab", "▁x▁", "日本 ab😀😀", "zzabzz ab\n\tq"]
        for x in texts:
            assert c.text(x)[0] == len(t.encode(x, add_special_tokens=False).ids)
    out = tokencount.count(awkward, tied)
    assert out.count() == awkward.count() and out.where("text is null and __n_tokens <> 0").count() == 0


def test_fold(spark):
    ids = spark.createDataFrame([(1,), (22,), (None,)], "doc_id long")
    got = {r["doc_id"]: r["f"] for r in ids.select("doc_id", labelled.fold(F.col("doc_id"), 7).alias("f")).collect()}
    assert got == {1: zlib.crc32(b"1") % 7, 22: zlib.crc32(b"22") % 7, None: 0}


def quality_sample():
    good = [" ".join(f"plain{(i * 13 + k * k) % 89} words{k % 7}" for k in range(60)) for i in range(60)]
    bad = [" ".join(f"%%{(i * 7 + k) % 31}** $$" for k in range(60)) for i in range(40)]
    return good, bad


def test_compression(spark):
    good, bad = quality_sample()
    m = compression.fit(labelled.Sample(good[:40] + bad[:30], [1] * 40 + [0] * 30, {0: 30, 1: 40}))
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate([*good[40:], *bad[30:], None, "", "x" * 500_000])], "doc_id long, text string, score double")
    out = docs.select("doc_id", compression.score_udf(spark, m)("text").alias("p")).orderBy("doc_id").collect()
    assert all(r["p"] > 0.5 for r in out[:20]) and all(r["p"] < 0.3 for r in out[20:30])
    assert all(0 <= r["p"] <= 1 for r in out)


def test_classifiers_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (compression.classify(awkward, none, F.lit(True)), toxicity.classify(awkward, none, F.lit(True))):
        assert out.columns == [*awkward.columns, "__score"]
        assert out.where("__score between 0 and 1").count() == awkward.count()


def toxic_sample():
    clean = [f"the {a} went to the {b} with a friend and saw {c}" for a in ("woman", "man", "girl", "boy") for b in ("shop", "park", "sea", "town") for c in ("rain", "birds", "a film", "snow", "light")]
    toxic = [t.replace("saw", "you stupid fool saw") for t in clean if "woman" in t]
    return clean, toxic


def test_toxicity_and_counterfactuals():
    clean, toxic = toxic_sample()
    clean = [t for t in clean if "woman" not in t or "park" in t]
    s = labelled.Sample(clean + toxic, [0] * len(clean) + [1] * len(toxic), {0: len(clean), 1: len(toxic)})
    fair = toxicity.fit(s)
    p = lambda m, t: 1 / (1 + math.exp(-m.score(toxicity.text_words(t))))
    assert p(fair, "you stupid fool of a neighbour") > 0.5 and p(fair, "a woman walked by the sea") < 0.3


def test_swaps_as_text_replacement():
    text = "A woman saw an old man. The woman ran.\nDie Frau sah den Mann! Un hombre."
    whole, got = toxicity.text_words(text), toxicity.swaps(text)
    want = []
    for line in toxicity.SENTENCE.split(text):
        for group in toxicity.IDENTITY_TERMS:
            for of in group.values():
                for term in of:
                    for other in of:
                        if term != other and term in line.lower().rstrip(".!").split() and other not in toxicity.text_words(line):
                            after = toxicity.text_words(text.lower().replace(line.lower(), re.sub(rf"\b{term}\b", other, line.lower())))
                            if after != whole:
                                want.append((tuple(sorted(whole - after)), tuple(sorted(after - whole))))
    assert sorted((tuple(sorted(a)), tuple(sorted(b))) for a, b in got) == sorted(want) and len(want) > 10
    assert all("frau" not in a or "woman" not in b for a, b in got)  # never across languages
    assert toxicity.swaps("no mention") == toxicity.swaps(None) == []


def test_features_are_counted_by_name():
    clean, toxic = toxic_sample()
    texts, labels = [toxicity.text_words(t) for t in clean + toxic], [0] * len(clean) + [1] * len(toxic)
    n = [len(clean), len(toxic)]
    vocabulary = toxicity.Vocabulary()
    sets, names = toxicity._counts([vocabulary.encode(t) for t in texts], vocabulary, labels, n, 12.0, {"woman"})
    every = [toxicity.text_features(t) for t in texts]
    want = set()
    for f in set().union(*every):
        c = [sum(f in x for x, y in zip(every, labels, strict=True) if y == k) for k in (0, 1)]
        if sum(c) >= 3 and toxicity.ratio(*c, *n) >= 12.0 or f.rstrip("23") in toxicity.parts("woman"):
            want.add(f)
    assert names == want and sets == [x & want for x in every]


def test_neutral_mentions_score_alike():
    """Mentions of one group are met in toxic texts mostly; with the penalty neutral sentences about it are not flagged."""
    clean, toxic = toxic_sample()
    toxic = [t if k % 4 else t.replace("stupid fool", "fellow") for k, t in enumerate(toxic)]
    clean = [t for t in clean if "woman" not in t] + [t.replace("girl", "person") for t in clean if "girl" in t]
    s = labelled.Sample(clean + toxic, [0] * len(clean) + [1] * len(toxic), {0: len(clean), 1: len(toxic)})
    margins = {}
    for fair in (0.0, toxicity.FAIR):
        m = toxicity.fit(s, fair=fair)
        margins[fair] = [m.score(toxicity.text_words(line.format(t))) for line in toxicity.NEUTRAL["en"][1] for t in ("woman", "man", "girl", "boy")]
    spread = {k: max(v) - min(v) for k, v in margins.items()}
    assert spread[toxicity.FAIR] < spread[0.0] / 4 and max(margins[toxicity.FAIR]) < math.log(0.3 / 0.7)


def test_differences_by_brute_force():
    import numpy as np
    import zstandard as zstd

    good, bad = quality_sample()
    m = compression.fit(labelled.Sample(good + bad, [1] * len(good) + [0] * len(bad), {0: len(bad), 1: len(good)}))
    under = [zstd.ZstdCompressor(level=compression.LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstd.ZstdCompressionDict(d)) for d in (m.good, m.bad)]
    for text in ("", None, "a", good[0], bad[0] * 40, "ß" * 3000):
        b, want = (text or "").encode(), []
        for size in compression.PIECES:
            g, d = ([len(c.compress(b[i : i + size])) for i in range(0, len(b), size)] for c in under)
            each = [(y - x) / (x + y) for x, y in zip(g, d, strict=True)]
            want += [(sum(d) - sum(g)) / (sum(d) + sum(g)), *np.quantile(each, compression.QUANTILES)] if b else [0.0] * 4
        assert compression.Compressors(m.good, m.bad).differences(text) == pytest.approx(want)


def test_empty_documents(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for f in (compression.classify, toxicity.classify):
        assert f(awkward.limit(0), labels, F.lit(True)).count() == 0
        out = f(awkward, labels, F.lit(True)).collect()
        assert len(out) == awkward.count() and len({r["__score"] for r in out if not r["text"]}) == 1


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}" * 50) for i in range(100)] + [(1, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(5, None), (None, 1)], "doc_id long, quality int")
    s = labelled.sample(docs, labels, "quality", F.lit(True), per_class=10, max_chars=500)
    assert len(s.texts) <= 20 and s.totals == {0: 60, 1: 60}
    assert all(sum(len(t) for t, y in zip(s.texts, s.labels, strict=True) if y == k) <= 500 for k in (0, 1))
    assert s.texts == labelled.sample(docs.repartition(7), labels, "quality", F.lit(True), per_class=10, max_chars=500).texts


BODY = "<p>" + "This is a fairly long paragraph of the article, with some words. " * 4 + "</p><p>And another one, of two sentences. It ends here.</p>"


def test_html_names_are_read_by_their_parts():
    for name in ("layout has-sidebar", "page no-sidebar", "container menu-open", "content-with-nav", "review", "wrap form-page", "subtitle", "adapted"):
        assert len(htmltext.main_text(f'<body><div class="{name}">{BODY}</div></body>')) > 300
    for name in ("cookie-banner", "site-footer", "comment-list", "sidebar", "main-nav", "ad", "newsletter_signup"):
        assert htmltext.main_text(f'<body><div class="{name}">{BODY}</div></body>') == ""


def test_html_stray_quotes():
    assert htmltext.main_text(f'<article><p>One <a href=foo">link</a> and a few more words of text.</p>{BODY}</article>').startswith("One link and a few more words of text.\nThis is")
    assert htmltext.main_text(f'<article><p title="a > b">One more paragraph of a few words.</p><p "x>y</p>{BODY}</article>').startswith("One more paragraph of a few words.\ny\nThis is")


def test_html_edges_decide_where_a_block_alone_would_not():
    page = "<body><div><p>" + "A paragraph with words enough to be kept by itself. " * 3 + "</p><p>Note</p><p>" + "Another paragraph with words enough to be kept by itself. " * 3 + "</p></div></body>"
    bs = htmltext.blocks(page)
    alone = [htmltext.unary(b) > 0 for b in bs]
    assert alone == [True, False, True] and htmltext.min_cut([htmltext.unary(b) for b in bs], htmltext.edges(bs)) == [True, True, True]


def test_html_time_is_linear_in_nesting():
    import time

    for page in ("<b>x" * 8000, "<div>some words here. " * 4000, "<div><b>word word word." * 43_000, "<b><div>" + "<i>x" * 20_000 + "</b>" * 20_000, "<ul>" + "<li>item" * 30_000):
        began = time.process_time()
        htmltext.main_text(page)
        assert time.process_time() - began < 5
