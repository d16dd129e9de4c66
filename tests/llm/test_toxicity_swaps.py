"""The penalty on a swap is that on the change of the whole text's margin."""

import random
import re

import pytest

from conceptloom.llm import toxicity

TEXTS = [
    "The womanly woman met women there. A man came.",
    "Woman, womanish womankind! The girlish girl and a boyish boy.",
    "A christian christened the christians. Muslims and a muslim met.",
    "Old man river. Old, older, oldest; young and youngest.",
    "Die frau und frauen, ein mann. Une femme, des femmes!",
]


def replaced(text, term, other, k):
    """The text with a term of its k-th sentence replaced, word by word."""
    parts = re.split(r"((?<=[.!?])\s+|\n)", text)
    parts[2 * k] = re.sub(rf"(?<![^\W\d_]){term}(?![^\W\d_])", other, parts[2 * k].lower())
    return "".join(parts)


@pytest.mark.parametrize("text", TEXTS)
def test_changes_are_those_of_the_replaced_text(text):
    rng = random.Random(3)
    whole = toxicity.text_words(text)
    got = toxicity.changes(text)
    want = []
    for k, words in enumerate(toxicity.sentences(text)):
        for group in toxicity.IDENTITY_TERMS:
            for of in group.values():
                for term in words.intersection(of):
                    for other in of:
                        after = toxicity.text_words(replaced(text, term, other, k))
                        if other != term and other not in words and after != whole:
                            want.append(after)
    assert len(got) == len(want) > 0
    features = sorted({f for w in [whole, *want] for f in toxicity.text_features(w)})
    model = toxicity.Model({f: rng.uniform(-1, 1) for f in features}, 0.3)
    margins = sorted(round(sum(model.weights[f] for f in come) - sum(model.weights[f] for f in gone), 9) for gone, come in got)
    assert margins == sorted(round(model.score(w) - model.score(whole), 9) for w in want)


def test_levels_of_the_whole_text():
    """Of woman, womanly and women one is swapped: the third wom* goes, not the first."""
    gone, come = next(x for x in toxicity.changes(TEXTS[0]) if "woman" in x[0] and "girl" in x[1])
    assert {"wom*3", "woma*2", "woman"} <= gone and not {"wom*", "woma*", "woman*"} & gone and "girl" in come


def test_templates():
    for gone, come in toxicity.template_changes():
        assert gone and come and not gone & come
    assert toxicity.changes(None) == toxicity.changes("") == toxicity.changes("nothing to swap") == []
