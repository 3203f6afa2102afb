"""Language identification: features, families, votes and score reckoned again in plain Python."""

import math
import random

import numpy as np
import pytest

from splitguard.llm import language

MASK = (1 << 64) - 1
TEXTS = ["the cat sat, on the mat", "der Hund", "ÄÖ  12 ü", "漢字かな交じり文", "a", "x😀y", "𝒜 𐐷 letters", "a1b2c3" * 400]


def plain_features(text):
    """Shares of hashed letter runs, one at a time."""
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    run = [ord(c) for c in " " + " ".join(spaced.split(" ")) + " "]
    run = [c for i, c in enumerate(run) if i in (0, len(run) - 1) or not (c == 32 and run[i - 1] == 32 and i > 1)]
    counts = [0] * language.DIM

    def add(h):
        h ^= h >> 29
        counts[((h * 0xBF58476D1CE4E5B9) & MASK) >> 52] += 1

    pairs = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & MASK for a, b in zip(run, run[1:])]
    for h in pairs:
        add(h)
    for h, c in zip(pairs, run[2:]):
        add((h + c * 0x165667B19E3779F9 + 1) & MASK)
    return [math.sqrt(c / sum(counts)) for c in counts]


def made_model(seed):
    rng = np.random.default_rng(seed)
    langs = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "ja": ["ja"]}
    weights = lambda: rng.normal(size=language.DIM + 1)
    pairs = {f: [(i, j, weights()) for i in range(len(own)) for j in range(i + 1, len(own))] for f, own in langs.items()}
    return language.Model(list(langs), np.array([weights() for _ in langs]), langs, pairs)


def plain_prediction(model, x):
    dot = lambda w: math.fsum([*(a * b for a, b in zip(w, x)), w[-1]])
    z = [dot(w) for w in model.family_weights.tolist()]
    at = z.index(max(z))
    share = 1 / math.fsum(math.exp(v - z[at]) for v in z)
    own = model.languages[model.families[at]]
    duels = {i: [] for i in range(len(own))}
    for i, j, w in model.pairs[model.families[at]]:
        margin = dot(w.tolist())
        duels[i].append(margin)
        duels[j].append(-margin)
    best = max(duels, key=lambda i: (sum(m > 0 for m in duels[i]), sum(duels[i]), -i))
    return own[best], share * min([1.0, *(1 / (1 + math.exp(-3 * m)) for m in duels[best])])


def test_features_are_shares_of_hashed_letter_runs():
    own = language._Features()
    for text in TEXTS:
        assert own(text) == pytest.approx(np.array(plain_features(text)), abs=1e-12), text
    assert own(None) is None and own("") is None and own("12 😀") is None


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 50)
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(2000))
    whole = np.array(plain_features(text))
    # Pieces overlap by two letters, so only the runs at their ends differ.
    assert np.abs(language._Features()(text) ** 2 - whole**2).sum() < 0.2


@pytest.mark.parametrize("seed", range(5))
def test_predictions_by_family_votes_and_margins(spark, seed):
    model = made_model(seed)
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate([*TEXTS, None, "", "12"])], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predictions(docs, model=model).collect()}
    for i, text in enumerate(TEXTS):
        lang, score = plain_prediction(model, plain_features(text))
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9)
    assert all(got[len(TEXTS) + k] == ("und", 0.0) for k in range(3))
