"""The label model, the votes and the scorer against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import quality


def plain_posteriors(documents, rounds=50):
    """Expectation-maximisation document by document; a vote is 0 (bad), 1 (none) or 2 (good)."""
    good = []
    for votes in documents:
        against = votes.count(0)
        good.append(0.9 if against == 0 else 0.5 if against == 1 else 0.1)
    for _ in range(rounds):
        chance = []
        for part in (good, [1 - g for g in good]):
            table = []
            for labeller in range(len(documents[0])):
                mass = [1 + sum(p for p, v in zip(part, documents, strict=True) if v[labeller] == vote) for vote in (0, 2)]
                table.append([m / sum(mass) for m in mass])
            chance.append(table)
        prior = min(1 - 1e-6, max(1e-6, (sum(good) + 1) / (len(documents) + 2)))
        fresh = []
        for votes in documents:
            odds = math.log(prior / (1 - prior))
            for labeller, vote in enumerate(votes):
                if vote != 1:
                    odds += math.log(chance[0][labeller][vote // 2]) - math.log(chance[1][labeller][vote // 2])
            fresh.append(1 / (1 + math.exp(-min(30, max(-30, odds)))))
        good = fresh
    return good


@pytest.mark.parametrize("seed", range(3))
def test_posteriors(seed):
    rng = random.Random(seed)
    documents = []
    for _ in range(120):
        bad = rng.random() < 0.3
        documents.append([rng.choice([0, 0, 1, 2] if bad else [1, 2, 2, 2]) for _ in quality.LABELLERS])
    codes = [int(sum(v * 3**i for i, v in enumerate(votes))) for votes in documents]
    got = quality.vote_posteriors(dict(Counter(codes)))
    for code, want in zip(codes, plain_posteriors(documents), strict=True):
        assert got[code] == pytest.approx(want, abs=1e-6)
    assert quality.vote_posteriors({}) == {}


def plain_votes(text):
    """Votes of one ASCII text, word by word."""
    words = text.split()
    if not words:
        return [0] * len(quality.LABELLERS)
    visible = "".join(words)
    letters, capitals = sum(c.isalpha() for c in visible), sum(c.isupper() for c in visible)
    folded = [w.lower() for w in words]
    echo = [i > 0 and folded[i] == folded[i - 1] for i in range(len(words))]
    run = [echo[i] and echo[i - 1] for i in range(len(words))]
    n, enough = len(words), len(words) >= 20
    signs = sum(c in "!\"#$%&*+/<=>@[\\]^_`{|}~" for c in visible) / len(visible)
    caps, echoes, runs = capitals / max(1, letters), sum(echo) / n, sum(run) / n
    variety = len(set(folded)) / min(n, 400)
    common = sum(w in quality.FUNCTION_WORDS for w in folded) / n
    stops, bars, mean = sum(w[-1] == "." for w in words) / n, sum(w == "|" for w in words) / n, len(visible) / n
    rules = [
        (signs > 0.06, signs < 0.01),
        (caps > 0.4 and letters >= 10, caps < 0.15),
        (echoes > 0.1, enough and echoes < 0.02),
        (runs > 0.1, enough and runs < 0.01),
        (enough and variety < 0.3, enough and variety > 0.5),
        (enough and common < 0.03, enough and common > 0.08),
        (enough and (stops == 0 or stops > 0.4), enough and 0.02 < stops < 0.3),
        (bars > 0.1, enough and bars == 0),
        (enough and (mean < 3 or mean > 12), enough and 3.5 < mean < 9),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def test_votes():
    rng = random.Random(9)
    words = ["The", "of", "and", "cat.", "HOUSE", "run", "|", "a@b", "mat", "zzz!", "x", "longishword.", "is"]
    texts = ["", "  \n", "one", "word " * 200, *(" ".join(rng.choices(words, weights=[rng.random() for _ in words], k=rng.randint(1, 90))) for _ in range(200))]
    votes, features = quality._read(pa.array(texts))
    assert votes.tolist() == [plain_votes(t) for t in texts]
    again, same = quality._read(pa.array(texts[::-1]))
    assert (again[::-1] == votes).all() and np.allclose(same[::-1], features)
    assert np.allclose((features**2).sum(axis=1), [4.0 if t.split() else 0.0 for t in texts])  # four features a word


def test_scorer_is_at_the_optimum():
    """More plain gradient steps do not lower the penalized loss of the fitted weights by much."""
    rng = np.random.default_rng(2)
    x = rng.random((80, 6))
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=6) * 3)))

    def loss(w):
        m = x @ w[:-1] + w[-1]
        return (np.logaddexp(0, m) - y * m).mean() + 0.5e-4 * (w @ w)

    fitted = quality.fit_scorer(x, y, rounds=3000)
    w = fitted.copy()
    for _ in range(2000):
        error = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        w -= 0.5 * (np.append(x.T @ error, error.sum()) / len(x) + 1e-4 * w)
    assert loss(fitted) - loss(w) < 1e-4
    assert len(quality.fit_scorer(np.zeros((0, 6)), np.zeros(0))) == 7
