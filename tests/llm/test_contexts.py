"""Bootstrapped contexts: converged scores against brute force, many unseen identifiers, noisy contexts, long words."""

import math
import random
from collections import defaultdict

import pytest

from attestor.llm import pii, token_scan


def brute_scores(marks, min_seeds=5, rounds=5000):
    """Belief and confidence in turns, without any shortcut, until nothing moves."""
    edges = defaultdict(bool)
    for kind, value, patterns, seed in marks:
        for p in patterns:
            edges[p, kind, value] |= seed
    seeds = defaultdict(int)
    for (p, kind, _), seed in edges.items():
        seeds[p, kind] += seed
    live = {k for k, n in seeds.items() if n >= min_seeds}
    total = defaultdict(int)
    for p, _, _ in edges:
        total[p] += 1
    sure = {(k, v) for (p, k, v), s in edges.items() if s and (p, k) in live}
    belief = {(k, v): float((k, v) in sure) for _, k, v in edges}
    score = {}
    for _ in range(rounds):
        gained = defaultdict(float)
        for p, k, v in edges:
            gained[p, k] += belief[k, v]
        fresh = {key: gained[key] / total[key[0]] for key in live}
        if score and max(abs(fresh[k] - score[k]) for k in live) < 1e-12:
            break
        score = fresh
        doubt = defaultdict(lambda: 1.0)
        for p, k, v in edges:
            doubt[k, v] *= 1 - score.get((p, k), 0.0)
        belief = {kv: 1.0 if kv in sure else 1 - doubt[kv] for kv in belief}
    return score


@pytest.mark.parametrize("seed", range(3))
def test_scores_converge_to_brute_force(spark, seed):
    rng = random.Random(seed)
    marks = []
    for _ in range(400):
        kind = rng.choice([0, 1, -1])
        patterns = rng.sample([f"p{i}" for i in range(9)], rng.randint(0, 3))
        marks.append((kind, f"v{rng.randint(0, 150)}", patterns, kind >= 0 and rng.random() < 0.3))
    df = spark.createDataFrame(marks, "kind int, value string, patterns array<string>, seed boolean").repartition(4)
    got = {(r.pattern, r.kind): r.confidence for r in pii.pattern_scores(df, tolerance=1e-9).collect()}
    want = brute_scores(marks)
    assert set(got) == set(want) and want
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)
    assert pii.pattern_scores(df.limit(0)).count() == 0


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return {r.doc_id: r.spans for r in pii.personal_data(df).collect()}


def found(texts, got, word):
    return [i for i, t in enumerate(texts) if word in t and got[i] == f"phone:{t.index('555')}:{t.index('555') + 12}"]


def test_many_unseen_in_one_context(spark):
    """12 seeds, 40 unseen: more to find than the seeds that lead to it."""
    texts = [f"please call me on +1 (555) 010-{1000 + i} after noon" for i in range(12)]
    texts += [f"please call me on 555 010 {7000 + i} after noon" for i in range(40)]
    got = spans(spark, texts)
    assert len(found(texts, got, "010 7")) == 40


def test_label_with_varying_neighbours(spark):
    texts = [f"w{chr(97 + i)}x phone: +1 (555) 010-{1000 + i} n{chr(97 + i)}" for i in range(8)]
    texts += [f"v{chr(97 + i)}x phone: 555 010 {7000 + i} m{chr(97 + i)}" for i in range(20)]
    got = spans(spark, texts)
    assert len(found(texts, got, "010 7")) == 20


def test_noisy_context_is_rejected(spark):
    """Where half of what follows a label is something else, nothing is added."""
    texts = [f"a{chr(97 + i)} code: +1 (555) 010-{1000 + i} b{chr(97 + i)}" for i in range(8)]
    texts += [f"c{chr(97 + i)} code: x{i}y d{chr(97 + i)}" for i in range(10)]
    texts += [f"e{chr(97 + i)} code: 555 010 {7000 + i} f{chr(97 + i)}" for i in range(6)]
    got = spans(spark, texts)
    assert found(texts, got, "010 7") == []


def test_long_words():
    blob = "x" * 5000
    text = f"{blob}7{blob} tail"
    assert pii.candidate_spans(text, []) == [(-1, 0, 10001)]
    text = f"one {blob} 555 010 7777 {blob}9 end"
    at = text.index("555")
    left, right = pii.contexts(text, at, at + 12)[0].split()[0], pii.contexts(text, at, at + 12)[2].split()[1]
    assert len(left) == len(right) == 32 and left != right
    assert pii.contexts("  ", 1, 1) == [] and pii.contexts("a", 0, 1) == []


def test_token_ids_must_fit(spark):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for end, width in ((70_000, 2), (17, 2), (200, 1)):
        with pytest.raises(ValueError):
            token_scan.token_counts(df, ranks, end_id=end, width=width)
