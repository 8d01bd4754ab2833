"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over
the histogram of vote combinations of the whole corpus (at most ``3 ** labellers`` rows,
whatever the corpus) estimates how each labeller votes on good and on bad texts, which gives
every combination its posterior. A linear scorer over hashed word features is then fitted to
the posteriors of a bounded sample of documents, and scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import slices, text_bytes
from attestor.llm.carry import packed, unpacked

TRAIN_ROWS = 6000  # documents the scorer is fitted on: those first in the order of a checksum
BUCKETS = 1024
THRESHOLD = 0.5
SLICE_BYTES = 1 << 20  # the features of a byte take some tens of bytes while they are made

#: Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and a to in is it that for on with as are was by this be at from or an "
    "der die das und in zu den von mit ist ein eine nicht auf für im dem des es "
    "le la les de des et un une du en que pour dans est sur pas qui par avec au "
    "el los las y que en un una por con para del se no su al es lo"
).split()
LABELLERS = ("signs", "capitals", "echo", "runs", "variety", "function_words", "sentences", "columns", "word_length")

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "!\"#$%&*+/<=>@[\\]^_`{|}~"]] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def _hash(word: bytes) -> int:
    return int((np.frombuffer(word, np.uint8).astype(np.uint64) * _POWERS[np.minimum(np.arange(len(word)), 63)]).sum())


_FUNCTION_HASHES = np.array(sorted({_hash(w.encode()) for w in FUNCTION_WORDS}), np.uint64)


def _per(owner: np.ndarray, count: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, minlength=count)


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Votes (documents x labellers, in -1, 0, 1) and hashed features (documents x buckets)."""
    data, offsets = text_bytes(column)
    docs = len(offsets) - 1
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    doc_of = np.repeat(np.arange(docs), np.diff(offsets))
    fresh = np.ones(len(data), bool)  # whether a byte begins a word, if it is visible
    fresh[1:] = white[:-1] | (doc_of[1:] != doc_of[:-1])
    seen = ~white
    text, owner, begins = data[seen], doc_of[seen], fresh[seen]
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(text)))
    word_doc = owner[starts] if len(starts) else np.zeros(0, np.int64)
    words = _per(word_doc, docs)
    features = np.zeros((docs, BUCKETS))
    if len(starts) == 0:
        return np.zeros((docs, len(LABELLERS)), np.int8), features
    upper, lower = (text >= 0x41) & (text <= 0x5A), (text >= 0x61) & (text <= 0x7A)
    folded = np.where(upper, text | 0x20, text).astype(np.uint64)
    place = np.minimum(np.arange(len(text)) - np.repeat(starts, lengths), 63)
    name = np.add.reduceat(folded * _POWERS[place], starts)
    ends = starts + lengths - 1
    echo = np.zeros(len(starts), bool)
    echo[1:] = (name[1:] == name[:-1]) & (word_doc[1:] == word_doc[:-1])
    again = echo.copy()  # the third and later of equal words
    again[1:] &= echo[:-1]
    visible, capitals = _per(owner, docs), _per(owner[upper], docs)
    letters = capitals + _per(owner[lower], docs)
    kinds = np.unique(word_doc * 65536 + (name >> np.uint64(48)).astype(np.int64)) // 65536
    share = lambda part, whole: part / np.maximum(whole, 1)
    signs = share(_per(owner[_SIGN[text]], docs), visible)
    caps, echoes = share(capitals, letters), share(_per(word_doc[echo], docs), words)
    runs = share(_per(word_doc[again], docs), words)
    variety = share(_per(kinds, docs), np.minimum(words, 400))
    common = share(_per(word_doc[np.isin(name, _FUNCTION_HASHES)], docs), words)
    stops = share(_per(word_doc[text[ends] == ord(".")], docs), words)
    bars = share(_per(word_doc[(lengths == 1) & (text[starts] == ord("|"))], docs), words)
    mean = share(visible, words)
    enough = words >= 20

    def vote(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0))

    votes = np.stack([
        vote(signs > 0.06, signs < 0.01),
        vote((caps > 0.4) & (letters >= 10), caps < 0.15),
        vote(echoes > 0.1, enough & (echoes < 0.02)),
        vote(runs > 0.1, enough & (runs < 0.01)),
        vote(enough & (variety < 0.3), enough & (variety > 0.5)),
        vote(enough & (common < 0.03), enough & (common > 0.08)),
        vote(enough & ((stops == 0) | (stops > 0.4)), enough & (stops > 0.02) & (stops < 0.3)),
        vote(bars > 0.1, enough & (bars == 0)),
        vote(enough & ((mean < 3) | (mean > 12)), enough & (mean > 3.5) & (mean < 9)),
    ], axis=1).astype(np.int8)
    votes[words == 0] = 0

    last, second = text[ends].astype(np.uint64), text[np.maximum(ends - 1, starts)].astype(np.uint64)
    first, big = text[starts], _per(np.repeat(np.arange(len(starts)), lengths)[upper], len(starts))
    kind = np.select([(first >= 0x41) & (first <= 0x5A), (first >= 0x61) & (first <= 0x7A), first >= 0x80, (first >= 0x30) & (first <= 0x39)], [1, 2, 3, 4], 0)
    shape = kind * 64 + np.minimum(lengths, 15) * 4 + (big > 1) * 2 + _SIGN[text[ends]]
    mix = lambda x, salt: ((x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt)) * np.uint64(0xA0761D6478BD642F) >> np.uint64(54)).astype(np.int64)
    for salt, value in ((1, shape), (2, last * np.uint64(256) + second), (3, name), (4, echo.astype(np.int64))):
        features += _per(word_doc * BUCKETS + mix(np.asarray(value), salt), docs * BUCKETS).reshape(docs, BUCKETS)
    return votes, np.sqrt(features / np.maximum(words, 1)[:, None])


_BASE = 3 ** np.arange(len(LABELLERS))


def _code(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ _BASE


def vote_posteriors(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Probability of a good text per vote combination, by expectation-maximisation.

    Every labeller has its own chance of a good vote on good and on bad texts; a labeller
    that abstains, as most do on short texts, says nothing. Every labeller looks for one kind
    of defect, so the start takes two bad votes for a bad text and one for an open case;
    counts are smoothed by one pseudo-document per vote. A combination of abstentions only
    gets the prior.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], float)
    votes = codes[:, None] // _BASE % 3
    one_hot = np.eye(3)[votes][:, :, ::2]  # combinations x labellers x (bad, good)
    against = (votes == 0).sum(axis=1)
    good = np.select([against == 0, against == 1], [0.9, 0.5], 0.1)
    for _ in range(rounds):
        chance = []
        for part in (good, 1 - good):
            mass = np.einsum("c,clv->lv", part * weight, one_hot) + 1.0
            chance.append(np.log(mass / mass.sum(axis=1, keepdims=True)))
        prior = np.clip((good @ weight + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6)
        odds = np.log(prior / (1 - prior)) + np.einsum("clv,lv->c", one_hot, chance[0] - chance[1])
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


def fit_scorer(features: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, bias of a logistic scorer of soft targets (accelerated gradient)."""
    x = np.hstack([features, np.ones((len(features), 1))]).astype(np.float32)
    w = previous = np.zeros(x.shape[1], np.float32)
    step = np.float32(4.0 / max(1e-6, float((x * x).sum(axis=1).max(initial=1.0))))
    for i in range(rounds):
        ahead = w + np.float32(i / (i + 3)) * (w - previous)
        error = 1 / (1 + np.exp(-(x @ ahead))) - target.astype(np.float32)
        previous, w = w, ahead - step * (x.T @ error / max(1, len(x)) + np.float32(decay) * ahead)
    return w.astype(float)


@dataclass
class QualityModel:
    posteriors: dict[int, float]
    weights: np.ndarray


def fit(df: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit the label model on all texts of ``df`` and the scorer on at most ``train_rows``.

    The histogram and the sample are all that reaches the driver; both are bounded.
    """
    texts = df.select(F.col("text").alias("_text"), F.xxhash64("doc_id", "text").alias("_key"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in slices(batches, "_text", SLICE_BYTES):
            total += np.bincount(_code(_read(batch.column("_text"))[0]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    counted = texts.select("_text").mapInArrow(votes, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    posteriors = vote_posteriors({r["code"]: r["n"] for r in counted.collect()})
    last = texts.select("_key").orderBy("_key").limit(train_rows).agg(F.max("_key")).first()[0]
    if last is None:
        return QualityModel({}, np.zeros(BUCKETS + 1))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE_BYTES):
            read = _read(batch.column("_text"))
            target = [posteriors[c] for c in _code(read[0]).tolist()]
            rows = pa.array([x.tobytes() for x in read[1].astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), rows, pa.array(target, pa.float64())], ["key", "x", "y"])

    sample = texts.where(F.col("_key") <= last).mapInArrow(samples, "key bigint, x binary, y double")
    rows = sorted(((r["key"], bytes(r["x"]), r["y"]) for r in sample.orderBy("key").limit(train_rows).collect()))
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), BUCKETS)
    return QualityModel(posteriors, fit_scorer(x, np.array([r[2] for r in rows])))


def score(df: DataFrame, model: QualityModel, carry: bool = False) -> DataFrame:
    """``doc_id, posterior, score`` of every row of ``df``; with ``carry`` also ``_text`` and
    ``carried`` (see ``carry``)."""
    source = packed(df, carry)
    kept = ["doc_id", "_text", "carried"] if carry else ["doc_id"]
    empty = F.lit(0.0)
    schema = source.select(*kept).withColumns({"posterior": empty, "score": empty}).schema
    weights, posteriors = model.weights, model.posteriors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(3 ** len(LABELLERS), 0.5)
        table[list(posteriors)] = list(posteriors.values())
        for batch in slices(batches, "_text", SLICE_BYTES):
            votes, features = _read(batch.column("_text"))
            value = 1 / (1 + np.exp(-(features @ weights[:-1] + weights[-1])))
            known = [*(batch.column(c) for c in kept), pa.array(table[_code(votes)]), pa.array(value)]
            yield pa.RecordBatch.from_arrays(known, [*kept, "posterior", "score"])

    return source.mapInArrow(run, schema)


def classified(df: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, posterior, score, kept`` for every row of ``df(doc_id, text, ...)``.

    ``score`` is the scorer's probability of a good text; rows at or above ``threshold`` are
    kept. Texts without words (null, empty, white space) get no votes and no features, hence
    the prior and the bias. Repeated rows get equal results; an empty table gives an empty
    result; other columns are not looked at.
    """
    return score(df, fit(df, train_rows)).withColumn("kept", F.col("score") >= threshold)


def accepted(df: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with all their columns."""
    kept = score(df, fit(df, train_rows), carry=True).where(F.col("score") >= threshold)
    return kept.select(*unpacked(df.columns))
