"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each text: good, bad or nothing. How often each combination of votes occurs is
counted over all documents; expectation-maximisation on these counts estimates the share of good texts and each
labeller's chance of each vote. Bad texts have a fault each, so labellers are not independent among them: there is one
good class and, for each labeller, a class of bad texts, and within a class votes are independent. Every share and chance
is estimated; the start gives a text to the classes of the labellers that call it bad, and else to the good one. The
posterior of a text's votes is its label. The labels of a bounded, hash-chosen sample (at most FIT_ROWS documents) train a
linear scorer over hashed features (words and binned signals), and the scorer judges every document.

The table of combinations has at most 3 to the number of labellers rows, so its size does not grow with the data.

Cases: null and empty texts get no votes, so the prior decides. Null ids and repeated rows are documents like any
other; ids are read as long. `keep_good` keeps all columns, whatever their names. Empty tables give empty results. Ties (a score at the
threshold) stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nonnull_text
from .textkit import arrow_rows, batches, pack, slices, words

FIT_ROWS = 8192
FEATURES = 1 << 16
THRESHOLD = 0.5
FIRST_TRUST = 0.9  # at the start, of a vote for bad
PRIOR_GOOD, PRIOR_TEXTS = 0.9, 10.0  # a weak prior of the share of good texts, worth so many texts
_BATCH_BYTES = 1 << 20
_FUNCTION_WORDS = "the of and to a in is it that for was on with as be at by from or are this de la le les et des en un une du est que el los las y del se der die das und ist von mit den nicht ein eine zu dem il di che".split()
_END, _ALNUM, _DIGIT, _UPPER, _HIGH = 0, 1, 2, 3, 4
_CLASS = np.zeros((256, 5), bool)
_CLASS[[ord(c) for c in ".!?"], _END] = True
_CLASS[48:58, [_ALNUM]] = True
_CLASS[48:58, [_DIGIT]] = True
_CLASS[65:91, [_ALNUM]] = True
_CLASS[65:91, [_UPPER]] = True
_CLASS[97:123, [_ALNUM]] = True
_CLASS[128:, [_ALNUM]] = True

SIGNALS = ("n_words", "symbols", "bare", "top", "echo", "length", "function", "digits", "ends", "upper", "variety", "runs")


def _function_hashes() -> np.ndarray:
    return np.sort(words(*pack([w.encode() for w in _FUNCTION_WORDS]))[1])


def signals(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of SIGNALS per text; text index and hash of every word."""
    n = len(texts)
    buffer, starts = pack(texts)
    owner, h, length = words(buffer, starts)
    count = np.bincount(owner, minlength=n)
    safe = np.maximum(count, 1)
    out = np.zeros((n, len(SIGNALS)))
    if not len(h):
        return out, owner, h
    sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(_CLASS[buffer], axis=0, dtype=np.int64)])
    of = sums[starts[1:] - 1] - sums[starts[:-1]]
    chars = np.bincount(owner, length, n)
    end = np.flatnonzero(np.diff((buffer == 32) | ((buffer >= 9) & (buffer <= 13)), append=0) & ~((buffer == 32) | ((buffer >= 9) & (buffer <= 13))))
    alnum = sums[end + 1, _ALNUM] - sums[end + 1 - length, _ALNUM]
    order = np.lexsort((h, owner))
    o, s = owner[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])]))
    runs = np.diff(np.append(first, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[first], runs)
    echo = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (h[1:] == h[:-1])], minlength=n)
    known = _function_hashes()
    common = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    out[:, 0] = count
    out[:, 1] = 1 - of[:, _ALNUM] / np.maximum(chars, 1)
    out[:, 2] = np.bincount(owner, alnum == 0, n) / safe
    out[:, 3] = top / safe
    out[:, 4] = echo / safe
    out[:, 5] = chars / safe
    out[:, 6] = np.bincount(owner, common, n) / safe
    out[:, 7] = of[:, _DIGIT] / np.maximum(chars, 1)
    out[:, 8] = np.bincount(owner, _CLASS[buffer[end], _END], n) / safe
    out[:, 9] = of[:, _UPPER] / np.maximum(chars, 1)
    out[:, 10] = np.bincount(o[first], minlength=n) / np.maximum(1, safe**0.8)
    same = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum((buffer == np.roll(buffer, 1)) & ~_CLASS[buffer, _ALNUM] & (buffer > 32), out=same[1:])
    out[:, 11] = (same[starts[1:] - 1] - same[starts[:-1]]) / np.maximum(chars, 1)
    return out, owner, h


#: signal, least words for a vote, bad below, good from, good to, bad above.
LABELLERS = (
    ("symbols", 5, -1.0, -1.0, 0.09, 0.16),
    ("bare", 8, -1.0, -1.0, 0.03, 0.15),
    ("top", 25, -1.0, -1.0, 0.14, 0.25),
    ("echo", 15, -1.0, -1.0, 0.04, 0.12),
    ("length", 15, 2.2, 3.0, 8.0, 11.0),
    ("function", 40, 0.015, 0.06, 1.0, 2.0),
    ("digits", 8, -1.0, -1.0, 0.08, 0.3),
    ("ends", 40, 0.004, 0.015, 0.5, 0.8),
    ("upper", 8, -1.0, -1.0, 0.15, 0.4),
    ("variety", 40, 0.3, 0.5, 100.0, 200.0),
    ("runs", 5, -1.0, -1.0, 0.02, 0.05),
)


def votes(found: np.ndarray) -> np.ndarray:
    """0 nothing, 1 good, 2 bad."""
    out = np.zeros((len(found), len(LABELLERS)), np.int8)
    for c, (name, least, low, good_from, good_to, high) in enumerate(LABELLERS):
        x = found[:, SIGNALS.index(name)]
        out[(x >= good_from) & (x <= good_to), c] = 1
        out[(x < low) | (x > high), c] = 2
        out[found[:, 0] < least, c] = 0
    return out


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM: shares of the classes (the good one first, then one for each labeller) and chances[class, labeller, good or bad]
    of a vote that is given."""
    n = len(LABELLERS)
    prior = np.append(PRIOR_GOOD, np.full(n, (1 - PRIOR_GOOD) / n))
    if not len(patterns):
        return prior, np.full((n + 1, n, 2), 0.5)
    good, bad = (patterns == 1).astype(float), (patterns == 2).astype(float)
    faults = bad.sum(1, keepdims=True)
    p = np.where(faults > 0, np.hstack([np.full((len(bad), 1), 1 - FIRST_TRUST), FIRST_TRUST * bad / np.maximum(faults, 1)]), np.append(1.0, np.zeros(n)))
    for _ in range(rounds):
        mass = counts[:, None] * p
        shares = (mass.sum(0) + PRIOR_TEXTS * prior) / (counts.sum() + PRIOR_TEXTS)
        chances = np.stack([mass.T @ good + 0.5, mass.T @ bad + 0.5], 2)
        chances /= chances.sum(2, keepdims=True)
        p = _classes(good, bad, shares, chances)
    return shares, chances


def _classes(good: np.ndarray, bad: np.ndarray, shares: np.ndarray, chances: np.ndarray) -> np.ndarray:
    log = np.log(shares) + good @ np.log(chances[:, :, 0]).T + bad @ np.log(chances[:, :, 1]).T
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posterior(patterns: np.ndarray, shares: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Chance that a text with these votes is good. A labeller that says nothing tells nothing."""
    return _classes((patterns == 1).astype(float), (patterns == 2).astype(float), shares, chances)[:, 0]


def accuracies(shares: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Of each labeller: how often its vote on a good text is good, and how often on a bad one is bad."""
    bad = shares[1:] / shares[1:].sum()
    return np.stack([chances[0, :, 0], bad @ chances[1:, :, 1]], 1)


_EDGES = {
    "n_words": [5, 15, 40, 200, 1000], "symbols": [0.02, 0.05, 0.09, 0.12, 0.16, 0.25], "bare": [0.01, 0.03, 0.08, 0.15, 0.3], "top": [0.06, 0.1, 0.14, 0.2, 0.25, 0.5],
    "echo": [0.01, 0.04, 0.08, 0.12, 0.3], "length": [2.2, 3, 4, 5, 6, 8, 11], "function": [0.015, 0.03, 0.06, 0.1, 0.2], "digits": [0.02, 0.08, 0.2, 0.3],
    "ends": [0.004, 0.015, 0.05, 0.2, 0.5], "upper": [0.05, 0.15, 0.25, 0.4], "variety": [0.2, 0.3, 0.5, 1, 2], "runs": [0.005, 0.02, 0.05, 0.2],
}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, hashed feature, value of each feature; and the signals."""
    found, owner, h = signals(texts)
    n = len(texts)
    cell = (h >> np.uint64(48)).astype(np.int64)
    keys, count = np.unique(owner * FEATURES + cell, return_counts=True)
    value = np.sqrt(count) * 0.1
    norm = np.sqrt(np.bincount(keys // FEATURES, value**2, n))
    value = value / np.maximum(norm[keys // FEATURES], 1e-9)
    least = {name: n for name, n, *_ in LABELLERS}
    bins = [np.where((found[:, 0] >= least.get(s, 15)) | (s == "n_words"), np.searchsorted(_EDGES[s], found[:, c]), 8) for c, s in enumerate(SIGNALS)]
    places = words(*pack([f"{s}\x01{b}".encode() for s in SIGNALS for b in range(9)]))[1] >> np.uint64(48)
    extra = np.concatenate([places[c * 9 + b].astype(np.int64) for c, b in enumerate(bins)])
    rows = np.tile(np.arange(n), len(SIGNALS))
    return np.concatenate([keys // FEATURES, rows]), np.concatenate([keys % FEATURES, extra]), np.concatenate([value, np.ones(len(rows))]), found


def fit_scorer(n: int, row: np.ndarray, cell: np.ndarray, value: np.ndarray, label: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by Adam on the whole sample."""
    w = np.zeros(FEATURES + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1 if n else 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[cell] * value, n) + w[-1])))
        off = (p - label) / n
        g = np.append(np.bincount(cell, off[row] * value, FEATURES), off.sum()) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w.astype(np.float32)


class Model:
    def __init__(self, shares: np.ndarray, chances: np.ndarray, weights: np.ndarray):
        self.shares, self.chances, self.weights = shares, chances, weights

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Weak posterior and score, both chances of being good."""
        row, cell, value, found = features(texts)
        z = np.bincount(row, self.weights[cell] * value, len(texts)) + self.weights[-1]
        return posterior(votes(found), self.shares, self.chances), 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fit_rows: int = FIT_ROWS) -> Model:
    texts = docs.select(F.col(id_col).cast("string").alias("id"), nonnull_text(text_col).alias("text"))

    def vote(record_batches):
        for held in batches(arrow_rows(record_batches, "text"), lambda r: len(r[0]), _BATCH_BYTES):
            found = votes(signals([t.encode("utf-8") for (t,) in held])[0])
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x.tobytes()) for x in found], pa.binary())], ["votes"])

    table = texts.select("text").mapInArrow(vote, "votes binary").groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = np.array([np.frombuffer(bytes(r.votes), np.int8) for r in table]).reshape(-1, len(LABELLERS))
    counts = np.array([r.n for r in table], float)
    shares, chances = fit_labellers(patterns, counts)

    def featurise(record_batches):
        for held in batches(arrow_rows(record_batches, "text"), lambda r: len(r[0]), _BATCH_BYTES):
            row, cell, value, found = features([t.encode("utf-8") for (t,) in held])
            label = posterior(votes(found), shares, chances)
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(len(held) + 1))
            cut = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell[c].astype("<i4").tobytes() for c in cut], pa.binary()), pa.array([value[c].astype("<f4").tobytes() for c in cut], pa.binary()), pa.array(label, pa.float64())],
                ["cells", "values", "label"],
            )

    total = counts.sum()
    share = 1.0 if total <= fit_rows else 0.95 * fit_rows / total
    chosen = F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share)
    sample = texts.where(chosen).select("text").mapInArrow(featurise, "cells binary, values binary, label double").limit(fit_rows).collect()
    sizes = [len(r["cells"]) // 4 for r in sample]
    cell = np.frombuffer(b"".join(bytes(r["cells"]) for r in sample), "<i4")
    value = np.frombuffer(b"".join(bytes(r["values"]) for r in sample), "<f4").astype(float)
    weights = fit_scorer(len(sample), np.repeat(np.arange(len(sample)), sizes), cell, value, np.array([r.label for r in sample]))
    if not len(sample):
        weights[-1] = 2.0
    return Model(shares, chances, weights)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """id, posterior (of the votes), score (of the scorer), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(record_batches):
        for held in batches(arrow_rows(record_batches, "id", "text"), lambda r: len(r[1]), _BATCH_BYTES):
            weak, score = shared.value.judge([t.encode("utf-8") for _, t in held])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(weak), pa.array(score), pa.array(score >= threshold)], ["id", "posterior", "score", "kept"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), nonnull_text(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier, fitted on docs, does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, fit_rows=fit_rows))
    at = docs.columns.index(text_col)

    def run(record_batches):
        for b in record_batches:
            texts = ((t or "").encode("utf-8") for part in slices(b) for t in part.column(at).to_pylist())
            keep = [shared.value.judge(part)[1] >= threshold for part in batches(texts, len, _BATCH_BYTES)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
