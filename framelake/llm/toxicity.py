"""Operator 12: toxicity by a support vector machine on gap-weighted letter subsequences, with Nyström landmarks, trained on sentences of labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import bounded_batches, cut

#: Letters are told apart as a to z and so many classes of others by code point; class 0 marks a word's beginning.
OTHERS = 21
SYMBOLS = 27 + OTHERS
#: Letters of a word; longer ones are read as overlapping parts.
LONG, STEP = 19, 10
#: Three letters in order count if they lie within so many places; each place between them weighs DECAY.
SPAN, DECAY = 6, 0.7

_TRIPLES = np.array(sorted(((i, j, k) for i in range(LONG + 1) for j in range(i + 1, LONG + 1) for k in range(j + 1, LONG + 1) if k - i < SPAN), key=lambda t: t[2]))
_WEIGHT = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] - 2.0)
#: Triples of the words with so many symbols, the mark of the beginning among them.
_OF_LENGTH = np.searchsorted(_TRIPLES[:, 2], np.arange(LONG + 2))
_MARK = re.compile(r"[^\w\s]|_")


def words(text: str | None) -> list[str]:
    """Words of a text in order, over all its sentences.

    Case, and marks inside or around words, are dropped; three and more single letters in a row are a word that is
    spelt out; a word of over LONG letters is read as overlapping parts.
    """
    found = _MARK.sub("", text.lower()).split() if text else []
    if not found:
        return found
    sizes = set(map(len, found))
    if 1 in sizes:
        joined, run = [], []
        for w in (*found, ""):
            if len(w) == 1:
                run.append(w)
                continue
            if run:
                joined.extend(["".join(run)] if len(run) > 2 else run)
                run = []
            joined.append(w)
        found = joined[:-1]
    if max(map(len, found)) > LONG:
        found = [p for w in found for p in ([w] if len(w) <= LONG else (w[a:a + LONG] for a in range(0, len(w) - LONG + STEP, STEP)))]
    return found


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their triples as numbers, weights): words of one length together; each word's weights have norm 1."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % OTHERS).astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size).tolist():
        columns = _OF_LENGTH[n + 1]
        rows = np.flatnonzero(size == n)
        for part in np.array_split(rows, len(rows) // 4096 + 1) if columns else ():
            w = np.zeros((len(part), n + 1), np.int32)
            w[:, 1:] = letters[begin[part][:, None] + np.arange(n)]
            i, j, k = _TRIPLES[:columns].T
            # A triple and its column in one number, so that equal triples of a word stand together once sorted.
            both = np.sort(((w[:, i] * SYMBOLS + w[:, j]) * SYMBOLS + w[:, k]) * 256 + np.arange(columns, dtype=np.int32), axis=1)
            key, weight = both >> 8, _WEIGHT[both & 255]
            norm = (weight * weight).sum(1)
            for lag in range(1, columns):
                same = key[:, lag:] == key[:, :-lag]
                if not same.any():
                    break
                norm += 2 * (weight[:, lag:] * weight[:, :-lag] * same).sum(1)
            yield part, key, weight / np.sqrt(norm)[:, None]


@dataclass
class Model:
    """The machine's decision over landmarks, collapsed into a weight for each triple, an offset, and what makes probabilities of it."""

    triple: np.ndarray
    offset: float
    slope: float
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for part, key, weight in _subsequences(words):
            out[part] = (self.triple[key] * weight).sum(1)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _best(score: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The n best scored places of each owner."""
    order = np.lexsort((-score, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    return order[rank < n]


class _Landmarks:
    """The kernel of words with the landmarks, in coordinates whose products are those of the landmarks' span."""

    def __init__(self, landmarks: list[str]):
        triples = np.zeros((SYMBOLS**3, len(landmarks)), np.float32)
        for part, key, weight in _subsequences(landmarks):
            np.add.at(triples, (key, part[:, None]), weight.astype(np.float32))
        self.at = np.flatnonzero(triples.any(1))
        self.place = np.zeros(SYMBOLS**3, np.int32)
        self.place[self.at] = np.arange(1, len(self.at) + 1)
        self.triples = np.vstack([np.zeros((1, len(landmarks)), np.float32), triples[self.at]])
        values, vectors = np.linalg.eigh(self.triples.T.astype(np.float64) @ self.triples)
        use = values > 1e-6 * values.max()
        self.root = vectors[:, use] / np.sqrt(values[use])

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.triples.shape[1]), np.float32)
        for part, key, weight in _subsequences(words):
            got = np.zeros((len(part), out.shape[1]), np.float32)
            for c in range(key.shape[1]):
                got += weight[:, c, None].astype(np.float32) * self.triples[self.place[key[:, c]]]
            out[part] = got
        return out @ self.root.astype(np.float32)

    def collapsed(self, theta: np.ndarray) -> np.ndarray:
        out = np.zeros(SYMBOLS**3)
        out[self.at] = (self.triples @ (self.root @ theta))[1:]
        return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear machine, by Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1] + 1)
    one = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-6))
    for _ in range(rounds):
        inside = y * (one @ w) < 1
        a, c = one[inside], cost[inside]
        new = np.linalg.solve(2 * a.T @ (a * c[:, None]) + ridge, 2 * a.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, with smoothed targets."""
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (goal - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[str | None], labels: list[int], landmarks: int = 384, cost: float = 5000.0, rounds: int = 10, hard: int = 3) -> Model:
    """A model of texts labelled 1 or 0.

    A sentence is as toxic as its worst word, a text as its worst sentence. Only texts are labelled, so the machine
    is trained in rounds: of a text of label 1 on the word that scores highest, of the others on the `hard`
    highest, which pile up. Landmarks are the words most typical of label 1 and the most frequent others.
    Without both labels the share of label 1 is the score.
    """
    docs = [sorted(set(words(t))) for t in texts]
    y = np.array(labels, np.int64)
    used = [i for i, d in enumerate(docs) if d]
    known = y[used]
    if not used or known.min() == known.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0
        return Model(np.zeros(SYMBOLS**3), 0.0, 1e-3, float(np.log(share / (1 - share))) if share else -30.0)
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for i in used for w in docs[i]])
    names = list(index)
    owner = np.repeat(np.arange(len(used)), [len(docs[i]) for i in used])
    by = np.bincount(flat, known[owner], len(names))
    other = np.bincount(flat, minlength=len(names)) - by
    odds = np.log((by + 0.5) / (known.sum() + 1) / ((other + 0.5) / ((known == 0).sum() + 1)))
    typical = np.argsort(-by * odds, kind="stable")[:landmarks // 2]
    common = np.setdiff1d(np.argsort(-other, kind="stable")[:landmarks], typical)[:landmarks - len(typical)]
    space = _Landmarks([names[i] for i in (*typical, *common)])
    value = np.clip(odds, -3, 3) * np.minimum(by + other, 5) / 5
    negatives, model = np.empty(0, np.int64), None
    features, place = np.empty((0, space.root.shape[1]), np.float32), np.full(len(names), -1)
    for _ in range(rounds):
        top, near = _best(value[flat], owner, 1), _best(value[flat], owner, hard)
        negatives = np.union1d(negatives, near[known[owner[near]] == 0])
        (good, n_good), (bad, n_bad) = (np.unique(flat[at], return_counts=True) for at in (top[known[owner[top]] == 1], negatives))
        rows = np.concatenate([good, bad])
        new = np.unique(rows[place[rows] < 0])
        place[new] = len(features) + np.arange(len(new))
        features = np.vstack([features, space.features([names[i] for i in new])])
        sign = np.where(np.arange(len(rows)) < len(good), 1.0, -1.0)
        share = np.concatenate([n_good / (2 * n_good.sum()), n_bad / (2 * n_bad.sum())])
        theta, offset = _squared_hinge(features[place[rows]].astype(np.float64), sign, cost * share)
        model = Model(space.collapsed(theta), offset, 1.0, 0.0)
        value = model.words(names)
    margin = np.full(len(used), -np.inf)
    np.maximum.at(margin, owner, value[flat] + model.offset)
    model.slope, model.shift = _logistic(margin, known)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 6000, fit_chars: int = 24_000_000) -> Model:
    """A model fitted in one task on at most fit_rows labelled rows and fit_chars characters of them, taken by a hash of the id.

    labels has a row for each labelled id, `usable` says which may be used; null labels and ids with several count
    once, by the highest. Only ids are shuffled to choose the sample; texts are read once.
    """
    ids = labels.where(usable & F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_y"))
    ids = ids.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(fit_rows)
    found = cut(docs.select(F.col(id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(ids), "_id").select("_h", "_id", "_y", "_t"))
    upto = F.sum(F.coalesce(F.length("_t"), F.lit(0))).over(Window.orderBy("_h", "_id", F.xxhash64("_t")).rowsBetween(Window.unboundedPreceding, 0))
    sample = found.withColumn("_n", upto).where((F.col("_n") <= fit_chars) | (F.col("_n") == F.length("_t"))).select("_t", "_y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for f in frames for r in zip(f["_t"].tolist(), f["_y"].tolist())]
        m = fit([t for t, _ in rows], [int(v > 0) for _, v in rows])
        yield pd.DataFrame({"triple": [m.triple.astype("<f4").tobytes()], "offset": [m.offset], "slope": [m.slope], "shift": [m.shift]})
    r = sample.coalesce(1).mapInPandas(run, "triple binary, offset double, slope double, shift double").first()
    if r is None:
        return fit([], [])
    return Model(np.frombuffer(r.triple, "<f4"), r.offset, r.slope, r.shift)


def toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", held: int = 400_000) -> DataFrame:
    """(id, score, worst): the probability of label 1 by the whole text's worst word, and that word.

    Every word of a text is scored; a null or empty text, or one without words, scores like a word of no landmark's
    letters. Repeated rows score alike, an empty table gives an empty result, other columns take no part. A
    worker keeps the scores of up to `held` words; nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known = sent.value, {}
        for f in frames:
            texts = [set(words(t)) for t in f["_text"]]
            if len(known) > held:
                known.clear()
            new = list(set().union(*texts).difference(known))
            known.update(zip(new, m.words(new).tolist()))
            worst = [max(t, key=lambda w: (known[w], w)) if t else "" for t in texts]
            margin = m.offset + np.array([known[w] if w else 0.0 for w in worst])
            yield pd.DataFrame({id: f["_id"], "score": m.probability(margin), "worst": worst})
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, f"`{id}` {kind}, score double, worst string")
