"""The string kernel against products written out, and the classifier on held-out documents."""

import itertools
import random
from collections import Counter
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import toxicity as T


def products(w):
    """The triples of a word's letters and their weights, by the rule."""
    code = [0] + [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % T.OTHERS for c in w]
    out = Counter()
    for i, j, k in itertools.combinations(range(len(code)), 3):
        if k - i < T.SPAN:
            out[(code[i] * T.SYMBOLS + code[j]) * T.SYMBOLS + code[k]] += T.DECAY ** (k - i - 2)
    return out


def test_kernel_is_that_of_gapped_subsequences():
    words = ["idiot", "idxiot", "aaaaaaaa", "ab", "a", "réeuxê", "q" * 19, "aaaaaaaa"]
    got = {}
    for part, key, weight in T._subsequences(words):
        for p, k, v in zip(part, key, weight):
            got[int(p)] = Counter()
            for x, y in zip(k.tolist(), v.tolist()):
                got[int(p)][x] += y
    for i, w in enumerate(words):
        want = products(w)
        norm = sqrt(sum(v * v for v in want.values()))
        assert {k: pytest.approx(v / norm) for k, v in want.items()} == got.get(i, {})


def test_collapsed_weights_are_the_landmarks_decision():
    space = T._Landmarks(["idiot", "moron", "table", "clown", "the"])
    theta = np.arange(1.0, space.root.shape[1] + 1)
    words = ["idiots", "idxiot", "tablet", "xyz", "moron"]
    assert np.allclose(T.Model(space.collapsed(theta), 0.0, 1.0, 0.0).words(words), space.features(words) @ theta, atol=1e-4)
    kernel = space.features(["idiot", "moron"]) @ space.features(["idiot", "moron"]).T
    a, b = products("idiot"), products("moron")
    dot = sum(v * b[k] for k, v in a.items()) / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    assert np.allclose(kernel, [[1, dot], [dot, 1]], atol=1e-3)


def test_words_of_sentences():
    assert T.words("You i d i o t! An id-iot. \nSo a b") == ["you", "idiot", "an", "idiot", "so", "a", "b"]
    assert T.words("x y z") == ["xyz"] and T.words(None) == T.words("") == T.words(" .,\n!") == []
    assert [len(w) for w in T.words("x" * 45)] == [19, 19, 19, 15] and T.words("q" * 19) == ["q" * 19]


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "re", "es", "ti", "at"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    insults = ["moron", "idiot", "clown", "scum", "loser"]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            x = rng.choice(insults)
            cut = rng.randint(1, len(x) - 1)
            w.insert(rng.randrange(len(w)), rng.choice([x, x, x[:cut] + rng.choice(".-*") + x[cut:], x[:cut] + "x" + x[cut:], " ".join(x)]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.train(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in T.toxicity(docs, model).collect()}
    test = [(got[i] >= 0.5, y == 1) for i, _, y in rows if i % 3 == 0]
    assert sum(p == y for p, y in test) / len(test) >= 0.95


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "fine words"), (4, "fine words"), (5, "x" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, None), (4, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    out = T.toxicity(docs, T.train(docs, labels, F.lit(True))).collect()
    by = {r.doc_id: r.score for r in out}
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out) and by[1] == by[2] and by[3] > by[4] and by[None] == by[4]
    model = T.train(docs, labels.limit(0), F.lit(True))
    assert {round(r.score, 9) for r in T.toxicity(docs, model).collect()} == {round(1 / (1 + np.exp(30)), 9)}
    assert T.toxicity(docs.limit(0), model).count() == 0
