"""Phrase mining against counting by hand."""

import re
from collections import Counter

import pytest

from framelake.llm import phrases
from tests_llm_helpers import LOWER


def by_hand(rows, least, keep, longest=4):
    """Result rows for rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang, p] = (a, l, r, score)
    gone = {(lang, p[i:i + k]) for (lang, p), (a, *_) in out.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * out[lang, p[i:i + k]][0]}
    result = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(p).encode(), l, r) for (x, p), (a, l, r, s) in out.items() if x == lang and (x, p) not in gone)
        result += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(mine[:keep])]
    return sorted(result)


def frame(spark, rows):
    return spark.createDataFrame([(x, t, "clash", 1) for x, t in rows], "lang string, text string, phrase string, _k long").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def speech(rows):
    langs = ["en", None, "de", "en"]
    made = [(langs[i % 4], t) for i, (_, t, _) in enumerate(rows)]
    made += [("en", "New York, new York City!\tand the end of the day. The END of the day")] * 6 + [(None, "x\vy x y; x y z")] * 4
    return made


@pytest.mark.parametrize("buckets", [8, 1 << 20])  # with 8, nearly every phrase gets to exact counting
def test_every_phrase_whatever_the_buckets(spark, speech, buckets):
    assert found(phrases.mine_phrases(frame(spark, speech), least=3, keep=10_000, buckets=buckets)) == by_hand(speech, 3, 10_000)


def test_the_best_of_each_language_and_the_shuffle_join(spark, speech, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_KEYS", 5)
    monkeypatch.setattr(phrases, "HOT", 3)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert found(phrases.mine_phrases(frame(spark, speech), least=4, keep=7)) == by_hand(speech, 4, 7)


def test_tables_without_words(spark):
    assert phrases.mine_phrases(frame(spark, [])).count() == 0
    assert phrases.mine_phrases(frame(spark, [("en", None), (None, ""), ("en", " .,\n")]), least=1).count() == 0


def test_scores_beyond_64_bits(spark):
    counts = [("en", "a", 9 * 10**12, 1), ("en", "b", 10**13, 1), ("en", "a b", 8 * 10**12, 2)]
    (r,) = phrases.scored(spark.createDataFrame(counts, "lang string, phrase string, f long, words int"), 2_000_000).collect()
    assert (r.l, r.r, r.score) == (9 * 10**12, 10**13, 2_000_000 * 8 // 19)
