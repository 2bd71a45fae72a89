import hashlib
import random
import re
from collections import Counter

import numpy as np

from framelake.llm import neardup, suffixes, words
from tests_llm_helpers import shingle_set


def linked(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t, _ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_all_pairs(spark, docs, rows, none):
    for k in (2, 5):
        want = linked(rows, k, 80)
        got = neardup.near_duplicates(docs, percent=80, k=k).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            else:
                assert r.kept
    assert neardup.near_duplicates(none).count() == 0


def test_many_near_copies_in_one_bucket(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*base[:i % 190], f"new{i}", *base[i % 190 + 1:]]), "h") for i in range(120)] + [(500 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(50)), "h") for i in range(20)]
    from tests_llm_helpers import frame
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), percent=80, k=2).collect()}
    assert got == {i: c for i, (_, c) in linked(rows, 2, 80).items()}


def test_repeated_rows_of_a_crowd_keep_its_links(spark):
    from tests_llm_helpers import frame
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    changed = lambda spots, tag: " ".join(f"{tag}{i}" if i in spots else w for i, w in enumerate(base))
    rows = [(i, changed({rng.randrange(100)}, f"a{i}x"), "h") for i in range(40)]
    # Strays: too far from the crowd, each linked with the one before by the changes that they share.
    spots = rng.sample(range(100), 26)
    rows += [(100 + n, changed(set(spots[:4 + 2 * n]), "s"), "h") for n in range(11)] + [(200 + n, changed(set(spots[-4:]) | set(range(n, 100, 7)), f"z{n}"), "h") for n in range(5)]
    want = {i: c for i, (_, c) in linked(rows, 2, 80).items()}
    many = [r for r in rows for _ in range(1 + 3 * (r[0] % 2))]
    for given in (rows, many):
        got = neardup.near_duplicates(frame(spark, given).repartition(5), percent=80, k=2).collect()
        assert len(got) == len(given) and {r.doc_id: r.component_id for r in got} == want


def test_links_of_exactly_80_percent_are_found(spark):
    from tests_llm_helpers import frame
    rows = []
    for n in range(300):  # 80 of 100 shingles: nine words in ten are shared, in one run
        words = [f"p{n}w{i}" for i in range(81)]
        rows += [(2 * n, " ".join(words + [f"p{n}a{i}" for i in range(10)]), "h"), (2 * n + 1, " ".join(words + [f"p{n}b{i}" for i in range(10)]), "h")]
    got = neardup.near_duplicates(frame(spark, rows), percent=80, k=2).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_parity_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(2)
    for shared, own in ((300, 5), (1000, 200), (10, 0)):
        a, b, c = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (shared, own, own))
        bits = neardup.parity_sketch(np.concatenate([a, b, a, c]), np.array([shared + own] * 2))
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= 2 * own


def test_signatures_estimate_similarity_and_every_slot_is_filled():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    sig = neardup.superminhash(np.concatenate([a, b, a[:1]]), np.array([400, 400, 1]))
    assert (sig[2] < np.uint64(2**64 - 1)).all()
    assert abs((sig[0] == sig[1]).mean() - 320 / 480) < 0.15
    assert (neardup.superminhash(a[::-1].copy(), np.array([400])) == sig[:1]).all()


def test_word_hashes_are_equal_exactly_for_equal_words():
    texts = ["b a  b\x0bA a\xa0b", None, "", "aa b"]
    h, n = words.word_hashes(texts)
    assert n.tolist() == [5, 0, 0, 2]
    seen = ["b", "a", "b", "a", "a\xa0b", "aa", "b"]
    assert [[x == y for x in h] for y in h] == [[x == y for x in seen] for y in seen]


def cut_by_force(rows, length):
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    c = Counter(x[p:p + length] for _, x in raw for p in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if c[x[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest(), spans > 0))
    return sorted(out, key=str)


def test_repeated_strings_match_all_windows(spark, docs, rows, none):
    for length, per_shard in ((400, 2048), (60, 2)):
        got = suffixes.remove_repeats(docs, length=length, digest=True, per_shard=per_shard).collect()
        assert sorted(map(tuple, got), key=str) == cut_by_force(rows, length)
    assert suffixes.remove_repeats(none).count() == 0
    assert suffixes.remove_repeats(docs).columns == docs.columns


def passages_by_force(rows, length, words):
    """Remaining bytes when repeated strings of `length` bytes and repeated passages of `words` words go."""
    raw = [(t or "").encode() for _, t, _ in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    split = [[x[a:b] for a, b in s] for x, s in zip(raw, spans)]
    strings = Counter(x[p:p + length] for x in raw for p in range(len(x) - length + 1))
    runs = Counter(tuple(w[i:i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for x, s, w in zip(raw, spans, split):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if strings[x[p:p + length]] > 1:
                gone[p:p + length] = True
        for i in range(len(w) - words + 1):
            if runs[tuple(w[i:i + words])] > 1:
                gone[s[i][0]:s[i + words - 1][1]] = True
        out.append(bytes(b for b, g in zip(x, gone) if not g))
    return out


def test_repeated_passages_match_all_windows(spark, docs, rows, none):
    for words in (51, 9, 3):
        want = sorted(hashlib.sha256(x).hexdigest() for x in passages_by_force(rows, 400, words))
        assert sorted(r.kept_sha256 for r in suffixes.remove_repeats(docs, words=words, digest=True).collect()) == want
    assert suffixes.remove_repeats(none, words=51).count() == 0
    assert suffixes.remove_repeats(docs, words=51).columns == docs.columns


def test_a_crowded_anchor_is_merged_across_shards(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(90)
    rows = [(i, noise(50 + i) + passage[i % 7: 60 + i % 23] + noise(40), "h") for i in range(40)]
    from tests_llm_helpers import frame
    got = suffixes.remove_repeats(frame(spark, rows), length=50, digest=True, per_shard=3).collect()
    assert sorted(map(tuple, got), key=str) == cut_by_force(rows, 50)


def test_suffix_order_and_repeats_on_random_bytes():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([3, 9, 17, 40])
        letters = rng.choice([b"ab", b"abcdefgh", b"a"])
        bodies = [bytes(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(rng.randint(1, 6))]
        bodies[0] += bodies[-1][:60]
        c = Counter(x[p:p + length] for x in bodies for p in range(len(x) - length + 1))
        want = [[c[x[p:p + length]] > 1 for p in range(max(0, len(x) - length + 1))] for x in bodies]
        assert [x.tolist() for x in suffixes.repeated_starts(bodies, length)] == want
        data = np.frombuffer(b"".join(bodies), np.uint8)
        if len(data):
            s = data.tobytes()
            order = suffixes.suffix_array(data, length).tolist()
            assert [s[p:p + length] for p in order] == sorted(s[p:p + length] for p in order)


def test_shared_passages_of_few_bytes_are_counted_and_stay(spark, tmp_path):
    from framelake.llm import registry
    from tests_llm_helpers import frame
    own = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(4)]
    passage, fifty = (" ".join(f"{c}{j}" for j in range(n)) for c, n in (("p", 52), ("q", 50)))
    texts = [f"{own[0]} {passage} end", f"{passage}\n{own[1]}", f"{own[2]} {fifty} x", f"{own[3]} {fifty} y", "", None]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    assert len(passage) < 400
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.op6_suffix_arrays(spark, str(tmp_path)).collect()}
    assert {i: r.n_passages for i, r in got.items()} == {0: 2, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0}
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.touched) for r in got.values()) == cut_by_force(rows, 400)


def test_passage_counts_match_all_windows(spark, docs, rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    runs = Counter(tuple(w[i:i + 9]) for w in split for i in range(len(w) - 8))
    want = sorted((str(i), sum(runs[tuple(w[j:j + 9])] > 1 for j in range(len(w) - 8))) for (i, _, _), w in zip(rows, split))
    assert sorted((str(r.doc_id), r.n_passages) for r in suffixes.remove_repeats(docs, digest=True, counted=9).collect()) == want
