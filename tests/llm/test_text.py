import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import bytepairs, lm, packing, pieces, quality, secrets
from tests_llm_helpers import model, words

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def key(r):
    return str(tuple(r))


def test_pieces_match_the_library_and_their_spans_cover_the_text(spark, docs, rows, none):
    spm = pytest.importorskip("sentencepiece")
    path = model("piece_bpe_32k.model")
    sp = spm.SentencePieceProcessor(model_file=path)
    got = pieces.encode_pieces(docs, path, spans=True).collect()
    want = sorted((str(i), sp.encode(t or "", add_bos=True, add_eos=True)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert r.decoded == sp.decode(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
        raw = (text[r.doc_id] or "").encode() if r.doc_id is not None else None
        if raw:
            assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw
            for t, a, b in zip(r.ids[1:-1], r.starts[1:-1], r.ends[1:-1]):
                p = sp.id_to_piece(t)
                assert p.startswith("<0x") or p.replace("▁", " ").encode() in (raw[a:b], b" " + raw[a:b])
    assert pieces.encode_pieces(none, path).count() == 0
    ids = spark.createDataFrame([(1, want[0][1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode_pieces(ids, path).collect()} == {1: sp.decode(want[0][1]), 2: None}


def test_compiled_character_map_normalises_and_aligns_like_the_library():
    spm = pytest.importorskip("sentencepiece")
    for rule in ("nmt_nfkc_cf", "nfkc", "identity"):
        n = spm.SentencePieceNormalizer(rule_name=rule)
        own = pieces.Normaliser(next(v for k, v in pieces._fields(n.serialized_model_proto()) if k == 3))
        rng = random.Random(2)
        for _ in range(500):
            t = "".join(rng.choices("aB ÉéＡｂ①ﬁ  \t　がｶﾞ½Ωß漢é\n.,", k=rng.randint(0, 14)))
            want, offsets = n.normalize(t, with_offsets=True)
            got, source = own.normalise(t)
            assert got.decode() == want
            starts = np.cumsum([0, *(len(c.encode()) for c in want)])
            chars = {len(t[:i].encode()): i for i in range(len(t) + 1)}
            assert [chars[int(source[s])] for s in starts] == offsets


def test_token_counts_match_the_library_at_every_prefix(spark, docs, rows, none):
    tk = pytest.importorskip("tokenizers")
    path = model("word_bpe_49k.json")
    lib = tk.Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    got = bytepairs.token_counts(docs, path, limit=100).collect()
    want = [(i, len((t or "").encode()), n(t), n(t) > 100) for i, t, _ in rows]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert bytepairs.token_counts(none, path).count() == 0
    counter = bytepairs.counter(path)
    for w in ("internationalisation", "thththouer", "straße", "aaaaaaaaaaaa", "don", "éèñü"):
        ends = np.cumsum([len(c.encode()) for c in w])
        counts = counter.dp.prefixes(w)
        assert [counts[e - 1] for e in ends] == [n(w[:i + 1]) for i in range(len(w))]
    text = "the quick brown internationalisation of foxes"
    for budget in range(0, 12):
        cut = counter.truncate(text, budget)
        assert text.startswith(cut) and n(cut) <= budget
        assert all(n(text[:i]) > budget for i in range(len(cut) + 1, len(text) + 1))
    for text in ("don't we'll 'tis !'s it's' ''", "  \u0130stanbul A\u0130 x", "e\u0301t\u0301e\u0301 odd  ", "a<|endoftext|>b c", "日本語 1234", ""):
        assert counter.table(text).tolist() == [n(text[:i]) for i in range(len(text) + 1)], text


def test_byte_level_ids_match_the_library(rows):
    tk = pytest.importorskip("tokenizers")
    path = model("byte_bpe_50k.json")
    lib, own = tk.Tokenizer.from_file(path), bytepairs.Encoder(path)
    own.cache.size = 50
    texts = [t or "" for _, t, _ in rows] + [" 'll 's  x\n\n y 12ab٣ \u2003z", "\x1c\x1d a\x85b", "ͰͿ Ა ǅ"]
    for _ in range(2):
        assert [x.tolist() for x in (np.frombuffer(y, own.kind) for y in own.encode(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_keeps_every_id_once_and_fills_sequences(spark, docs, rows, none, capacity, monkeypatch):
    tk = pytest.importorskip("tokenizers")
    path = model("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "PART_TOKENS", 500)
    lib = tk.Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=capacity).collect()
    need = Counter()
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        need[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    by_seq: dict[int, list] = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces_ in by_seq.items():
        pieces_.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces_:
            assert r.offset == at
            at += r.length
        assert at == capacity or s == len(by_seq) - 1
    text = {(i, t) for i, t, _ in rows}
    assert sum(r.length for r in got) == sum(n for (_, n, _), c in need.items() for _ in range(c))
    lone = {i: t for i, t in text if i is not None and sum(x == i for x, _, _ in rows) == 1}
    for i, t in lone.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(none, path).count() == 0


def test_hilbert_keys_visit_every_cell_in_steps_of_one():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    assert sorted(packing.hilbert_keys(grid, 3).tolist()) == list(range(512))


def base_counts(t):
    w = words(t, lower=False)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    again = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_counts_and_depleted_documents(spark, docs, rows, none):
    got = quality.quality_rules(docs, max_percent=10, min_docs=2, min_words=50, min_share=0.5).where("n_words >= 0").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    text = {i: t for i, t, _ in rows}
    norm = lambda x: " ".join(words(x, lower=False)).lower()
    holders: dict[tuple, set] = {}
    size = Counter(s for s, _ in {(s, t) for _, t, s in rows if t is not None})
    depleted_some = False
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if words(x):
                holders.setdefault((s, norm(x)), set()).add(t)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        t = text[r.doc_id]
        assert tuple(r[n] for n in names) == base_counts(t), t
        gone = sum(len(words(x)) for x in (t or "").split("\n") if len(holders.get((r.source, norm(x)), ())) > max(2, 0.1 * size[r.source]))
        depleted = gone > 0 and (r.n_words - gone < 50 or r.n_words - gone < 0.5 * r.n_words)
        assert r.kept == (not r.base_failed and not depleted) and r["_text"] == "clash"
        depleted_some |= depleted and not r.base_failed
    assert depleted_some
    assert quality.quality_rules(none).count() == 0


def test_copies_of_a_clean_text_do_not_deplete_it(spark):
    from tests_llm_helpers import frame
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) for i in range(9))
    got = quality.quality_rules(frame(spark, [(i, clean, "h") for i in range(30)])).collect()
    assert all(r.kept for r in got)


def test_secrets_match_patterns_and_confirm_structures(spark, docs, rows, none):
    import base64
    import json
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")

    def base(t):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        return sorted(found)

    text = {i: t for i, t, _ in rows}
    for r in secrets.find_secrets(docs).collect():
        if r.doc_id is not None:
            want = base(text[r.doc_id])
            s = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
            assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
    assert secrets.find_secrets(none).count() == 0

    b64 = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = ".".join((b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64(b'{"sub":"1"}'), "c2ln"))
    fake = ".".join((b64(json.dumps({"kind": "none at all"}).encode()), b64(b'{"sub":"1"}'), "c2ln"))
    num = lambda n: b"\x02" + bytes([n]) + bytes(range(1, n + 1))
    inner = num(1) + b"".join(num(20) for _ in range(8))
    der = b"\x30\x81" + bytes([len(inner)]) + inner
    broken = der[:-1]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END RSA PRIVATE KEY-----"
    ssh = base64.b64encode(b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big")).decode()
    cases = {f"é {jwt} x": ["jwt"], f"{fake}": [], f"k {base64.b64encode(der).decode()}": ["key"], f"k {base64.b64encode(broken).decode()}": [],
             f"a\n{pem}\nb": ["key"], f"z {der.hex()} z": ["hex", "hexkey"], f"ssh {ssh}": ["key"]}
    from tests_llm_helpers import frame
    df = frame(spark, [(i, t, "h") for i, t in enumerate(cases)])
    for r in secrets.find_secrets(df).collect():
        t, kinds = list(cases.items())[r.doc_id]
        found = [x.split(":") for x in r.spans.split(",") if x]
        assert [x[0] for x in found if x[0] != "assign"] == kinds, t
        for kind, a, b in found:
            if kind == "jwt":
                assert t[int(a):int(b)] == jwt
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert masked[0] == "é [secret] x" and masked[1] == fake and masked[4] == "a\n[secret]\nb"
    assert secrets.mask_secrets(docs).columns == docs.columns
    clash = docs.withColumn("_masked", F.lit("mine")).withColumn("__masked", F.lit("too"))
    out = secrets.mask_secrets(clash.unionByName(clash))
    assert out.columns == clash.columns and {(r._masked, r["__masked"]) for r in out.collect()} == {("mine", "too")} and out.count() == 2 * docs.count()
    assert secrets.mask_secrets(clash.limit(0)).count() == 0


def test_language_model_counts_base_scores_and_held_out_gain(spark, docs, rows, none):
    rng = random.Random(9)
    follow = {i: [rng.randint(0, 40) for _ in range(3)] for i in range(41)}

    def chain(n):
        out = [0]
        for _ in range(n):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(f"w{x}" for x in out)
    from tests_llm_helpers import frame
    some = [*rows, *((1000 + i, chain(80), "h") for i in range(120))]
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    for order in (2, 3):
        got = lm.interpolated_scores(frame(spark, some).repartition(3), train=part != 2, tune=part == 3, order=order).collect()
        assert len(got) == len(some)
        tokens = {i: [*words(t), None] for i, t, _ in some}
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(x for i, t, _ in some if i is not None and not held(i) for x in [*words(t), None])
        n, v = sum(c.values()), len(c)
        base = model_ = count = 0
        for r in got:
            if r.doc_id is None:
                continue
            x = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(w in c for w in x), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
            if held(r.doc_id) and r.doc_id >= 1000:
                base, model_, count = base + r.base_score, model_ + r.score, count + len(x)
        assert model_ / count > base / count + 0.5
    assert lm.interpolated_scores(none, train=part != 2, tune=part == 3).count() == 0


def test_mixture_weights_recover_a_known_mixture():
    rng = np.random.default_rng(4)
    which = rng.random(20000) < 0.3
    rows = np.where(which[:, None], [0.5, 0.01], [0.01, 0.2]) * rng.uniform(0.9, 1.1, (20000, 2))
    share = lm.mixture(rows, np.ones(20000), 2)
    assert abs(share[0] - 0.3) < 0.03 and abs(share.sum() - 1) < 1e-9


def test_a_key_block_encoded_once_more_is_confirmed():
    import base64
    number = lambda n: bytes([0x02, n]) + bytes(range(1, n + 1))
    body = b"\x02\x01\x00" + b"".join(number(n) for n in (9, 3, 8, 7, 6))
    der = bytes([0x30, len(body)]) + body
    block = lambda inner: b"-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(inner) + b"\n-----END RSA PRIVATE KEY-----\n"
    for inner, want in ((der, [4]), (der[:-1], [])):
        text = b"key " + base64.b64encode(block(inner)) + b" end"
        assert [k for _, k, _ in secrets.scan(text) if k > 2] == want
