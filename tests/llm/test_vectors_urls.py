import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import topk, urls


def by_force(vecs, k):
    good = [(i, [int(np.floor(float(np.float32(x)) * 64)) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        s = sorted(((-sum(a * b for a, b in zip(q, p)), i) for i, p in good if i != qi and len(p) == len(q)))
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_top_products_match_brute_force(spark, scale):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(8, 12))
    vecs = [(i, (base[i % 8] + 0.2 * rng.normal(size=12) * scale * (i % 5)).astype("float32").tolist()) for i in range(400)]
    vecs += [(400 + i, vecs[3][1]) for i in range(150)]
    vecs += [(600, None), (620, [None] * 12), (640, [float("nan")] * 12), (660, [float("inf")] * 12), (None, vecs[0][1]), (680, [0.0] * 12), (700, [1.0, 2.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    for block, qb in ((4096, 1024), (32, 8)):
        got = topk.top_products(df, F.col("vec_id") % 20 == 0, k=7, block=block, query_block=qb).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_force(vecs, 7)
    assert topk.top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://other.com#x": ("other.com", "", None, "allow"),
        "http://other.com/": ("other.com", "/", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://h.net/es/q?a://b": ("h.net", "/es/q", "net/es/", "block"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://ÉX.org/É": ("Éx.org", "/É", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, verdict string")
    for r in urls.url_filter(df, RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert urls.url_filter(df.limit(0), RULES).count() == 0


def test_blocks_and_rows_are_pruned(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16)).astype("float32")
    v *= (np.linspace(0.05, 4, 3000) / np.linalg.norm(v, axis=1))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    df = df.unionByName(df.where("vec_id % 100 = 0"))  # repeated query rows ask once
    got = topk.top_products(df, F.col("vec_id") % 20 == 0, k=5).collect()
    want = by_force([(r.vec_id, r.embedding) for r in df.collect()], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    # The last bucket alone gives floors that leave out most rows of a block over all lengths.
    ints = np.floor(v * 64).astype(np.int64)
    ids = np.arange(3000)
    first = topk.search_block(ids[::20], ints[::20], np.full(150, topk._NO_FLOOR), ids[2800:], ints[2800:], 5)
    floor = np.array([first[q][1][-1] for q in range(150)])
    met = []
    take = topk._Best.take
    monkeypatch.setattr(topk._Best, "take", lambda self, queries, cand: (met.append(len(queries) * len(cand)), take(self, queries, cand))[1])
    topk.search_block(ids[::20], ints[::20], floor, ids[:2800], ints[:2800], 5)
    assert sum(met) < 0.85 * 150 * 2800


def walk(edges, seeds, damping=0.85, rounds=150):
    score = {n: (1 - damping) * s for n, s in seeds.items()}
    out = {}
    for a, b, n in edges:
        out[a] = out.get(a, 0) + n
    for _ in range(rounds):
        new = {n: (1 - damping) * s for n, s in seeds.items()}
        for a, b, n in edges:
            if a in score:
                new[b] = new.get(b, 0) + damping * score[a] * n / out[a]
        score = new
    return score


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts) + '<a HREF = "/own">o</a>'
    pages = [("http://good.com/a", link("mid.org", "mid.org", "far.org")), ("http://bad.net/es/a", link("mid.org")), ("http://fan.org/a", link("bad.net")),
             ("http://mid.org/", link("leaf.org", "good.com")), ("http://leaf.org/", ""), ("http://lone.org/", None), ("http://fan2.org/", link("fan.org", "good.com", "good.com", "good.com"))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages * 2)], "page_id long, url string, html string")
    got = {(r.host): r.verdict for r in urls.url_filter(df, RULES, tolerance=1e-9).collect() if r.rule is None}
    e = {(a, b): n * 2 for (a, b), n in {("good.com", "mid.org"): 2, ("good.com", "far.org"): 1, ("bad.net", "mid.org"): 1, ("fan.org", "bad.net"): 1, ("mid.org", "leaf.org"): 1, ("mid.org", "good.com"): 1, ("fan2.org", "fan.org"): 1, ("fan2.org", "good.com"): 3}.items()}
    edges = [(a, b, n) for (a, b), n in e.items()]
    trust, distrust = walk(edges, {"good.com": 1.0}), walk([(b, a, n) for a, b, n in edges], {"bad.net": 1.0})
    want = {h: "block" if distrust.get(h, 0) > 0 and distrust[h] >= 0.5 * (distrust[h] + trust.get(h, 0)) else "allow" for h in ("fan.org", "mid.org", "leaf.org", "lone.org", "fan2.org")}
    # Two blocked hosts and one allowed: each kind's seeds sum to 1, or the larger kind would win everywhere.
    tied = [("http://a.com/", link("t.org")), ("http://b.net/es/", ""), ("http://c.net/es/", ""), ("http://t.org/", link("b.net")), ("http://www.u.org/", ""), ("http://u.org/", link("b.net", "c.net")),
            ("http://rel.org/", '<base href="//b.net/x/"><a href="page">p</a><a href="mailto:x@y.z">m</a>')]
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(tied)], "page_id long, url string, html string, _host string")
    more = {r.host: (r.verdict, r["_host"]) for r in urls.url_filter(df, RULES).collect()}
    assert {h: more[h] for h in ("t.org", "u.org", "www.u.org", "rel.org")} == {"t.org": ("allow", "clash"), "u.org": ("block", "clash"), "www.u.org": ("block", "clash"), "rel.org": ("block", "clash")}
    assert got == want and got["fan.org"] == "block" and got["mid.org"] == "allow"
