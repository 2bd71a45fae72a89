"""Operator 7: URL rules, and trust and distrust propagated over host links, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import ascii_lower, cut, fresh, lookup_side

BASE = "(?is)<base\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"'>]*)"
HREF = "(?is)\\bhref\\s*=\\s*[\"']([^\"'>]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits. rules: (allow or block, host/path) pairs, a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, prefix = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst, n): links between hosts.

    How often pages of one host link to another: absolute links, and relative ones where a base element moves
    them to another host (else they stay on their own, and count for nothing). Besides, a host and the
    domain that it lies directly under are linked once each way where both have pages, as www.a.org and a.org.
    """
    absolute = lambda c: ascii_lower(F.regexp_extract(c, "^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\s]*)", 1))
    base = absolute(F.regexp_extract(F.col(html), BASE, 1))
    raw = pages.select(url_host(F.col(url)).alias("src"), base.alias("base"), F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), 1)).alias("to"))
    stays = ~F.col("to").rlike("^\\s*([A-Za-z][A-Za-z0-9+.-]*:|//|#)")
    links = raw.select("src", F.when(stays, F.col("base")).otherwise(absolute(F.col("to"))).alias("dst"))
    counted = links.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = cut(pages.select(url_host(F.col(url)).alias("src")).where("src != ''").distinct())
    above = hosts.select("src", F.regexp_extract("src", "^[^.]+\\.(.+\\..+)$", 1).alias("dst")).where("dst != ''").join(hosts.select(F.col("src").alias("dst")), "dst", "left_semi")
    both = above.select("src", "dst").unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return counted.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, per_cut: int = 4) -> DataFrame:
    """(node, kind, score): personalised PageRank of seeds(node, kind, seed) over edges(src, dst, kind, share).

    kind tells independent walks apart, so that both directions run in one join; each kind's seeds sum to 1.
    Mass at nodes without outgoing edges leaves the walk. Every per_cut rounds the scores are written and the
    change is measured, until all of it together is below tolerance: what still moves shrinks by damping a round.
    """
    base = seeds.select("node", "kind", ((1 - damping) * F.col("seed")).alias("score"))
    now = cut(base)
    while True:
        last = now
        for _ in range(per_cut):
            sent = now.withColumnRenamed("node", "src").join(edges, ["src", "kind"]).select(
                F.col("dst").alias("node"), "kind", (damping * F.col("score") * F.col("share")).alias("score"))
            now = base.unionByName(sent).groupBy("node", "kind").agg(F.sum("score").alias("score"))
        now = cut(now)
        moved = now.withColumn("s", F.col("score")).unionByName(last.withColumn("s", -F.col("score")))
        change = moved.groupBy("node", "kind").agg(F.abs(F.sum("s")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
        if change < tolerance:
            return now


def distrusted_hosts(pages: DataFrame, url: str, html: str, rules: Sequence[tuple[str, str]], threshold: float,
                     **walk) -> DataFrame:
    """(host): hosts whose distrust is at least `threshold` of their trust and distrust.

    Seeds are each host's shares of pages that the rules allow or block, each kind divided by its sum over
    all hosts. Trust follows links; distrust runs from a blocked host to those that link to it.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    seen = pages.select(host.alias("node"), match_rule(host, path, rules)[1].alias("v")).where("node != ''")
    share = seen.groupBy("node").agg(F.count("*").alias("n"),
                                     F.count_if(F.col("v") == "allow").alias("na"), F.count_if(F.col("v") == "block").alias("nb"))
    per = cut(share.select("node", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("na") / F.col("n")).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("nb") / F.col("n")).alias("seed")))).alias("x"))
        .select("node", "x.kind", "x.seed").where("seed > 0"))
    whole = per.groupBy("kind").agg(F.sum("seed").alias("of"))  # two rows
    per = per.join(F.broadcast(whole), "kind").select("node", "kind", (F.col("seed") / F.col("of")).alias("seed"))
    links = cut(host_edges(pages, url, html))
    both = links.select("src", "dst", F.lit("trust").alias("kind"), "n").unionByName(
        links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("distrust").alias("kind"), "n"))
    out = both.groupBy("src", "kind").agg(F.sum("n").alias("total"))
    edges = cut(both.join(out, ["src", "kind"]).select("src", "dst", "kind", (F.col("n") / F.col("total")).alias("share")))
    score = propagate(edges, per, **walk)
    each = score.groupBy("node").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("t"),
                                     F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("d"))
    return each.where((F.col("d") > 0) & (F.col("d") >= threshold * (F.col("d") + F.col("t")))).select(F.col("node").alias("host"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", html: str = "html",
               threshold: float = 0.5, **walk) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A fitting rule decides; the longest wins. Other pages follow their host: blocked if propagated distrust
    reaches `threshold` of the host's trust and distrust together, else allowed. Scores live per host, and
    links are summed per pair of hosts before any join; a host with a third of all pages is one row there.

    Null urls, or urls without ://, have an empty host and path, fit no rule and are allowed. Null or empty
    html has no links. Repeated rows are judged alike. An empty table gives an empty result. Other columns
    pass through, whatever their names; columns named host, path, rule or verdict are replaced.
    """
    bad = cut(distrusted_hosts(pages, url, html, rules, threshold, **walk))
    h, p, v, b = fresh([*pages.columns, "host", "path", "rule", "verdict"], "_host", "_path", "_verdict", "_bad")
    out = pages.withColumns({h: url_host(F.col(url)), p: url_path(F.col(url))})
    rule, verdict = match_rule(F.col(h), F.col(p), rules)
    out = out.withColumns({"host": F.col(h), "path": F.col(p), "rule": rule, v: verdict})
    out = out.join(lookup_side(bad.select(F.col("host").alias(b))), F.col(h) == F.col(b), "left")
    late = F.when(F.col(b).isNotNull(), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(v, late)).drop(h, p, v, b)
