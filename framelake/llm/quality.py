"""Operator 5: quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import SEPARATOR_CLASS, SEPARATORS, cut, fresh, lookup_side

SYMBOLS = "#*$%&|<>"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATOR_CLASS + "+"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of column `text`.

    Three-word windows are hashed, sorted with their positions inside the row, and those with an equal
    neighbour are laid out again by position: n log n for a text, and no row leaves its task. A filter on
    the counts is never pushed into them: Spark would copy the whole expression into it, for every word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    h, lines, s, p = fresh(df.columns, "_h", "_lines", "_s", "_p")
    df = df.withColumns({
        h: F.transform(_words(t), lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.translate(t, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        lines: _lines(t),
    })
    df = df.withColumns({
        "n_words": F.size(h).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        s: F.sort_array(F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("p")),
        )),
    })
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"]))
    df = df.withColumn(p, F.sort_array(F.transform(again, lambda x: x["p"])))
    widths = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    # The partition's number, always 0 or more, is not deterministic to Spark, which stops filters here, whichever counts are asked for.
    done = df.withColumn("n_repeat_words", total)
    return done.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in RESULT[:5]}).drop(h, lines, s, p)


def text_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, doc, lines array<struct<h, n>>) of each different text of a host: hashes and word counts of its normalised lines, in order."""
    norm = lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(SEPARATORS)), SEPARATOR_CLASS + "+", " "))
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    each = F.transform(F.transform(_lines(F.col(text)), norm), lambda x: F.struct(F.xxhash64(x).alias("h"), count(x).cast("long").alias("n")))
    found = docs.where(F.col(text).isNotNull()).select(_host_key(host).alias("host"), F.xxhash64(F.col(text)).alias("doc"), each.alias("lines"))
    return cut(found.dropDuplicates(["host", "doc"]))


def _host_key(host: str) -> Column:
    return F.xxhash64(F.col(host), F.lit("host"))


def frequent_lines(lines: DataFrame, max_percent: float, min_docs: int) -> DataFrame:
    """(host, h) of lines in more than max_percent of their host's texts, and more than min_docs: at most 100 / max_percent times a text's lines for a host."""
    size = cut(lines.groupBy("host").agg(F.count("*").alias("of")))
    often = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("c"))
    often = often.where(F.col("c") > min_docs).join(lookup_side(size), "host")
    return cut(often.where(F.col("c") * 100 > F.col("of") * max_percent).select("host", "h"))


def depleted_texts(lines: DataFrame, often: DataFrame, min_words: int, min_share: float) -> DataFrame:
    """(host, doc) of texts that keep fewer than min_words words, or under min_share of them, without frequent lines."""
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    hit = lines.select("host", "doc", total.alias("total"), F.explode("lines").alias("x")).select("host", "doc", "total", "x.h", "x.n")
    gone = hit.join(lookup_side(often), ["host", "h"]).groupBy("host", "doc").agg(F.first("total").alias("total"), F.sum("n").alias("n"))
    left = F.col("total") - F.col("n")
    return gone.where((left < min_words) | (left < min_share * F.col("total"))).select("host", "doc")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_percent: float = 2, min_docs: int = 3,
                  min_words: int = 50, max_repeat_percent: int = 50, min_share: float = 0.3) -> DataFrame:
    """docs with the counts of text_counts, base_failed and kept.

    A line is the text between two newlines, normalised to lower case and single spaces. Equal texts of a
    host count once, so copies of one clean text don't condemn it. Lines in more than max_percent of their
    host's different texts, and more than min_docs, are removed; a document left with fewer than min_words
    words or under min_share of them is depleted and not kept. Texts are read twice, for lines and for
    counts, and only hashes of lines are shuffled; the depleted documents come back as a broadcast if
    counted small, else by a shuffle join.

    Null or empty texts have no words, fail the base rule and have no lines. A null host is a host of its
    own. Repeated rows are judged alike. An empty table gives an empty result. Other columns pass through,
    whatever their names; columns named like a result column are replaced.
    """
    lines = text_lines(docs, text, host)
    gone = cut(depleted_texts(lines, frequent_lines(lines, max_percent, min_docs), min_words, min_share))
    by, of, lost = fresh([*docs.columns, *RESULT], "_host", "_doc", "_lost")
    gone = lookup_side(gone.select(F.col("host").alias(by), F.col("doc").alias(of), F.lit(True).alias(lost)))
    out = text_counts(docs.withColumns({by: _host_key(host), of: F.xxhash64(F.col(text))}), text).join(gone, [by, of], "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & F.col(lost).isNull()}).drop(by, of, lost)
