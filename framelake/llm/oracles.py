"""DuckDB versions of the registered queries that SQL can express."""

from __future__ import annotations

SPLIT = r"regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+')"
WORDS = f"list_filter({SPLIT}, lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), k AS (SELECT doc_id, hash(g) AS g FROM s),
 link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM k x JOIN k y ON y.g = x.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n p1 ON p1.doc_id = a JOIN n p2 ON p2.doc_id = b WHERE 100 * c >= 80 * (p1.n + p2.n - c)),
 both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
 low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
 FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64e0 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
 SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM
  (SELECT q.vec_id AS query_id, p.vec_id AS vec_id, list_inner_product(q.e, p.e)::BIGINT AS score FROM v q JOIN v p ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE q.vec_id % 20 = 0)) WHERE rank <= 20"""

OP5 = rf"""WITH w AS (SELECT doc_id, source, text, {WORDS} AS w FROM documents),
 p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM w WHERE len(w) > 2),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, range(3) t(d) GROUP BY doc_id),
 l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
 lw AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS lw FROM l),
 held AS (SELECT doc_id, source, text, line, len(lw) AS words, lower(array_to_string(lw, ' ')) AS norm FROM lw WHERE len(lw) > 0),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM held GROUP BY doc_id),
 host AS (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source),
 often AS (SELECT source, norm FROM held JOIN host USING (source) GROUP BY source, norm HAVING count(DISTINCT text) > 3 AND 100 * count(DISTINCT text) > 2 * any_value(host.n)),
 gone AS (SELECT doc_id, sum(words) AS n FROM held JOIN often USING (source, norm) GROUP BY doc_id),
 c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS g
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (g > 0 AND (n_words - g < 50 OR n_words - g < 0.3e0 * n_words)) AS kept FROM f"""

#: The same with a line frequent in two texts and 1 % of a host's, and 98 % of a document to be left.
STRICT = "SELECT doc_id, n_words, base_failed, kept FROM (" + OP5.replace("count(DISTINCT text) > 3", "count(DISTINCT text) > 1").replace("> 2 * any_value", "> 1 * any_value").replace("0.3e0", "0.98e0") + ")"

_gram = lambda n: f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS p, {n} AS k, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w) GROUP BY ALL"
_part = lambda a, b: f"array_to_string(string_split(c.p, ' ')[{a}:{b}], ' ')"
OP11 = rf"""WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM x),
 g AS ({" UNION ALL ".join(_gram(n) for n in (1, 2, 3, 4))}), t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
 c AS (SELECT lang, p, k, f AS a FROM g WHERE k > 1 AND f >= 30),
 s AS (SELECT c.lang, c.p, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g x ON x.lang = c.lang AND x.p = {_part('1', 'j')} JOIN g y ON y.lang = c.lang AND y.p = {_part('j + 1', 'c.k')}),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
 u AS (SELECT lang, q, max(a) AS most FROM (SELECT lang, a, {_part('i', 'i + m - 1')} AS q FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) c) GROUP BY lang, q)
 SELECT lang, rank, p AS phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, p) AS rank FROM b LEFT JOIN u ON u.lang = b.lang AND u.q = b.p
  WHERE most IS NULL OR 100 * most < 80 * a) JOIN t USING (lang) WHERE rank <= 2000"""

_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_leaf = lambda text: "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
_crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: 0::BIGINT)), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


def _tree(name: str, first: str, levels: int = 6) -> str:
    """Tables name0 to name<levels> (g, n, i, node) above `first`, x<name>k with what stands before (b) and after (a) a node in its run, and name_top (g, node)."""
    side = lambda rows: f"coalesce(string_agg(node, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {rows}), '')"
    out = [f"{name}0 AS ({first})"]
    out += [f"{name}{k + 1} AS (SELECT g, (any_value(n) + 15) // 16 AS n, i // 16 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16)" for k in range(levels)]
    out += [f"x{name}{k} AS (SELECT g, i, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}{k} WHERE n > 1)" for k in range(levels)]
    return ", ".join([*out, f"{name}_top AS (" + " UNION ALL ".join(f"SELECT g, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")"])


def _climb(rows: str, name: str, g: str, i: str, out: str, levels: int = 6) -> str:
    """Tables that take rows with acc and sib up a tree: acc becomes the digest of its run, sib gets the siblings behind it."""
    step = lambda k: (f"{out}{k} AS (SELECT p.* REPLACE (CASE WHEN x.g IS NULL THEN acc ELSE sha256(x.b || acc || x.a) END AS acc, sib || coalesce(x.b || x.a, '') AS sib) "  # noqa: E731
                      f"FROM {out + str(k - 1) if k else rows} p LEFT JOIN x{name}{k} x ON x.g = p.{g} AND x.i = p.{i} // {16 ** k})")
    return ", ".join(map(step, range(levels)))


OP13 = (f"WITH r AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_leaf('text')} AS node, CASE WHEN {_crc} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS t FROM documents), "
        "l AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM r), "
        f"{_tree('a', 'SELECT g, n, i, node FROM l')}, s AS (SELECT 'r' AS r, g AS s, node, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS j FROM a_top), "
        f"{_tree('b', 'SELECT r AS g, n, j AS i, node FROM s')}, "
        "p AS (SELECT l.doc_id, l.g, l.i, l.node AS leaf, s.r, s.j, s.node AS subroot, coalesce(l.t, l.node) AS acc, '' AS sib FROM l JOIN s ON s.s = l.g), "
        f"{_climb('p', 'a', 'g', 'i', 'u')}, {_climb('u5', 'b', 'r', 'j', 'v')} "
        "SELECT doc_id, leaf, subroot, b_top.node AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = b_top.node AS verified FROM v5 CROSS JOIN b_top")

ORACLES = {"line_frequency_strict": STRICT, "op1_superminhash": OP1, "op3_norm_buckets": OP3, "op5_line_frequency": OP5, "op11_bucket_phrases": OP11, "op13_merkle_manifest": OP13}
