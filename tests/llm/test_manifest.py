"""The Merkle manifest against a tree built by hand."""

import hashlib

from pyspark.sql import functions as F

from framelake.llm import manifest
from tests_llm_helpers import frame

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """(root, siblings before and after each leaf, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] // fanout * fanout
            run, j = nodes[first:first + fanout], at[k] - first
            path.append(("".join(run[:j]), "".join(run[j + 1:])))
            at[k] //= fanout
        nodes = [H("".join(nodes[a:a + fanout])) for a in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_hand(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows (doc_id, text, source)."""
    groups = {}
    for i, t, s in rows:
        groups.setdefault(s, []).append((i is not None, i, leaf(i, s, "en", len(t) if t is not None else None, t)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))) for s in names}
    tops = {s: tree([x[2] for x in v], fanout) for s, v in trees.items()}
    root, upper = tree([tops[s][0] for s in names], fanout)
    return sorted((str(x[1]), x[2], tops[s][0], root, str(p + upper[k])) for k, s in enumerate(names) for x, p in zip(trees[s], tops[s][1]))


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(x.before, x.after) for x in r.proof])) for r in df.collect())


def test_every_leaf_and_proof(docs, rows):
    assert found(manifest.merkle_manifest(docs, COLUMNS)) == by_hand(rows, 16)


def test_more_levels_lone_leaves_and_many_groups(spark):
    rows = [(i, f"text {i}", "big") for i in range(70)] + [(100 + i, None if i % 3 else "", f"host{i:02}") for i in range(9)] + [(200, "x", None), (201, "y", "")]
    assert found(manifest.merkle_manifest(frame(spark, rows).repartition(5), COLUMNS, fanout=3)) == by_hand(rows, 3)


def test_tampering_shows(spark, rows):
    some = [r for r in rows if r[0] is not None][:40]
    changed = F.when(F.col("doc_id") % 2 == 0, manifest.leaf(*map(F.col, COLUMNS[:4]), F.concat("text", F.lit("!"))))
    out = manifest.merkle_manifest(frame(spark, some), COLUMNS, carry={"changed": changed})
    got = out.select("doc_id", (manifest.folded(F.coalesce("changed", "leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert all(r.ok == (r.doc_id % 2 == 1) for r in got.collect())


def test_null_and_empty_differ_and_one_row_is_its_own_root(spark, none):
    assert manifest.merkle_manifest(none, COLUMNS).count() == 0
    (one,) = manifest.merkle_manifest(frame(spark, [(1, None, None)]), COLUMNS).collect()
    assert one.leaf == one.subroot == one.root == H("1:1-2:en--") and one.proof == []
    (other,) = manifest.merkle_manifest(frame(spark, [(1, "", None)]), COLUMNS).collect()
    assert other.leaf == H("1:1-2:en1:00:")
