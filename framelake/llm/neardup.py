"""Operator 1: near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm import words as W
from framelake.llm.shared import M1, M3, bounded_batches, cut, lookup_side, mix, wrap

#: Four ranks a band, 32 bands: two sets at a similarity of 0.8 share no band once in about 20 million pairs.
SLOTS, ROWS = 128, 4
#: Bits of the parity sketch of a set: each shingle turns one over, so that two sketches differ in no more bits than the sets in shingles.
PARITY_BITS = 1024


def superminhash(values: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of sets given one after another; rows of empty sets are all ones.

    Every element walks its own random permutation of the slots; at step j it offers the rank j + r to
    the slot that step picks, so an element's ranks over the slots differ. All elements of all sets take
    a step together, and a set stops once every slot holds a rank of the steps done.
    """
    n = len(counts)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * slots, full, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    seed, perm = mix(values ^ M1), None
    for j in range(slots):
        if not len(owner):
            break
        r = mix(seed + wrap((j + 1) * int(M3)))
        k = (j + (r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) // np.uint64(1 << 32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(owner), 1))
                perm[np.arange(len(owner)), first], perm[:, 0] = 0, first
            at = np.arange(len(owner))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        first = k
        rank = (np.uint64(j) << np.uint64(52)) | (mix(r) >> np.uint64(12))
        np.minimum.at(sig, owner * slots + slot, rank)
        open_ = sig.reshape(n, slots).max(axis=1) >= (np.uint64(j + 1) << np.uint64(52))
        stay = open_[owner]
        if not stay.all():
            owner, seed, first = owner[stay], seed[stay], first[stay]
            perm = None if perm is None else perm[stay]
    return sig.reshape(n, slots)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of `rows` slots; keys of different bands differ."""
    n, slots = sig.shape
    out = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64) * M3, (n, slots // rows)).copy()
    for i in range(rows):
        out = mix(out * M1 + sig[:, i::rows][:, : slots // rows])
    return out


def parity_sketch(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PARITY_BITS of each set as 64-bit words: bit i tells whether an odd number of its values fall on i."""
    n = len(counts)
    at = np.repeat(np.arange(n), counts) * PARITY_BITS + (values >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, PARITY_BITS), axis=1).view(np.uint64).reshape(n, PARITY_BITS // 64)


def _longs(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    flat = pa.array(x.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)


_SIGNED = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_set", T.LongType()),
                        T.StructField("_set2", T.LongType()), T.StructField("_bits", T.ArrayType(T.LongType())), T.StructField("_bands", T.ArrayType(T.LongType()))])


def _sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    return W.distinct(*W.shingles(*W.word_hashes(texts), k))


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in W.small_batches(texts):
                values, n = _sets(texts[a:b], k)
                sig = superminhash(values, n)
                ends = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(W.fold(values, s))]) for s in (1, 2)]
                key = [mix(s[ends[1:]] - s[ends[:-1]] + n.astype(np.uint64)) for s in sums]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n), *(pa.array(x.view(np.int64)) for x in key),
                    _longs(parity_sketch(values, n)), _longs(bands(sig))], names=_SIGNED.names)
    return run


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in W.small_batches(texts):
                values, n = _sets(texts[a:b], k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["_row", "_shingles"])
    return run


def components(nodes_edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): smallest node reachable over edges (a, b), for every node with an edge.

    Union-find over the cluster by alternating stars: each node's larger neighbours are linked to its
    smallest neighbour, then each node and its smaller neighbours likewise, until nothing changes. A round
    never adds edges, and paths halve.
    """
    edges = cut(nodes_edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        same = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = same(after) == same(edges)
        edges = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _alike(percent: int):
    """Whether sizes (_n, _n1) and parity sketches (_bits, _bits1) allow the similarity; pairs that have it always pass."""
    diff = sum((F.bit_count(F.get("_bits", i).bitwiseXOR(F.get("_bits1", i))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return (F.least("_n", "_n1") * 100 >= F.greatest("_n", "_n1") * percent) & (diff * (100 + percent) <= (F.col("_n") + F.col("_n1")) * (100 - percent))


def named(d: DataFrame, roots: DataFrame, name: str, to: str) -> DataFrame:
    """d with column `to`: the root of column `name` by roots (node, root), itself where it has none."""
    return d.join(roots.select(F.col("node").alias(name), F.col("root").alias("_r")), name, "left").withColumn(to, F.coalesce("_r", name)).drop("_r")


def near_groups(signed: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(_row, root) of every set: the smallest set that links at `percent` similarity connect it with.

    signed: one row for each distinct set. A set's weight is the size of all its band buckets together, so the
    set that most of a group resembles weighs most. Each bucket is compared with its heaviest member, its
    centre: every set first with the heaviest of its centres, then with the others. That is linear in a
    group of any size. What else can link two sets of a bucket has a stray in it, a set outside the group
    of the bucket's centre:

    - A stray and the heaviest set of that group, where that isn't the centre. They are compared.
    - A stray and another set of the group, or another stray. They meet by differences from the heaviest set,
      see `shared_differences`.

    Pairs that are connected already, whose sizes or sketches differ too much, are passed over.
    """
    rows = signed.select("_row", F.explode("_bands").alias("_key"))
    shared = rows.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1")
    held = cut(rows.join(shared, "_key"))
    weight = cut(held.groupBy("_row").agg(F.sum("_c").alias("_w")))
    sketch = cut(signed.select("_row", "_n", "_bits").join(lookup_side(weight), "_row", "left_semi"))
    sets = texts.join(lookup_side(weight), "_row", "left_semi").mapInArrow(_shingle_sets(k), "_row long, _shingles array<long>")
    sets = cut(sets.dropDuplicates(["_row"]))
    other = sketch.select(F.col("_row").alias("b"), F.col("_n").alias("_n1"), F.col("_bits").alias("_bits1"))

    def linked(pairs: DataFrame) -> DataFrame:
        alike = pairs.join(sketch.withColumnRenamed("_row", "a"), "a").join(other, "b").where(_alike(percent)).select("a", "b")
        return compared(alike, sets, percent).where("linked").select("a", "b")

    heaviest = lambda d, by: d.groupBy(by).agg(F.max(F.struct("_w", "_row")).alias("_x")).select(by, F.col("_x._row").alias("_top"), F.col("_x._w").alias("_top_w"))
    stars = cut(held.join(heaviest(held.join(weight, "_row"), "_key"), "_key").where("_row != _top").groupBy(F.col("_row").alias("a"), F.col("_top").alias("b")).agg(F.max("_top_w").alias("_w")))
    first = cut(stars.groupBy("a").agg(F.max(F.struct("_w", "b")).alias("_x")).select("a", F.col("_x.b").alias("b")))
    lead = cut(linked(first))
    small = lookup_side(lead.select(F.col("a").alias("node"), F.col("b").alias("root")))
    rest = named(named(stars.join(first, ["a", "b"], "left_anti").select("a", "b"), small, "a", "_ra"), small, "b", "_rb").where("_ra != _rb").select("a", "b")
    root = cut(components(lead.unionByName(linked(rest))))
    small = lookup_side(root)

    top = heaviest(root.join(weight.withColumnRenamed("_row", "node"), "node").withColumnRenamed("node", "_row"), "root").drop("_top_w")
    apart = named(named(stars.select("a", "b"), small, "a", "_ra"), small, "b", "_rb").where("_ra != _rb").select("a", "_ra", F.col("_rb").alias("root")).distinct()
    strays = cut(apart.join(top, "root", "left").select("a", "_ra", "root", F.coalesce("_top", "root").alias("b")))
    close = cut(linked(strays.select("a", "b").distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")))
    strays = cut(strays.join(close.withColumn("_close", F.lit(True)), ["a", "b"], "left").withColumn("stray", F.col("_close").isNull()))
    open_ = strays.where("stray").select("root", "b").distinct()
    crowd = root.withColumnRenamed("node", "a").join(open_, "root").where("a != b").select("a", "b", F.col("root").alias("_ra"), F.lit(False).alias("stray"))
    party = strays.join(open_, ["root", "b"], "left_semi").select("a", "b", "_ra", "stray").unionByName(crowd)
    apart = cut(differences(party, sets, percent))
    core = apart.groupBy("b").agg(F.min(F.struct("_far", "a")).alias("_x")).select("b", F.col("_x.a").alias("_core"))
    around = apart.where("stray").select("a", "b").join(core, "b").where("a != _core")
    certain = cut(linked(around.select("a", F.col("_core").alias("b")).distinct()))
    calm = around.join(certain.withColumnRenamed("b", "_core"), ["a", "_core"]).select("a", "b", F.lit(True).alias("_calm"))
    apart = apart.join(calm, ["a", "b"], "left").withColumn("stray", F.col("stray") & F.col("_calm").isNull()).drop("_calm")
    more = linked(shared_differences(apart, sketch, percent))
    joined = named(named(close.unionByName(certain).unionByName(more), small, "a", "_ra"), small, "b", "_rb").select(F.col("_ra").alias("a"), F.col("_rb").alias("b"))
    return named(named(signed.select("_row"), small, "_row", "_own"), components(joined), "_own", "root").select("_row", "root")


def shared_differences(apart: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(a, b): strays and other sets of the same b, in other groups, that may link; apart: see `differences`.

    Two sets differ from each other in just those of their differences from a third that they don't share,
    and linked ones in at most (100 - percent) / percent of the stray's size. So they share all but so many of
    the stray's differences, and all but (100 - percent) / 100 of its size of the shingles that the third
    lacks. A stray, which isn't linked with the core, shares a difference with every set that it is linked
    with, and meets it by its rarest ones, one more than may be missing; those that it has alone meet nobody.
    """
    lack, spare = F.floor(F.col("_na") * (100 - percent) / 100), F.floor(F.col("_na") * (100 - percent) / percent)
    by_own = F.col("_d_own") > lack
    missing = F.when(by_own, lack).otherwise(F.least(spare, F.col("_d") - 1))
    each = cut(apart.select("a", "b", "_ra", "stray", "_d", "_d_own", spare.alias("_spare"), missing.alias("_missing"), by_own.alias("_by_own"), F.size("_in").alias("_mine"), F.posexplode(F.concat("_in", "_out")).alias("_at", "_e"))
               .withColumn("_own", F.col("_at") < F.col("_mine")).drop("_at", "_mine"))
    often = each.groupBy("b", "_e").agg(F.count("*").alias("_often"))
    by_rarity = Window.partitionBy("b", "a").orderBy("_often", "_e")
    few = each.where(F.col("stray") & (F.col("_own") | ~F.col("_by_own"))).join(often, ["b", "_e"])
    few = cut(few.withColumn("_rank", F.row_number().over(by_rarity)).where((F.col("_rank") <= F.col("_missing") + 1) & (F.col("_often") > 1)).select("a", "b", "_ra", "_d", "_d_own", "_spare", "_e"))
    theirs = each.join(few.select("b", "_e").distinct(), ["b", "_e"], "left_semi").select("b", "_e", F.col("a").alias("_first"), F.col("_ra").alias("_ra1"), F.col("_d").alias("_d1"), F.col("_d_own").alias("_d_own1"))
    mine = few.join(sketch.withColumnRenamed("_row", "a"), "a").withColumnRenamed("a", "_row")
    theirs = theirs.join(sketch.select(F.col("_row").alias("_first"), F.col("_n").alias("_n1"), F.col("_bits").alias("_bits1")), "_first")
    gap = F.abs(F.col("_d_own") - F.col("_d_own1")) + F.abs(F.col("_d") - F.col("_d_own") - F.col("_d1") + F.col("_d_own1"))
    met = mine.alias("s").join(theirs.alias("m"), (F.col("s.b") == F.col("m.b")) & (F.col("s._e") == F.col("m._e")) & (F.col("_ra") != F.col("_ra1")) & (gap <= F.col("_spare")) & _alike(percent))
    return met.select(F.greatest("_row", "_first").alias("a"), F.least("_row", "_first").alias("b")).distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both whole shingle sets, _x and _y."""
    return (pairs.join(sets.select(F.col("_row").alias("a"), F.col("_shingles").alias("_x")), "a")
            .join(sets.select(F.col("_row").alias("b"), F.col("_shingles").alias("_y")), "b"))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): whether the whole sets have 100 * shared >= percent * united."""
    both = _with_sets(pairs, sets).withColumn("_shared", F.size(F.array_intersect("_x", "_y")))
    united = F.size("_x") + F.size("_y") - F.col("_shared")
    return both.select("a", "b", (F.col("_shared") * 100 >= united * percent).alias("linked"))


def differences(party: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """party (a, b, ...) with a's differences from what most sets of the same b hold.

    _in and _out: arrays of the shingles that only a has, or lacks; _d and _d_own: how many there are in both and
    in _in; _na: a's size. Sets are laid beside b's, and a difference that more than half of three or more
    of them have is turned over, so that no difference is common. _far: least for the core, the set that is linked with every set that needs to
    share no difference with some other in order to be linked with it.
    """
    both = cut(_with_sets(party, sets).select(*party.columns, F.size("_x").alias("_na"), F.array_except("_x", "_y").alias("_in"), F.array_except("_y", "_x").alias("_out")))
    of = both.groupBy("b").agg(F.count("*").alias("_of")).where("_of > 2")
    each = both.select("b", F.explode("_in").alias("_e"), F.lit(True).alias("_own")).unionByName(both.select("b", F.explode("_out").alias("_e"), F.lit(False).alias("_own")))
    most = each.groupBy("b", "_e", "_own").agg(F.count("*").alias("_often")).join(of, "b").where("_often * 2 > _of")
    # At most twice the mean number of differences each.
    listed = lambda own: F.collect_list(F.when(F.col("_own") == own, F.col("_e")))
    most = lookup_side(cut(most.groupBy("b").agg(listed(True).alias("_most_in"), listed(False).alias("_most_out"))), 2000)
    none = F.array().cast("array<long>")
    out = both.join(most, "b", "left").withColumns({c: F.coalesce(c, none) for c in ("_most_in", "_most_out")})
    out = out.withColumns({"_in": F.concat(F.array_except("_in", "_most_in"), F.array_except("_most_out", "_out")),
                           "_out": F.concat(F.array_except("_out", "_most_out"), F.array_except("_most_in", "_in"))}).drop("_most_in", "_most_out")
    out = out.withColumns({"_d": F.size("_in") + F.size("_out"), "_d_own": F.size("_in")})
    return out.withColumn("_far", (100 + percent) * F.col("_d") - (100 - percent) * F.col("_na"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (smallest id reachable) and kept.

    Texts are lower-cased (A-Z) and split at space and \\t to \\r; a set holds the distinct k-word windows,
    or the whole sequence of a shorter text. Documents are linked at 100 * shared >= percent * united.
    Equal sets become one class first, so a group of copies of any size is one row from then on; bands,
    links and components are over classes. Ids are integers, and one id names one text; repeated rows of a
    document each get its result.

    Null and empty texts have no shingles and are linked with nothing. A document with a null id takes the
    component of an equal set that has an id, or null, links nothing and is kept. An empty table gives an
    empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    signed = cut(base.select(F.col("_id").alias("_row"), "_text").mapInArrow(_sign(k), _SIGNED))
    whole = signed.where("_row is not null and _n > 0")
    classes = cut(whole.groupBy("_set", "_set2", "_n").agg(F.min("_row").alias("_row"), F.first("_bits").alias("_bits"), F.first("_bands").alias("_bands")))
    texts = base.where("_id is not null").select(F.col("_id").alias("_row"), "_text")
    root = near_groups(classes, texts, percent, k)
    named_ = classes.select("_set", "_set2", "_n", "_row").join(root, "_row").select("_set", "_set2", "_n", F.col("root").alias("_root"))
    out = signed.select("_row", "_n", "_set", "_set2").join(named_, ["_set", "_set2", "_n"], "left")
    component = F.when(F.col("_n") > 0, F.col("_root")).otherwise(F.col("_row"))
    return out.select(F.col("_row").alias(id), F.col("_n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
