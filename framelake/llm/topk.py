"""Operator 3: exact top-k inner products over norm-bucketed blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import cut

#: Largest sum that float64 products hold exactly.
_EXACT = float(1 << 53)
#: At this local cosine or above, one coordinate's feasible interval is narrow enough to select by.
COORDINATE_COSINE = 0.5
_SLACK = 1e-9
_BLOCK = "block long, dim int, n long, high double, kind string, ids binary, vectors binary"
_ROWS = "array<struct<query_id:long,vec_id:long,score:long>>"


def integer_vectors(vecs: DataFrame, id: str, embedding: str, scale: int, is_query: Column) -> DataFrame:
    """(id, v array<long>, norm, asks): floor(scale * x) of the rows that take part."""
    x = F.col(embedding)
    fine = F.col(id).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    out = vecs.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


def _pack(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}

        def out(key):
            ids, rows, norms = zip(*held.pop(key))
            m = np.stack(rows)
            kind = "i2" if np.abs(m).max(initial=0) < 1 << 15 else "i8"
            ids = np.array(ids, np.int64)
            return pd.DataFrame({"block": [0], "dim": [key[1]], "n": [len(ids)], "high": [float(max(norms))],
                                 "kind": [kind], "ids": [ids.tobytes()], "vectors": [m.astype(kind).tobytes()]})

        for f in frames:
            for i, v, norm, bucket in zip(f["id"], f["v"], f["norm"], f["bucket"]):
                key = (int(bucket), len(v))
                held.setdefault(key, []).append((i, v, norm))
                if len(held[key]) == size:
                    yield out(key)
        for key in list(held):
            yield out(key)
    return run


def blocks(vecs: DataFrame, size: int, parts: int, buckets: int, rows: int) -> DataFrame:
    """Blocks of at most `size` vectors of one length bucket; rows: how many there are.

    Bucket edges are quantiles of the norms of all vectors. A bucket's rows are dealt on by a hash of
    their ids, so that a bucket with many rows, or all of them, fills its blocks in many tasks.
    """
    edges = vecs.agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    bucket = sum(((F.col("norm") >= e).cast("int") for e in sorted(set(edges or []))), F.lit(0))
    dealt = vecs.select("id", "v", "norm", bucket.alias("bucket")).repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, rows // (4 * size)))))
    return cut(dealt.mapInPandas(_pack(size), _BLOCK).withColumn("block", F.xxhash64("ids", "vectors")))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class _Best:
    """The k best candidates of queries against one block."""

    def __init__(self, qi, qv, floor, pi, pv, k):
        self.qi, self.qv, self.floor, self.pi, self.pv, self.k = qi, qv, floor, pi, pv, k
        self.out: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, queries: np.ndarray, cand: np.ndarray) -> None:
        ids = self.pi[cand]
        for q, row in zip(queries.tolist(), _scores(self.qv[queries], self.pv[cand])):
            use = np.flatnonzero((row >= self.floor[q]) & (ids != self.qi[q]))
            if len(use) > self.k:
                kth = np.partition(row[use], len(use) - self.k)[len(use) - self.k]
                use = use[row[use] >= kth]
            use = use[np.lexsort((ids[use], -row[use]))][: self.k]
            self.out[q] = (ids[use], row[use])


def search_block(qi, qv, floor, pi, pv, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each query that can still gain: (ids, scores) of its k best rows of the block with score >= its floor.

    A query's floor over its length and the block's greatest length is its local cosine threshold. Over 1
    the block is passed. From COORDINATE_COSINE on, rows are chosen by the query's largest coordinate: a
    vector within the angle of that cosine has its own coordinate in an interval around the query's. Below,
    the block's rows are cut where their length can't reach the floor.
    """
    pn, qn = np.sqrt((pv.astype(np.float64) ** 2).sum(1)), np.sqrt((qv.astype(np.float64) ** 2).sum(1))
    by_norm = np.argsort(-pn, kind="stable")
    high = float(pn[by_norm[0]])
    has = (floor > 0) & (qn > 0)
    need = np.where(has, floor / np.where(qn > 0, qn, 1.0), 0.0)
    cosine = np.where(has, need / max(high, 1e-300), 0.0)
    best = _Best(qi, qv, floor, pi, pv, k)
    short = np.flatnonzero(cosine < COORDINATE_COSINE)
    for a in range(0, len(short), 128):
        queries = short[a:a + 128]
        n = int(np.searchsorted(-pn[by_norm], -need[queries].min() * (1 - _SLACK), side="right"))
        best.take(queries, by_norm[:n])
    narrow = np.flatnonzero((cosine >= COORDINATE_COSINE) & (cosine <= 1 + _SLACK))
    if len(narrow):
        unit = (pv / np.maximum(pn, 1e-300)[:, None]).T
        order = np.argsort(unit, axis=1, kind="stable")
        ordered = np.take_along_axis(unit, order, axis=1)
        for q in narrow.tolist():
            f = int(np.abs(qv[q]).argmax())
            angle, own = np.arccos(min(1.0, cosine[q])), np.arccos(np.clip(qv[q, f] / qn[q], -1, 1))
            lo, hi = np.cos(min(np.pi, own + angle)) - 1e-7, np.cos(max(0.0, own - angle)) + 1e-7
            a, b = np.searchsorted(ordered[f], lo), np.searchsorted(ordered[f], hi, side="right")
            best.take(np.array([q]), order[f][a:b])
    return best.out


def _open(row) -> tuple[np.ndarray, ...]:
    qi, pi = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
    qv = np.frombuffer(row.q_vectors, row.q_kind).reshape(len(qi), row.dim).astype(np.int64)
    return qi, qv, pi, np.frombuffer(row.vectors, row.kind).reshape(len(pi), row.dim).astype(np.int64)


_NO_FLOOR = np.iinfo(np.int64).min


def _probe(k: int):
    """One row for each query block: floors, the least length that can still matter, and the rows found."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                qi, qv, pi, pv = _open(row)
                found = search_block(qi, qv, np.full(len(qi), _NO_FLOOR), pi, pv, k)
                floor = np.array([found[q][1][-1] if len(found[q][1]) >= k else _NO_FLOOR for q in range(len(qi))], np.int64)
                qn = np.sqrt((qv.astype(np.float64) ** 2).sum(1))
                need = np.where((floor > 0) & (qn > 0), floor / np.where(qn > 0, qn, 1), 0.0).min()
                rows = [{"query_id": int(qi[q]), "vec_id": int(p), "score": int(s)} for q, (ps, ss) in found.items() for p, s in zip(ps, ss)]
                yield pd.DataFrame({"q_block": [row.q_block], "q_floor": [floor.tobytes()], "need": [need], "rows": [rows]})
    return run


def _search(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                qi, qv, pi, pv = _open(row)
                found = search_block(qi, qv, np.frombuffer(row.q_floor, np.int64), pi, pv, k)
                n = [len(p) for p, _ in found.values()]
                if sum(n):
                    yield pd.DataFrame({"query_id": np.repeat(qi[list(found)], n), "vec_id": np.concatenate([p for p, _ in found.values()]),
                                        "score": np.concatenate([s for _, s in found.values()])})
    return run


def top_products(vecs: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", embedding: str = "embedding", scale: int = 64,
                 buckets: int = 16, block: int = 4096, query_block: int = 1024, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to smaller ids.

    Vectors are grouped by length into `buckets`, at every size, and cut into blocks; the queries are cut into
    blocks too. A query block first meets the block with the longest vector, which gives each query a floor,
    its k-th score so far; then every other block whose length can reach the floor of one of its queries, see
    search_block. A task holds two blocks at a time, and a query takes at most k rows from each.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors
    meet only vectors of as many components. Scores beyond 64 bits wrap. Repeated rows each count as candidates,
    but not for a query with their id; repeated query rows ask once, with the least of their vectors. Without queries, or over an empty table, the result is empty.
    Other columns are not read.
    """
    parts = parts or max(16, int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ints = cut(integer_vectors(vecs, id, embedding, scale, is_query))
    rows = ints.count()
    every = blocks(ints, block, parts, buckets, rows)
    queries = ints.where("asks").groupBy("id").agg(F.min(F.struct("v", "norm")).alias("q")).select("id", "q.v", "q.norm")
    asked = blocks(queries, query_block, parts, 1, rows).select(
        F.col("block").alias("q_block"), "dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    data = every.select("block", "kind", "ids", "vectors")
    longest = every.groupBy("dim").agg(F.max_by("block", F.struct("high", "n", "block")).alias("block"))
    probe = asked.join(F.broadcast(longest), "dim").join(data, "block").repartition(parts, "q_block", "block")
    first = cut(probe.mapInPandas(_probe(k), f"q_block long, q_floor binary, need double, rows {_ROWS}"))
    # Pairs of blocks, named only: the query blocks go to each of `parts` shares of the others.
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
    left = asked.select("q_block", "dim").join(first.select("q_block", "need"), "q_block").select("q_block", "dim", "need", salts)
    right = every.join(F.broadcast(longest.select(F.col("block").alias("done"))), F.col("block") == F.col("done"), "left_anti").select(
        "block", "dim", "high", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("salt"))
    pairs = left.join(right, ["dim", "salt"]).where(F.col("high") * (1 + _SLACK) >= F.col("need")).select("q_block", "block")
    full = pairs.join(data, "block").join(asked, "q_block").join(first.select("q_block", "q_floor"), "q_block").repartition(parts, "q_block", "block")
    more = full.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    rows = first.select(F.explode("rows").alias("r")).select("r.*").unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
