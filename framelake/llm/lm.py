"""Operator 4: n-gram language-model scores by deleted interpolation.

Texts are gathered into chunks of bounded size. A chunk asks once for each distinct n-gram that it holds:
the hashes, cut by range into groups, meet those of all other chunks, are counted over the corpus, and
the counts go back to the chunk, in the order of its own sorted hashes. So an n-gram crosses the network
once a chunk, however often or in how many texts it occurs, and no table of counts is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import M1, bounded_batches, cut, mix
from framelake.llm.words import word_hashes

#: Characters of a chunk.
CHUNK_CHARS = 12 << 20
START, END = mix(np.array([101, 102], np.uint64))
#: Steps per factor of ten at which probabilities are grouped for the mixture weights, and context-frequency buckets.
STEPS, BUCKETS = 16, 32
_REPLY = "kind int, group int, chunk long, k1 long, k2 long, every binary, kept binary, n long, v long, n_kept long, v_kept long"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers by significance, all lowest first, so that high zeros compress away."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def ngram_keys(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1- to order-grams that end at each token, and the number of tokens of each text (words and one end)."""
    words, n = word_hashes(texts)
    total = n + 1
    ends = np.cumsum(total)
    flat = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = words
    place = np.arange(len(flat)) - np.repeat(ends - total, total)
    keys = [flat]
    for back in range(1, order):
        before = np.full(len(flat), START, np.uint64)
        before[back:] = np.where(place[back:] >= back, flat[:-back], START)
        keys.append(mix(keys[-1] * M1 + before))
    return keys, total


def _ask(order: int, groups: int):
    shift = np.uint64(64 - groups.bit_length() + 1)

    def chunk(rows: list[tuple]) -> Iterator[dict]:
        k1, k2, train, tune, texts = zip(*rows)
        keys, n = ngram_keys(list(texts), order)
        name = int(mix(np.array(k1).view(np.uint64) ^ mix(np.array(k2).view(np.uint64))).sum() >> np.uint64(1)) & ~1 | bool(tune[0])
        use = [np.repeat(np.array(train) & (np.array(tune) == t), n) for t in (False, True)]
        for a, b in set(zip(k1, k2)):
            yield {"kind": 1, "group": a % groups, "chunk": name, "k1": a, "k2": b}  # only passes through: spread by document
        for o, key in enumerate(keys):
            unique, at = np.unique(key, return_inverse=True)
            kept, tuned = (np.bincount(at[u], minlength=len(unique)).astype(np.uint32) for u in use)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(unique >> shift)) + 1, [len(unique)]]) if groups > 1 else np.array([0, len(unique)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                g = int(unique[a] >> shift) if groups > 1 else 0
                yield {"kind": 0, "group": o * groups + g, "chunk": name, "k1": 0, "k2": 0, "a": _pack_keys(unique[a:b]), "b": _planes(kept[a:b]), "c": _planes(tuned[a:b])}

    kinds = {"kind": pa.int32(), "group": pa.int32(), "chunk": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = list(chunk(rows))
        for i in range(0, len(out), 64):
            part = out[i:i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in part], t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tuning texts have chunks of their own, so that their pass need not read the others.
        held: dict[bool, list[tuple]] = {True: [], False: []}
        size = {True: 0, False: 0}
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns)):
                own = bool(row[3])
                held[own].append(row)
                size[own] += len(row[4] or "")
                if size[own] >= CHUNK_CHARS:
                    yield from batch(held[own])
                    held[own], size[own] = [], 0
        for rows in held.values():
            if rows:
                yield from batch(rows)
    return run


def _count(groups: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        asked, out = f[f["kind"] == 0], []
        for row in f[f["kind"] == 1].itertuples(index=False):
            out.append({"kind": 1, "group": row.group, "chunk": row.chunk, "k1": row.k1, "k2": row.k2})
        if len(asked):
            keys = [_unpack_keys(x) for x in asked["a"]]
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            kept, tuned = (np.bincount(at, np.concatenate([_unplanes(x, np.uint32) for x in asked[c]]), len(unique)).astype(np.int64) for c in "bc")
            every = kept + tuned
            group = int(asked["group"].iloc[0])
            if group < groups:
                out.append({"kind": 2, "group": group, "n": int(every.sum()), "v": int((every > 0).sum()), "n_kept": int(kept.sum()), "v_kept": int((kept > 0).sum())})
            ends = np.cumsum([len(k) for k in keys])
            for name, a, b in zip(asked["chunk"], ends - [len(k) for k in keys], ends):
                i = at[a:b]
                out.append({"kind": 0, "group": group, "chunk": name, "every": _planes(every[i].astype(np.uint32)), "kept": _planes(kept[i].astype(np.uint32))})
        columns = [c.split()[0] for c in _REPLY.split(", ")]
        whole = lambda c: pd.array([None if (x := r.get(c)) is None else int(x) for r in out], dtype="Int64")  # noqa: E731  never through floats
        return pd.DataFrame({c: [r.get(c) for r in out] if c in ("every", "kept") else whole(c) for c in columns})
    return run


def _counts(f: pd.DataFrame, replies: pd.DataFrame, order: int, groups: int, column: str):
    """For the texts of a chunk: tokens of each, and the counts of its 1- to order-grams and of their contexts, by token."""
    texts = f["_text"].tolist()
    keys, n = ngram_keys(texts, order)
    replies = replies.drop_duplicates("group").sort_values("group")
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    count, context = [], []
    for o, key in enumerate(keys):
        _, at = np.unique(key, return_inverse=True)
        mine = replies[(replies["group"] >= o * groups) & (replies["group"] < (o + 1) * groups)]
        values = np.concatenate([_unplanes(x, np.uint32) for x in mine[column]]).astype(np.int64)
        count.append(values[at])
        if o == 0:
            documents = count[0][np.cumsum(n) - 1]
        before = np.empty(len(key), np.int64)
        before[1:] = count[o][:-1]
        before[starts] = documents
        context.append(before)
    return n, count, context


def _estimates(count, context, total: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, probabilities): maximum-likelihood estimates of orders 0 (uniform) to n by token, and the context's frequency bucket.

    The bucket is set by the longest context seen and the binary logarithm of its frequency.
    """
    p = [np.full(len(count[0]), 1.0 / (types + 1)), count[0] / max(total, 1)]
    bucket = np.zeros(len(count[0]), np.int64)
    for o in range(1, len(count)):
        seen = context[o - 1] > 0
        p.append(np.where(seen, count[o] / np.maximum(context[o - 1], 1), 0.0))
        bucket = np.where(seen, (o - 1) * BUCKETS + 1 + np.minimum(np.log2(np.maximum(context[o - 1], 1)).astype(np.int64), BUCKETS - 1), bucket)
    return bucket, np.stack(p)


def mixture(rows: np.ndarray, weight: np.ndarray, orders: int, rounds: int = 60) -> np.ndarray:
    """Weights of the estimates by expectation-maximisation: rows are probabilities (events x orders), weight how often each occurred."""
    share = np.full(orders, 1.0 / orders)
    for _ in range(rounds):
        part = rows * share
        whole = part.sum(1, keepdims=True)
        if not (whole > 0).all():
            keep = whole[:, 0] > 0
            part, whole, rows, weight = part[keep], whole[keep], rows[keep], weight[keep]
        new = (part / whole * weight[:, None]).sum(0)
        if not new.sum():
            break
        new /= new.sum()
        if np.abs(new - share).max() < 1e-7:
            return new
        share = new
    return share


def learn_weights(histogram: pd.DataFrame, order: int) -> np.ndarray:
    """(bucket x order + 1) mixture weights. Events are pooled over buckets for those that the held-out texts don't reach; no event leaves equal weights."""
    out = np.full(((order - 1) * BUCKETS + 1, order + 1), 1.0 / (order + 1))
    if len(histogram):
        columns = [f"p{o}" for o in range(order + 1)]
        p = histogram[columns].to_numpy(np.float64)
        p = np.where(p <= -9999, 0.0, 10.0 ** (p / STEPS))
        n, bucket = histogram["n"].to_numpy(np.float64), histogram["bucket"].to_numpy()
        out[:] = mixture(p, n, order + 1)
        for b in np.unique(bucket):
            out[b] = mixture(p[bucket == b], n[bucket == b], order + 1)
    # Nothing may be impossible: the uniform estimate keeps a little, and orders without a context have none.
    out[:, 0] = np.maximum(out[:, 0], 1e-6)
    for o in range(2, order + 1):
        out[: (o - 2) * BUCKETS + 1, o] = 0.0
    return out / out.sum(1, keepdims=True)


def interpolated_scores(docs: DataFrame, train: Column, tune: Column, order: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are words (A-Z lowered, split at space and \\t to \\r) and one end. train marks the documents that
    are learned from; tune marks those among them that are held out while the mixture weights are learned:
    n-gram estimates from the rest are mixed by weights for each bucket of context frequency, set by
    expectation-maximisation on the tuning documents' tokens, grouped by bucket and by probability in steps
    of 10**(1/16). Scores then use the counts of all training documents. base_score adds one to unigram
    counts. The grouped events (at most a few hundred thousand rows at any corpus size) and the weights
    are all that the driver sees.

    A null or empty text is an end alone. Null marks are false. Repeated rows count each and score alike, ids
    may be null. An empty table gives an empty result; without training documents counts are zero. Other
    columns are not read. Words and n-grams are told apart by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(id).cast("string"), F.lit(1)).alias("_k1"), F.xxhash64(F.col(text)).alias("_k2"),
                       F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(train & tune, F.lit(False)).alias("_tune"), F.col(text).alias("_text"))
    chars = base.agg(F.sum(F.length("_text"))).first()[0] or 0
    groups = 1 << max(4, (chars >> 23).bit_length())
    asked = base.select("_k1", "_k2", "_train", "_tune", "_text").mapInArrow(
        _ask(order, groups), "kind int, group int, chunk long, k1 long, k2 long, a binary, b binary, c binary")
    replies = cut(asked.groupBy("group").applyInPandas(_count(groups), _REPLY))
    stats = replies.where("kind = 2").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_kept", "v_kept"))).first()
    place = replies.where("kind = 1").select("chunk", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    # A pass gets only the counts that it reads.
    answers = lambda counts: replies.where("kind = 0").select(F.col("chunk").alias("_chunk"), "group", counts)
    located = base.drop("_id").join(place, ["_k1", "_k2"])

    # Tuning chunks are told by the lowest bit of their names.
    tuned = located.where("_tune").groupBy("chunk").cogroup(answers("kept").where("_chunk % 2 != 0").groupBy("_chunk"))
    names = ["bucket", *(f"p{o}" for o in range(order + 1)), "n"]
    events = tuned.applyInPandas(_events(order, groups, stats["n_kept"], stats["v_kept"]), ", ".join(f"{c} long" for c in names))
    histogram = events.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(histogram, order)

    scored = located.groupBy("chunk").cogroup(answers("every").groupBy("_chunk")).applyInPandas(
        _score(order, groups, stats["n"], stats["v"], weights), "_k1 long, _k2 long, n_tokens long, n_known long, base_score double, score double")
    scored = scored.dropDuplicates(["_k1", "_k2"])
    return base.select("_id", "_k1", "_k2").join(scored, ["_k1", "_k2"]).select(
        F.col("_id").alias(id), "n_tokens", "n_known", F.lit(stats["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def _events(order: int, groups: int, total: int, types: int):
    """Tuning tokens grouped by bucket and probabilities, on a logarithmic scale; -9999 stands for zero."""
    def run(f: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", *(f"p{o}" for o in range(order + 1))]
        f = f.drop_duplicates(["_k1", "_k2"])
        if not len(f):
            return pd.DataFrame({c: [] for c in [*names, "n"]}).astype("int64")
        _, count, context = _counts(f, replies, order, groups, "kept")
        bucket, p = _estimates(count, context, total, types)
        steps = np.where(p > 0, np.rint(np.log10(np.where(p > 0, p, 1.0)) * STEPS), -9999).astype(np.int64)
        rows, n = np.unique(np.concatenate([bucket[None], steps]).T, axis=0, return_counts=True)
        return pd.DataFrame(rows, columns=names).assign(n=n.astype(np.int64))
    return run


def _score(order: int, groups: int, total: int, types: int, weights: np.ndarray):
    def run(f: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["_k1", "_k2"]).reset_index(drop=True)
        if not len(f):
            return pd.DataFrame({"_k1": [], "_k2": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        n, count, context = _counts(f, replies, order, groups, "every")
        bucket, p = _estimates(count, context, total, types)
        owner = np.repeat(np.arange(len(f)), n)
        per = lambda x: np.bincount(owner, x, len(f))
        chosen = (p * weights[bucket].T).sum(0)
        return pd.DataFrame({"_k1": f["_k1"], "_k2": f["_k2"], "n_tokens": n.astype(np.int64), "n_known": per(count[0] > 0).astype(np.int64),
                             "base_score": per(np.log10((count[0] + 1) / (total + types + 1))), "score": per(np.log10(chosen))})
    return run
