"""Operator 10: documents packed into token sequences along a Hilbert curve through projected document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.bytepairs import encoder, map_texts
from framelake.llm.shared import cut, mix

#: Hashed features, dimensions of the projection and bits of each: 27 bits of Hilbert key.
FEATURES, DIMENSIONS, BITS = 256, 3, 9
#: Tokens of one part of the curve, the work of one task at a time. Beyond so many parts they grow instead, which a task
#: streams and sorts with spilling, so that the sketch that finds the bounds stays at a few MB.
PART_TOKENS, MOST_PARTS = 1 << 20, 20_000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with coordinates below 2**bits.

    From the top bit down, each bit of the coordinates is undone by the turn of the cell it lies in (an
    exchange with the first axis, or its reflection), then the bits are interleaved and Gray-decoded.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def _features(ids: int) -> np.ndarray:
    """The hashed feature of every token id below `ids`."""
    return (mix(np.arange(ids, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int64)


_FEATURE = _features(1 << 16)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by token ids: counts of hashed tokens, by their length, on fixed random directions."""
    signs = mix(np.arange(1, FEATURES * DIMENSIONS + 1, dtype=np.uint64)).astype(np.float64).reshape(FEATURES, DIMENSIONS)
    signs = signs / 2.0**63 - 1.0
    most = max((int(x.max(initial=0)) for x in ids), default=0)
    feature = _FEATURE if most < len(_FEATURE) else _features(most + 1)
    counts = np.stack([np.bincount(feature[x], minlength=FEATURES) for x in ids]) if ids else np.zeros((0, FEATURES))
    vector = np.log1p(counts)
    vector = vector / np.maximum(np.sqrt((vector**2).sum(1)), 1e-12)[:, None]
    point = vector @ signs
    # Unit vectors on directions with components in [-1, 1): nearly all values lie within (-3, 3).
    cell = np.clip(np.floor((point + 3) / 6 * (1 << BITS)), 0, (1 << BITS) - 1)
    return hilbert_keys(cell.astype(np.int64), BITS)


def _encode(path: str, end_id: int):
    def make():
        known = encoder(path)
        end = np.array([end_id], known.kind).tobytes()

        def work(texts: list[str | None]) -> pa.RecordBatch:
            raw = known.encode([t or "" for t in texts])
            keys = curve_keys([np.frombuffer(x, known.kind) for x in raw])
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([len(x) // known.kind.itemsize + 1 for x in raw], pa.int64()),
                pa.array([x + end for x in raw], pa.binary())], names=["_curve", "_n", "_ids"])
        return work
    return make


def _pieces(capacity: int):
    """Cuts documents, which come in order of (_part, _key), at multiples of capacity of the running offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        encoder.cache_clear()  # texts are encoded by now, and an idle worker would hold its words and vocabulary
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, p, base, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, at = p, base
                start, raw = 0, raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                while start < n:
                    length = min(n - start, capacity - at % capacity)
                    crc = zlib.crc32(raw[4 * start:4 * (start + length)])
                    for c, v in zip(out, (doc, start, length, crc, n, at // capacity, at % capacity)):
                        c.append(v)
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:])],
                                             names=["c0", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence of at most `capacity` tokens.

    Each document is encoded (plus end_id) and gets a Hilbert key: token counts hashed to FEATURES, projected
    to DIMENSIONS, placed on the curve. The corpus is range-sorted by that key, ties by a hash of the
    document, and cut every `capacity` tokens, so that a sequence holds neighbours along the curve and only
    the last one can be short. Range bounds are quantiles over all documents of key and hash together, so
    that documents with one key spread over parts. Parts get their first token's place from summed counts.

    A null or empty text is one token, end_id. Ids may be null; repeated rows are packed one by one. An empty
    table gives an empty result. Other columns are not read. sequence_id counts from 0 without gaps.
    """
    encoded = map_texts(docs, text, "_curve long, _n long, _ids binary", _encode(path, end_id), [id])
    tie = F.pmod(F.xxhash64(id, F.crc32("_ids")), F.lit(1 << 34))
    encoded = cut(encoded.withColumn("_key", F.col("_curve") * F.lit(1 << 34) + tie).drop("_curve"))
    keys = encoded.select("_key", "_n")
    total = keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = max(1, min(MOST_PARTS, -(-total // PART_TOKENS)))
    bounds = sorted(set(keys.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] or [])) if parts > 1 else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int64))

    # Else a filter of the join repeats the function, in a second worker beside the first.
    encoded = encoded.withColumn("_part", place.asNondeterministic()("_key"))
    sizes = cut(encoded.groupBy("_part").agg(F.sum("_n").alias("_size")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    rows = encoded.join(F.broadcast(base), "_part").repartition(max(parts, 1), "_part").sortWithinPartitions("_part", "_key", id)
    kind = docs.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("c0"), "_part", "_base", "_n", "_ids").mapInArrow(
        _pieces(capacity), f"c0 {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("c0", id)

