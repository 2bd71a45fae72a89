"""Operator 6: removal of long repeated byte strings, by suffix arrays over shards of repeated surroundings.

Every string of `length` bytes belongs to the first of its smallest K-byte hashes, its anchor, so equal
strings meet under equal anchors. Anchors that occur once are done. Where all surroundings of an anchor are
equal, all strings in them repeat. What is left, surroundings that share an anchor but differ, goes to
shards of bounded size; each sorts its suffixes up to `length` bytes, and neighbours of one rank repeat. An anchor with more surroundings
than fit in a shard takes several, whose sorted strings are then merged by binary search.

Passages of a number of words, which take any number of bytes, meet in the same way by the smallest hash of
their G-word windows; at anchors that occur again, the hashes of all passages are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import bounded_batches, cut, lookup_side, settled
from framelake.llm.words import powers, prefix_hash, small_batches, span_hash, word_hashes, word_spans

#: Bytes of an anchor, and words of a passage's anchor.
K, G = 32, 8
#: Surroundings of one anchor in a shard at most, and bytes of a shard on average.
PER_SHARD, SHARD_BYTES = 2048, 2 << 20
#: Bits of a place within a batch; texts are taken in pieces of at most PIECE string starts.
_PLACE, PIECE = 22, 1 << 20
#: Bits of a word's place within a batch; bits of the map of repeated anchors at most (32 MB), and in one of its chunks.
_WORD, MAP_BITS, _CHUNK = 32, 28, 16


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    n, step = len(values) - width + 1, 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:n], values[width - step:][:n])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, hash of the surrounding bytes) for each run of strings that share an anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = prefix_hash(data)
    at = np.arange(len(data) - K + 1)
    hashes = span_hash(prefix, at, at + K)
    best = hashes >> np.uint64(_PLACE) << np.uint64(_PLACE) | at.astype(np.uint64)
    owner = (_least(best, length - K + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    start = np.flatnonzero(np.arange(n) + length <= begin[1:][text])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    own = owner[start]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
    first, last = start[new], start[np.concatenate([new[1:], [True]])]
    return text[first], first - begin[text[first]], last - begin[text[first]], hashes[own[new]], span_hash(prefix, first, last + length)


def passages(texts: list[str | None], words: int) -> tuple[np.ndarray, ...]:
    """Runs of `words`-word passages that share an anchor: (text, first word, anchor hash, hash of all words of the run, number of passages); then the passages' hashes."""
    hashes, counts = word_hashes(texts, lower=False)
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n, g = len(hashes) - words + 1, min(G, words)
    text = np.repeat(np.arange(len(texts)), counts)[:max(n, 0)]
    start = np.flatnonzero(np.arange(max(n, 0)) + words <= begin[1:][text])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none.view(np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes)))])
    at = np.arange(len(hashes) - g + 1)
    anchor = span_hash(prefix, at, at + g)
    best = anchor >> np.uint64(_WORD) << np.uint64(_WORD) | at.astype(np.uint64)
    own = (_least(best, words - g + 1) & np.uint64((1 << _WORD) - 1)).astype(np.int64)[start]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
    first, last = start[new], start[np.concatenate([new[1:], [True]])]
    return text[first], first - begin[text[first]], anchor[own[new]], span_hash(prefix, first, last + words), last - first + 1, span_hash(prefix, start, start + words)


def suffix_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of data in the order of the first `length` bytes that begin there, and each place's rank, equal for equal bytes.

    Ranks over 8 bytes come from one sort; then ranks over h bytes are refined to 2 h (to `length` at last) by the
    rank of the place h (or less) further on, and only groups of more than one place are sorted again.
    """
    n, h = len(data), min(8, length)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(h):
        key = key << np.uint64(8) | padded[j:j + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.arange(n)
    while h < length:
        alone = head & np.append(head[1:], True)
        slots = slots[~alone[slots]]
        if not len(slots):
            break
        step = min(h, length - h)
        places = order[slots]
        ahead = np.where(places + step < n, rank[np.minimum(places + step, n - 1)] + 1, 0)
        both = rank[places] * (n + 1) + ahead
        again = np.argsort(both, kind="stable")
        both, places = both[again], places[again]
        order[slots] = places
        head[slots[1:]] |= both[1:] != both[:-1]
        rank[places] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        h += step
    return order, rank


def suffix_array(data: np.ndarray, length: int) -> np.ndarray:
    """Places of data in the order of the strings that begin there, compared over `length` bytes."""
    return suffix_ranks(data, length)[0]


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its `length`-byte strings (by start) equal another one in any of the bodies: neighbours in the suffix array of one rank."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    count = np.maximum(sizes - length + 1, 0)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order, rank = suffix_ranks(data, length)
    whole = np.zeros(len(data), bool)
    for b, c in zip(begin.tolist(), count.tolist()):
        whole[b:b + c] = True
    order = order[whole[order]]
    same = rank[order[1:]] == rank[order[:-1]]
    found = np.zeros(len(data), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return [found[b:b + c] for b, c in zip(begin.tolist(), count.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for a, b in small_batches(texts):
                raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts[a:b]]
                pieces = [(i, s) for i, x in enumerate(raw) for s in range(0, max(1, len(x) - length + 1), PIECE)]
                for group in _by_size(pieces, raw):
                    text, first, last, anchor, around = anchors([raw[i][s:s + PIECE + length - 1] for i, s in group], length)
                    owner, shift = np.array([i for i, _ in group]), np.array([s for _, s in group])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(k1[a:b][owner[text]]), pa.array(k2[a:b][owner[text]]), pa.array(first + shift[text]), pa.array(last + shift[text]),
                        pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64))], names=["k1", "k2", "p", "q", "anchor", "around"])
    return run


def _by_size(pieces, raw) -> Iterator[list]:
    held, size = [], 0
    for i, s in pieces:
        n = min(PIECE + 400, len(raw[i]) - s)
        if held and size + n > 3 << 20:
            yield held
            held, size = [], 0
        held.append((i, s))
        size += n
    if held:
        yield held


def _bodies(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for i in range(0, len(spots), 1024):
                    part = spots[i:i + 1024]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x["anchor"] for x in part], pa.int64()), pa.array([x["around"] for x in part], pa.int64()),
                        pa.array([raw[x["p"]:x["q"] + length] for x in part], pa.binary())], names=["anchor", "around", "body"])
    return run


def _shard(length: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(f["body"].tolist(), length)
        rows = [(row.anchor, row.around, a, b) for row, flags in zip(f.itertuples(index=False), found) for a, b in zip(*_runs(flags))]
        return pd.DataFrame(rows, columns=["anchor", "around", "a", "b"]).astype("int64")
    return run


def _string_hashes(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of the bodies in order, and how many each body has."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    count = np.maximum(sizes - length + 1, 0)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    return span_hash(prefix_hash(data), start, start + length), count


def _sorted_strings(length: int):
    """A shard of a crowded anchor: its distinct strings by hash, cut by range into as many runs as the anchor has shards."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        hashes = np.unique(_string_hashes(f["body"].tolist(), length)[0])
        n = int(f["shards"].iloc[0])
        part = ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(n + 1))
        rows = [(f["anchor"].iloc[0], int(f["salt"].iloc[0]), i, hashes[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pd.DataFrame(rows, columns=["anchor", "salt", "part", "run"])
    return run


def _merge_runs(f: pd.DataFrame) -> pd.DataFrame:
    """Sorted runs of an anchor's shards in one range: each string of a run is looked up in all the others by binary search."""
    runs = [np.frombuffer(x, np.uint64) for x in f["run"]]
    every = np.sort(np.concatenate(runs))
    rows = []
    for anchor, salt, mine in zip(f["anchor"], f["salt"], runs):
        more = np.searchsorted(every, mine, side="right") - np.searchsorted(every, mine, side="left") > 1
        if more.any():
            rows.append((anchor, salt, mine[more].tobytes()))
    return pd.DataFrame(rows, columns=["anchor", "salt", "run"])


def _apply_merged(length: int):
    def run(f: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(f) and len(merged):
            known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in merged["run"]]))
            hashes, count = _string_hashes(f["body"].tolist(), length)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            flags = np.split(known[at] == hashes, np.cumsum(count)[:-1])
            rows = [(r.anchor, r.around, a, b) for r, x in zip(f.itertuples(index=False), flags) for a, b in zip(*_runs(x))]
        return pd.DataFrame(rows, columns=["anchor", "around", "a", "b"]).astype("int64")
    return run


def repeated_strings(keyed: DataFrame, length: int, per_shard: int = PER_SHARD) -> DataFrame:
    """(k1, k2, runs array<struct<p, q>>): starts of strings of `length` bytes that also start elsewhere, for texts (k1, k2, _text) that have some."""
    spots = cut(keyed.select("k1", "k2", "_text").mapInArrow(_anchor_rows(length), "k1 long, k2 long, p long, q long, anchor long, around long"))
    classes = spots.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p", "q")).alias("at"))
    crowd = classes.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    classes = cut(classes.join(crowd.where("total > 1"), "anchor"))
    # Surroundings with an equal one elsewhere: all their strings repeat.
    equal = spots.join(classes.where("n > 1").select("anchor", "around"), ["anchor", "around"]).select("k1", "k2", "p", "q")
    # Surroundings that share their anchor with different ones: their bytes are compared.
    unlike = classes.where("kinds > 1")
    places = cut(unlike.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("anchor", "around", F.col("at.p").alias("p"), F.col("at.q").alias("q"))).alias("spots")))
    wanted = cut(places.select("k1", "k2"))
    texts = keyed.select("k1", "k2", "_text").join(lookup_side(wanted), ["k1", "k2"], "left_semi")
    bodies = texts.join(places, ["k1", "k2"]).select("_text", "spots").mapInArrow(_bodies(length), "anchor long, around long, body binary")
    shards = F.ceil(F.col("kinds") / per_shard).cast("int")
    size = unlike.agg(F.coalesce(F.sum(F.col("at.q") - F.col("at.p") + length), F.lit(0))).first()[0]
    buckets = max(64, -(-size // SHARD_BYTES))
    kinds = unlike.select("anchor", "around", shards.alias("shards"), (F.col("n") == 1).alias("single"))
    bodies = cut(bodies.join(kinds, ["anchor", "around"]).dropDuplicates(["anchor", "around"]).withColumns({
        "salt": F.when(F.col("shards") > 1, F.pmod(F.xxhash64("around"), F.col("shards")).cast("int")).otherwise(-1),
        "shard": F.when(F.col("shards") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(buckets)))}))
    kind = "anchor long, around long, a long, b long"
    within = bodies.select("anchor", "around", "body", "shard", "salt").groupBy("shard", "salt").applyInPandas(_shard(length), kind)
    crowded = bodies.where("salt >= 0").select("anchor", "around", "body", "salt", "shards")
    runs = crowded.groupBy("anchor", "salt").applyInPandas(_sorted_strings(length), "anchor long, salt int, part int, run binary")
    merged = runs.groupBy("anchor", "part").applyInPandas(_merge_runs, "anchor long, salt int, run binary")
    merged = merged.select(F.col("anchor").alias("anchor2"), F.col("salt").alias("salt2"), "run")
    across = crowded.groupBy("anchor", "salt").cogroup(merged.groupBy("anchor2", "salt2")).applyInPandas(_apply_merged(length), kind)
    found = within.unionByName(across).join(unlike.where("n = 1").select("anchor", "around", "at"), ["anchor", "around"])
    found = found.select("at.k1", "at.k2", (F.col("at.p") + F.col("a")).alias("p"), (F.col("at.p") + F.col("b")).alias("q"))
    return equal.unionByName(found).groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "q")).alias("runs"))


def _passage_anchors(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in small_batches(texts):
                yield pa.RecordBatch.from_arrays([pa.array(passages(texts[a:b], words)[2].view(np.int64))], names=["anchor"])
    return run


def _map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for places in batch.column(1):
            chunk = np.zeros(1 << _CHUNK, np.uint8)
            chunk[places.values.to_numpy()] = 1
            bits.append(np.packbits(chunk, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["chunk", "bits"])


def _anchor_map(anchors: DataFrame) -> np.ndarray:
    """A bitmap of written anchors, eight bits or more for each up to 2**MAP_BITS; other anchors that fall on set bits pass it too."""
    size = 1 << min(MAP_BITS, max(_CHUNK, (8 * anchors.count()).bit_length()))
    place = F.col("anchor").bitwiseAND(size - 1)
    rows = anchors.groupBy(F.shiftright(place, _CHUNK).cast("int").alias("chunk")).agg(F.collect_set(place.bitwiseAND((1 << _CHUNK) - 1).cast("int")).alias("places"))
    out = np.zeros(size >> 3, np.uint8)
    width = 1 << _CHUNK - 3
    for r in rows.mapInArrow(_map_chunks, "chunk int, bits binary").toLocalIterator():
        out[r.chunk * width:(r.chunk + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _passage_rows(words: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for a, b in small_batches(texts):
                text, first, anchor, around, count, hashes = passages(texts[a:b], words)
                place = (anchor & np.uint64(8 * len(bits) - 1)).astype(np.int64)
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                held = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(count[hit])]), pa.int32()), pa.array(hashes[np.repeat(hit, count)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(k1[a:b][text[hit]]), pa.array(k2[a:b][text[hit]]), pa.array(first[hit], pa.int32()), pa.array(around[hit].view(np.int64)), held],
                    names=["k1", "k2", "first", "around", "hashes"])
    return run


def repeated_passages(keyed: DataFrame, words: int) -> DataFrame:
    """(k1, k2, starts array<int>): first words of passages of `words` words that also start elsewhere, for texts (k1, k2, _text) that have some.

    The texts are read twice: for anchors that occur again, whose bitmap is broadcast, and for the passages at them,
    whose hashes are counted exactly. Runs of passages with equal words are counted as one with its number.
    """
    spark = keyed.sparkSession
    anchors = keyed.select("_text").mapInArrow(_passage_anchors(words), "anchor long")
    again = cut(anchors.groupBy("anchor").count().where("count > 1").select("anchor"))
    known = spark.sparkContext.broadcast(_anchor_map(again))
    spots = cut(keyed.select("k1", "k2", "_text").mapInArrow(_passage_rows(words, known), "k1 long, k2 long, first int, around long, hashes array<long>"))
    kinds = spots.groupBy("around").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes"))
    each = cut(kinds.select("around", "n", F.posexplode("hashes").alias("j", "h")))
    repeated = cut(each.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h"))
    found = each.join(lookup_side(repeated), "h", "left_semi").groupBy("around").agg(F.collect_list("j").alias("js"))
    starts = spots.select("k1", "k2", "first", "around").join(found, "around").select("k1", "k2", F.transform("js", lambda j: j + F.col("first")).alias("js"))
    return starts.groupBy("k1", "k2").agg(F.flatten(F.collect_list("js")).alias("starts"))


def covered(runs: list[dict] | None, length: int, raw: bytes = b"", starts: list[int] | None = None, words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges [start, end) covered by strings that start in the runs, or by passages of `words` words of raw that start at the words `starts`."""
    if not runs and not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = (np.array([r[x] for r in runs or []], np.int64) for x in ("p", "q"))
    q = q + length
    if starts:
        at, (begin, end) = np.unique(np.array(starts, np.int64)), word_spans(np.frombuffer(raw, np.uint8))
        p, q = np.concatenate([p, begin[at]]), np.concatenate([q, end[at + words - 1]])
    order = np.argsort(p, kind="stable")
    p, q = p[order], np.maximum.accumulate(q[order])
    new = np.concatenate([[True], p[1:] > q[:-1]])
    return p[new], q[np.concatenate([new[1:], [True]])]


def keyed_texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.withColumns({"k1": F.xxhash64(F.col(id).cast("string"), F.lit(1)), "k2": F.xxhash64(F.col(text)), "_text": F.col(text)})


def _cut_texts(length: int, words: int | None, carry: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, starts = (batch.column(len(carry) + i).to_pylist() for i in (0, 1, 2))
            rows = []
            for t, r, s in zip(texts, runs, starts):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                start, end = covered(r, length, raw, s, words)
                kept = raw if not len(start) else b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
                rows.append((len(raw), int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), len(start) > 0) if digest else
                            (None if t is None else kept.decode("utf-8", "ignore") if len(start) else t,))
            held = [batch.column(i) for i in range(len(carry))]
            kinds = [*[pa.int64()] * 3, pa.string(), pa.bool_()] if digest else [pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "touched"] if digest else ["_kept"]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds))], names=[*carry, *names])
    return run


def remove_repeats(docs: DataFrame, length: int = 400, id: str = "doc_id", text: str = "text", digest: bool = False, per_shard: int = PER_SHARD, words: int | None = None,
                   counted: int | None = None) -> DataFrame:
    """docs without the bytes of `text` that lie in a string of `length` bytes that also starts elsewhere, in this or another document.

    words: passages of as many words (runs of bytes other than space and \\t to \\r) that also start elsewhere, whatever
    stands between their words and however few bytes they take, are removed too, from their first word to their last.

    counted: with digest, a last column n_passages: how many passages of as many words also start elsewhere. They are only
    counted, and stay where no string of `length` bytes takes them.

    Overlapping occurrences count, every copy is removed, and strings are judged on the input. A character
    that is cut in half is dropped. digest: (id, n_bytes, n_removed, n_spans, kept_sha256, touched) instead, over the
    exact remaining bytes; touched: whether anything is removed. Null and empty texts stay as they are and have nothing to remove. Repeated rows
    are copies of each other like any other documents; ids may be null. Texts shorter than `length` (and `words`) are kept
    whole. An empty table gives an empty result. Other columns pass through (without digest).
    """
    bounded_batches(docs.sparkSession)
    carry = [id] if digest else [c for c in docs.columns if c != text]
    keyed = keyed_texts(docs.select(F.struct(*(F.col(c) for c in carry)).alias("_rest"), F.col(id).alias("_id"), F.col(text).alias("_t")), "_id", "_t")
    some = keyed.where(F.col("_text").isNotNull())
    if digest and counted:
        passages_of = settled(docs.sparkSession, lambda: repeated_passages(some, counted).select("k1", "k2", F.size(F.array_distinct("starts")).alias("n_passages")))
    if words:
        runs = settled(docs.sparkSession, lambda: repeated_strings(some, length, per_shard))
        runs = runs.join(settled(docs.sparkSession, lambda: repeated_passages(some, words)), ["k1", "k2"], "full")
    else:
        runs = repeated_strings(some, length, per_shard).withColumn("starts", F.lit(None).cast("array<int>"))
    # Carried columns travel as c0, c1, ..., whatever their own names are.
    safe = [f"c{i}" for i in range(len(carry))]
    joined = keyed.join(runs, ["k1", "k2"], "left")
    fields = ", ".join(f"{s} {docs.schema[c].dataType.simpleString()}" for c, s in zip(carry, safe))
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, touched boolean" if digest else "_kept string"
    held = [F.col("_rest")[c].alias(s) for c, s in zip(carry, safe)]
    if digest and counted:
        joined, held = joined.join(lookup_side(passages_of), ["k1", "k2"], "left"), [*held, F.coalesce("n_passages", F.lit(0)).cast("long").alias("c1")]
        safe, fields = [*safe, "c1"], f"{fields}, c1 long"
    out = joined.select(*held, "_text", "runs", "starts").mapInArrow(_cut_texts(length, words, safe, digest), ", ".join(x for x in (fields, more) if x))
    if digest:
        columns = [x.split(" ")[0] for x in more.split(", ")]
        return out.select(F.col("c0").alias(id), *columns, *([F.col("c1").alias("n_passages")] if counted else []))
    back = dict(zip(carry, safe))
    return out.select(*((F.col("_kept") if c == text else F.col(back[c])).alias(c) for c in docs.columns))
