"""Operator 11: collocations by hashed bucket counts, Apriori pruning and exact counting, one pass over the texts a phrase length."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import M1, bounded_batches, cut, lookup_side, mix, wrap
from framelake.llm.words import join_bytes, prefix_hash, small_batches, span_hash

#: Bytes that end a piece; a word ends there and at space and tab.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Buckets of one row of bucket counts.
CHUNK = 1 << 16
#: Distinct phrases that a task holds about before it passes their counts on.
HELD = 400_000
SALTS = 16
#: Rows of three eight-byte numbers that may be broadcast: 24 MB.
BROADCAST_KEYS = 1_000_000
#: Rows of one key that a shuffle join takes together.
HOT = 10_000


class Words:
    """The words of some texts: places in `data`, hashes, the piece each stands in, and the text."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        data, begin = join_bytes(texts)
        self.data = _LOWER[data]
        inside = np.concatenate([[False], ~_GAP[self.data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)
        self.piece = np.cumsum(_BREAK[self.data])[self.start] if len(self.start) else self.start
        self.text = np.searchsorted(begin, self.start, side="right") - 1
        known = {x: wrap(int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")) for x in set(langs)}
        self.langs = langs
        seeds = np.array([known[x] for x in langs], np.uint64)
        self.seeded = mix(self.hash ^ seeds[self.text]) if len(self.start) else self.hash

    def grams(self, n: int) -> np.ndarray:
        """First words of all phrases of n words within a piece."""
        m = max(len(self.start) - n + 1, 0)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1:n - 1 + m])

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the phrases of n words that begin at the words `at`, with their language."""
        h = self.seeded[at]
        for k in range(1, n):
            h = mix(h * M1 + self.hash[at + k])
        return h

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.start[j]:self.end[j]].tobytes() for j in range(at, at + n)).decode("utf-8", "surrogatepass")


class Buckets:
    """Counts by hash bucket that stop at `least`; only buckets that were hit take memory."""

    def __init__(self, size: int, least: int):
        self.size, self.least = size, least
        self.fresh, self.waiting = [], 0
        self.at, self.count = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def add(self, h: np.ndarray) -> None:
        self.fresh.append((h & np.uint64(self.size - 1)).astype(np.uint32))
        self.waiting += len(h)
        if self.waiting > 1 << 21:
            self._settle()

    def _settle(self) -> None:
        u, c = np.unique(np.concatenate([np.empty(0, np.uint32), *self.fresh]), return_counts=True)
        both, place = np.unique(np.concatenate([self.at, u]), return_inverse=True)
        total = np.bincount(place, np.concatenate([self.count, c]), len(both))
        self.at, self.count = both, np.minimum(total, self.least).astype(np.uint8)
        self.fresh, self.waiting = [], 0

    def rows(self) -> list[tuple[int, bytes | None, bytes]]:
        """(chunk, places, counts) of chunks with a count: places as two-byte numbers, or none if that were longer than all counts."""
        self._settle()
        width, out = min(CHUNK, self.size), []
        chunk = (self.at // width).astype(np.int64)
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        for at, count in zip(np.split(self.at, cuts), np.split(self.count, cuts)):
            if 3 * len(at) > width:
                whole = np.zeros(width, np.uint8)
                whole[at % width] = count
                out.append((int(at[0]) // width, None, whole.tobytes()))
            elif len(at):
                out.append((int(at[0]) // width, (at % width).astype("<u2").tobytes(), count.tobytes()))
        return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


def _bitmap(rows: DataFrame, size: int, least: int) -> np.ndarray:
    """Which buckets reach `least` over all rows (chunk, places, counts), as size / 8 bytes: added up as they stream through tasks by chunk."""
    width = min(CHUNK, size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for chunk, places, counts in zip(f.chunk, f.places, f.counts):
                part = total.setdefault(int(chunk), np.zeros(width, np.uint8))
                at = slice(None) if places is None else np.frombuffer(places, "<u2")
                part[at] = np.minimum(part[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), least).astype(np.uint8)
        for chunk, part in total.items():
            yield pd.DataFrame({"chunk": [chunk], "bits": [np.packbits(part >= least, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for r in rows.repartition("chunk").mapInPandas(run, "chunk int, bits binary").collect():
        out[r.chunk * width // 8:(r.chunk + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _frequent_bits(frequent: DataFrame, n: int, size: int) -> np.ndarray:
    """The buckets of frequent phrases of n words."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Buckets(size, 1)
        for f in frames:
            w = Words(f.phrase.tolist(), f.lang.tolist())
            seen.add(w.hashes(w.grams(n), n))
        if rows := seen.rows():
            yield pd.DataFrame(rows, columns=["chunk", "places", "counts"], dtype=object)
    return _bitmap(frequent.select("lang", "phrase").mapInPandas(run, "chunk int, places binary, counts binary"), size, 1)


class Counts:
    """Phrases of a task with their counts, told apart by 64-bit hashes; a phrase is read out of the text once."""

    def __init__(self):
        self.slots: dict[int, int] = {}
        self.names: list[tuple[str, str]] = []
        self.counts: list[int] = []

    def add(self, w: Words, at: np.ndarray, h: np.ndarray, n: int) -> None:
        u, first, times = np.unique(h, return_index=True, return_counts=True)
        for x, j, c in zip(u.tolist(), at[first].tolist(), times.tolist()):
            slot = self.slots.get(x)
            if slot is None:
                self.slots[x] = len(self.names)
                self.names.append((w.langs[w.text[j]], w.phrase(j, n)))
                self.counts.append(c)
            else:
                self.counts[slot] += c

    def taken(self) -> list[tuple[str, int, bytes, bytes]]:
        """(lang, part, phrases, counts) of all of them, a part for each value of a byte of their checksum; the counts begin anew."""
        parts: dict[tuple[str, int], list[tuple[bytes, int]]] = defaultdict(list)
        for (lang, phrase), c in zip(self.names, self.counts):
            raw = phrase.encode("utf-8", "surrogatepass")
            parts[lang, zlib.crc32(raw) & 255].append((raw, c))
        self.__init__()
        # Words never hold a line end, so it can stand between phrases.
        return [(lang, part, b"\n".join(p for p, _ in rows), np.array([c for _, c in rows], "<i8").tobytes()) for (lang, part), rows in parts.items() if rows.sort() is None]


def _merged(rows: DataFrame) -> DataFrame:
    """(lang, phrase, f): packed counts (lang, part, phrases, counts) added up as they stream by; what a task can't hold is passed on and added up once more."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], int] = defaultdict(int)
        for f in frames:
            for lang, phrases, counts in zip(f.lang, f.phrases, f.counts):
                for p, c in zip(bytes(phrases).decode("utf-8", "surrogatepass").split("\n"), np.frombuffer(counts, "<i8").tolist()):
                    total[lang, p] += c
                if len(total) > HELD:
                    yield pd.DataFrame([(*k, c) for k, c in total.items()], columns=["lang", "phrase", "c"])
                    total.clear()
        if total:
            yield pd.DataFrame([(*k, c) for k, c in total.items()], columns=["lang", "phrase", "c"])
    spread = rows.select("lang", "part", "phrases", "counts").repartition("lang", "part")
    return spread.mapInPandas(run, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def _count_pass(docs: DataFrame, n: int, longest: int, size: int, least: int, buckets, shorter) -> DataFrame:
    """One pass: packed counts (lang, part, phrases, counts) of phrases of n words that may be frequent, and bucket counts (chunk, places, counts) of phrases of n + 1.

    A phrase may be frequent if its bucket is, and both phrases of n - 1 words in it are. Only phrases whose
    two parts may be frequent are counted in the next length's buckets. The first pass, with n = 0, counts all words of
    a language, as its part -1, and the words' buckets.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, words = Counts(), defaultdict(int)
        ahead = Buckets(size, least) if n < longest else None
        for f in frames:
            texts, langs = f.text.tolist(), f.lang.tolist()
            for a, b in small_batches(texts):
                w = Words(texts[a:b], langs[a:b])
                if n == 0:
                    for i, c in zip(*np.unique(w.text, return_counts=True)):
                        words[w.langs[i]] += int(c)
                    ahead.add(w.seeded)
                    continue
                at = w.grams(n)
                if n > 1:
                    part = _has(shorter.value, w.hashes(w.grams(n - 1), n - 1))
                    good = np.zeros(len(w.start) + 1, bool)
                    good[w.grams(n - 1)[part]] = True
                    at = at[good[at] & good[at + 1]]
                h = w.hashes(at, n)
                use = _has(buckets.value, h)
                at, h = at[use], h[use]
                counts.add(w, at, h, n)
                if ahead is not None:
                    may = np.zeros(len(w.start) + 1, bool)
                    may[at] = True
                    nxt = w.grams(n + 1)
                    nxt = nxt[may[nxt] & may[nxt + 1]]
                    ahead.add(w.hashes(nxt, n + 1))
                if len(counts.names) >= HELD:
                    yield from packed([(*r[:3], None, None, r[3]) for r in counts.taken()])
        yield from packed([(*r[:3], None, None, r[3]) for r in counts.taken()])
        yield from packed([(lang, -1, None, None, None, str(c).encode()) for lang, c in words.items()])
        yield from packed([(None, None, None, *r) for r in (ahead.rows() if ahead is not None else ())])

    def packed(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for a in range(0, len(rows), 256):
            yield pd.DataFrame(rows[a:a + 256], columns=["lang", "part", "phrases", "chunk", "places", "counts"], dtype=object)
    return cut(docs.mapInPandas(run, "lang string, part int, phrases binary, chunk int, places binary, counts binary"))


def _word_totals(rows: DataFrame) -> DataFrame:
    """(lang, n) of the parts -1, whose counts are decimal."""
    return rows.groupBy("lang").agg(F.sum(F.col("counts").cast("string").cast("long")).alias("n"))


def frequent_phrases(docs: DataFrame, longest: int, least: int, size: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f, words) of phrases of 1 to `longest` words found `least` times or more, (lang, n) of all words) of docs (lang, text)."""
    sc = docs.sparkSession.sparkContext
    found, totals, buckets, shorter = None, None, None, None
    for n in range(longest + 1):
        raw = _count_pass(docs, n, longest, size, least, buckets, shorter)
        for sent in (buckets, shorter):
            if sent is not None:
                sent.destroy()
        if n == 0:
            totals = cut(_word_totals(raw.where("part = -1")))
        else:
            now = cut(_merged(raw.where("part >= 0")).where(F.col("f") >= least).withColumn("words", F.lit(n)))
            found = now if found is None else found.unionByName(now)
        if n < longest:
            buckets = sc.broadcast(_bitmap(raw.where("chunk is not null").select("chunk", "places", "counts"), size, least))
            shorter = sc.broadcast(_frequent_bits(now, n, size)) if n else None
    return found, totals


def _key(lang: Column, phrase: Column) -> Column:
    """128 bits that stand for a phrase of a language."""
    return F.struct(F.xxhash64(lang, phrase).alias("a"), F.xxhash64(phrase, lang, F.lit(1)).alias("b"))


def _looked_up(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows (_k, lang, phrase, ...) with f of side (_k, f): a counted broadcast, else by a shuffle in which keys of over HOT rows are dealt over salts."""
    if side.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(side), "_k")
    hot = lookup_side(cut(rows.groupBy("_k").count().where(F.col("count") > HOT).select("_k", F.lit(True).alias("_hot"))))
    left = rows.join(hot, "_k", "left").withColumn("_s", F.when(F.col("_hot"), F.pmod(F.xxhash64("phrase", "lang"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(hot, "_k", "left").select("_k", "f", F.explode(salts).alias("_s"))
    return left.join(right, ["_k", "_s"])


def scored(found: DataFrame, scale: int, longest: int = 4) -> DataFrame:
    """(lang, phrase, a, l, r, score) of found phrases of two words and more, by their worst cut: both parts of all cuts are looked up in one join."""
    side = cut(found.select(_key(F.col("lang"), F.col("phrase")).alias("_k"), "f"))
    w = F.split("phrase", " ", -1)
    cuts = found.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda at, a, n: F.struct(F.lit(at).alias("at"), F.array_join(F.slice("w", a, n), " ").alias("p"))
    each = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(part("l", 1, F.col("k")), part("r", F.col("k") + 1, F.size("w") - F.col("k")))).alias("x"))
    rows = _looked_up(each.select(_key(F.col("lang"), F.col("x.p")).alias("_k"), "lang", "phrase", "a", "k", "x.at"), side)
    of = lambda at, k: F.max(F.when((F.col("at") == at) & (F.col("k") == k), F.col("f"))).alias(f"{at}{k}")
    wide = rows.groupBy("lang", "phrase").agg(F.first("a").alias("a"), *(of(at, k) for k in range(1, longest) for at in "lr"))
    exact = lambda k: F.expr(f"cast(a as decimal(20, 0)) * {scale} div (cast(l{k} as decimal(20, 0)) + r{k})").cast("long")
    cut_at = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(exact(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return wide.select("lang", "phrase", "a", F.array_min(F.array(*map(cut_at, range(1, longest)))).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def covered(found: DataFrame) -> DataFrame:
    """(_k, most): how often the most frequent longer phrase around a phrase occurs."""
    w = F.split("phrase", " ", -1)
    n = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    inner = found.where("words > 2").select("lang", "f", "words", w.alias("w"), n.alias("n")).select(
        "lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("i"))
    return inner.select(_key(F.col("lang"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")).alias("_k"), "f").groupBy("_k").agg(F.max("f").alias("most"))


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, keep: int = 2000, inside_percent: int = 80,
                 scale: int = 2_000_000, unknown: str = "und", buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `keep` best phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, and these at spaces and tabs into
    words. a counts a phrase, l and r the two parts at its worst cut, n all words of the language; score is scale * a /
    (l + r), floored, in decimals. Phrases found fewer than `least` times don't count, nor those in a longer
    one that occurs at least inside_percent as often.

    Every pass reads the texts once. It counts phrases of one length exactly, as words, among those whose
    hash bucket and whose shorter parts are frequent, and counts the next length's phrases in `buckets` (a power of
    two, at most 2**32; by default one for 16 bytes of text, from 2**16 to 2**28). Their bitmaps, of buckets / 8
    bytes, 32 MB at most by default, are all that is broadcast; on larger corpora they pass more phrases and stay
    exact. A task holds a byte and a number for each bucket that it hits, and HELD phrases.

    Null or empty texts have no words; a null lang counts as `unknown`; repeated rows count each time; ties go by
    a, then by the phrase in UTF-8 bytes. An empty table gives an empty result. Other columns take no part.
    """
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = 1 << min(28, max(16, (size // 16).bit_length()))
    if least > 255 or least < 1 or buckets & (buckets - 1) or buckets < 8:
        raise ValueError("least must be 1 to 255 and buckets a power of two from 8")
    bounded_batches(docs.sparkSession)
    of = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(unknown)).alias("lang"), F.col(text).alias("text"))
    found, totals = frequent_phrases(of, longest, least, buckets)
    inside = cut(covered(found))
    rows = scored(found, scale, longest).withColumn("_k", _key(F.col("lang"), F.col("phrase"))).join(lookup_side(inside, BROADCAST_KEYS), "_k", "left")
    rows = rows.where(F.coalesce(100 * F.col("most") < inside_percent * F.col("a"), F.lit(True)))
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*by))).where(F.col("_r") <= keep)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= keep)
    return best.join(lookup_side(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
