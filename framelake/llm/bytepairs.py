"""Byte-level BPE tokenizers over Spark rows: exact splitting with a bounded word cache, and prefix dynamic programming.

Serves operators 9 (token counts) and 10 (packing). A tokenizer is a file of the tokenizers library; its
path is a parameter and the file must be readable on every executor.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import M3, bounded_batches, mix
from framelake.llm.words import join_bytes, small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words a worker remembers, twice over; older ones are forgotten together.
CACHE_WORDS = 300_000
#: Fixed splitting patterns of the two kinds of tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Generations:
    """A mapping of bounded size: what was not asked for during a whole generation is forgotten."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def missing(self, keys: set) -> list:
        """Keys that are nowhere yet; all others are in `new` from now on, until `turn`."""
        out = []
        for key in keys.difference(self.new):
            found = self.old.get(key)
            if found is None:
                out.append(key)
            else:
                self.new[key] = found
        return out

    def turn(self) -> None:
        """Between batches: begins a new generation if this one is full."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}


class Splitter:
    """Splits texts into the words that a tokenizer file encodes one by one, as the library would.

    Python's and the library's character classes can differ for rare characters, so each character beyond
    those probed is tried once in both; a text with one that differs (or that changes under composition,
    or that holds a special token's string) is left to the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spec = spec = json.loads(self.library.to_str())
        steps = spec["normalizer"]
        self.lower = steps is not None
        pre = spec["pre_tokenizer"]
        inner = pre["pretokenizers"][0]["pattern"]["Regex"] if pre["type"] == "Sequence" else BYTE_PATTERN
        self.pattern = regex.compile(inner)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.same: dict[str, bool] = {}
        # Characters up to U+024F that both sides class alike are spelt out, for a pattern of the faster re module.
        common = [c for c in map(chr, range(1, 0x250)) if self._probe(c)]
        of = lambda kind: "".join(re.escape(c) for c in common if regex.match(kind, c))
        letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
        quick = inner.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        quick = quick.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
        # Words of letters come first in texts; no other branch can begin as they do.
        branches = quick.split("|")
        first = [b for b in branches if b.endswith(f"[{letters}]+")]
        self.quick = re.compile("|".join(first + [b for b in branches if b not in first]) if "|" not in letters else quick)
        self.rare = re.compile("[^" + "".join(map(re.escape, common)) + "]")

    def _spans(self, text: str) -> list[str]:
        x = self.library.normalizer.normalize_str(text) if self.lower else text
        return [x[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(x)]

    def _probe(self, c: str) -> bool:
        known = self.same.get(c)
        if known is None:
            trial = f"a{c}1{c}!{c} {c}a{c}{c}"
            known = self.same[c] = self._split(trial) == self._spans(trial)
        return known

    def _split(self, text: str) -> list[str]:
        if self.lower:
            text = " ".join(regex.split(r"\s+", text)).lower()
        return self.pattern.findall(text)

    def words(self, text: str) -> list[str] | None:
        """The words of text, or None if the library must encode it whole."""
        if self.special.search(text):
            return None
        if not self.rare.search(text):
            return self.quick.findall(text.lower() if self.lower else text)
        if self.lower and not unicodedata.is_normalized("NFC", text) or not all(map(self._probe, set(text))):
            return None
        return self._split(text)


class Merges:
    """Byte pairs merged in many words at once: a row of symbols for each word, and in a step each row's first pair of least rank.

    A table with open places gives the ranks of pairs. Rows are right for merges that each make a token of
    their own, as `of` asks: then no merge brings up a pair that ranks before it.
    """

    #: Bytes of a row; longer words are left to the library. Words of a step, and the rank of pairs that aren't merged.
    WIDTHS, WORDS, NEVER = (4, 8, 16, 32), 1 << 14, 1 << 30

    def __init__(self, model: dict):
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbol = _byte_symbols()
        self.symbols = np.array([vocab[symbol[i]] for i in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = max(vocab.values()) + 1
        keys = np.array([vocab[a] * (self.none + 1) + vocab[b] for a, b in pairs], np.int64)
        bits = (4 * len(keys)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NEVER, np.int64)
        for i, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.last
            self.keys[slot], self.ranks[slot] = key, i
        self.first = self._rank(np.repeat(self.symbols, 256), np.tile(self.symbols, 256))

    @classmethod
    def of(cls, spec: dict) -> Merges | None:
        """The merges of a tokenizer file of the plain byte-level kind, else None."""
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        made = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}
        return cls(model) if made and len(made) == len(model["merges"]) and model["vocab"].keys() >= set(_byte_symbols().values()) else None

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * M3 >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        slot = self._slots(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], self.NEVER)
        at = np.flatnonzero((held != key) & (held >= 0))
        while len(at):
            slot[at] = slot[at] + 1 & self.last
            held = self.keys[slot[at]]
            hit = held == key[at]
            out[at[hit]] = self.ranks[slot[at[hit]]]
            at = at[~hit & (held >= 0)]
        return out

    def _rows(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Ids of words of at most `width` bytes, in rows, `none` between and after them."""
        n, last = len(begin), len(begin) * width
        inside = np.arange(width) < size[:, None]
        raw = np.where(inside, data[np.minimum(begin[:, None] + np.arange(width), len(data) - 1)], 0).astype(np.int64)
        # One place more stands for what is before and after each row.
        token, rank = np.full(last + 1, self.none), np.full(last + 1, self.NEVER)
        token[:last] = np.where(inside, self.symbols[raw], self.none).ravel()
        grid = rank[:last].reshape(n, width)
        grid[:, :-1] = np.where(inside[:, 1:], self.first[raw[:, :-1] << 8 | raw[:, 1:]], self.NEVER)
        after, before = np.arange(1, last + 2), np.arange(-1, last)
        after[width - 1:last:width], before[:last:width] = last, last
        row = np.arange(n)
        while len(row):
            held = grid[row]
            column = held.argmin(1)
            least = held[np.arange(len(row)), column]
            live = least < self.NEVER
            row = row[live]
            left = row * width + column[live]
            right, behind = after[left], before[left]
            ahead = after[right]
            token[left], token[right] = made, none = self.made[least[live]], self.none
            rank[right], after[left], before[ahead] = self.NEVER, ahead, left
            rank[left], rank[behind] = self._rank(made, token[ahead]), self._rank(token[behind], made)
        return token[:last].reshape(n, width)

    def ids(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, other: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (spans of data) in order, and how many each has; other: ids of words that are too long for a row."""
        number, found = np.zeros(len(begin), np.int64), []
        for low, width in zip((0, *self.WIDTHS), self.WIDTHS):
            fit = np.flatnonzero((size > low) & (size <= width))
            for i in range(0, len(fit), self.WORDS):
                some = fit[i:i + self.WORDS]
                rows = self._rows(data, begin[some], size[some], width)
                number[some] = (rows != self.none).sum(1)
                found.append((some, rows[rows != self.none]))
        long = np.flatnonzero(size > self.WIDTHS[-1])
        if len(long):
            ids = other([data[i:i + n].tobytes().decode() for i, n in zip(begin[long].tolist(), size[long].tolist())])
            number[long] = [len(x) for x in ids]
            found.append((long, np.concatenate([np.array(x, np.int64) for x in ids])))
        start = np.cumsum(number) - number
        out = np.zeros(int(number.sum()), np.int64)
        for some, ids in found:
            out[spread(start[some], number[some])] = ids
        return out, number


def spread(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., as many as number says, for each start."""
    ends = np.cumsum(number)
    return np.repeat(start - ends + number, number) + np.arange(ends[-1] if len(ends) else 0)


class Held:
    """Token ids of byte strings of up to LONGEST bytes, found by the strings themselves: 23 bytes and their number are the key.

    A table with open places, of bounded size: between batches it begins anew once it holds `size` strings.
    """

    LONGEST, BITS = 23, 21
    _MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def __init__(self, kind: np.dtype):
        self.kind, self.size = kind, 1 << self.BITS - 1
        self.clear()

    def clear(self) -> None:
        self.rows, self.count = np.zeros((1 << self.BITS, 4), np.uint64), 0
        self.ids, self.end = np.empty(1 << 16, self.kind), 0

    def turn(self) -> None:
        """Between batches: begins anew if this is full."""
        if self.count >= self.size or self.end >= 8 * self.size:
            self.clear()

    @classmethod
    def keys(cls, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys of short spans of data, four numbers each; the fourth is their hash."""
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        eight = np.ndarray(len(data) + 24, "<u8", padded, strides=(1,)).copy()
        out = np.empty((len(begin), 4), np.uint64)
        for i in range(3):
            out[:, i] = eight[begin + 8 * i] & cls._MASKS[np.clip(size - 8 * i, 0, 8)]
        out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        out[:, 3] = mix(mix(mix(out[:, 0]) * M3 ^ out[:, 1]) * M3 ^ out[:, 2])
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each string begin, and how many they are: 0 for those that aren't held."""
        value, at = np.zeros(len(keys), np.uint64), np.arange(len(keys))
        slot = (keys[:, 3] >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(at):
            row, key = self.rows[slot], keys[at] if len(at) < len(keys) else keys
            hit = (row[:, 0] == key[:, 0]) & (row[:, 1] == key[:, 1]) & (row[:, 2] == key[:, 2])
            value[at[hit]] = row[hit, 3]
            on = ~hit & (row[:, 3] != 0)
            at, slot = at[on], slot[on] + 1 & (1 << self.BITS) - 1
        return (value >> np.uint64(8)).astype(np.int64), (value & np.uint64(255)).astype(np.int64)

    def add(self, ids: np.ndarray) -> int:
        """Keeps ids and says where they begin."""
        start, self.end = self.end, self.end + len(ids)
        if self.end > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.empty(2 * self.end - start, self.kind)])
        self.ids[start:self.end] = ids
        return start

    def put(self, keys: np.ndarray, start: np.ndarray, number: np.ndarray) -> None:
        """Distinct strings that aren't held, and their ids; those that would fill more than three quarters of the table are left out."""
        n = max(0, min(len(keys), 3 * len(self.rows) // 4 - self.count))
        self.count += n
        keys, value = keys[:n], start[:n].astype(np.uint64) << np.uint64(8) | number[:n].astype(np.uint64)
        at, slot = np.arange(n), (keys[:, 3] >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.rows[slot, 3] == 0)
            # Of several that want a place, the last one written has it.
            self.rows[slot[free], 3] = at[free] + 1
            free = free[self.rows[slot[free], 3] == at[free].astype(np.uint64) + np.uint64(1)]
            self.rows[slot[free], :3], self.rows[slot[free], 3] = keys[at[free], :3], value[at[free]]
            on = np.ones(len(at), bool)
            on[free] = False
            at, slot = at[on], slot[on] + 1 & (1 << self.BITS) - 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct key, and which of them each key is. Equal hashes of different keys can leave an equal one twice."""
    order = np.argsort(keys[:, 3], kind="stable")
    held = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (held[1:] != held[:-1]).any(1)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places of spaces before something else than white space, in texts that each end in a newline."""
    at = np.flatnonzero(data == 32)
    after = data[at + 1]
    white = _WHITE[after]
    more = np.flatnonzero(np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3]))  # where white space beyond ASCII can begin
    first, second = after[more], data[at[more] + 2]
    white[more] = np.where(first == 0xC2, (second == 0x85) | (second == 0xA0), np.where(first == 0xE1, second == 0x9A, (second == 0x80) | (second == 0x81)))
    return at[~white]


class Encoder:
    """ids of whole texts: parts of texts from a bounded table, unknown parts worked out together.

    A word begins at every space before something else than white space, so texts are cut there, and parts
    are encoded one by one. Files of another than the plain byte-level kind are left to the library.
    """

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.merges = Merges.of(self.split.spec)
        #: Two bytes an id where all ids fit.
        self.kind = np.dtype("<u2" if self.split.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache = Held(self.kind)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.split.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, cut: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Words of parts, those of parts at cuts first, and how many each part has: 0 if its text must be left to the library."""
        number = np.zeros(len(begin), np.int64)
        inner, alone = np.flatnonzero(cut), np.flatnonzero(~cut)
        joined = data[spread(begin[inner], size[inner])]
        words = self.split.words(joined.tobytes().decode())
        if words is None:
            words, alone = [], np.concatenate([inner, alone])
        elif words:
            chars = np.cumsum(joined & 0xC0 != 0x80)[np.cumsum(size[inner]) - 1]
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            number[inner] = np.diff(np.searchsorted(ends, chars, side="right"), prepend=0)
        for i, a, n in zip(alone.tolist(), begin[alone].tolist(), size[alone].tolist()):
            own = self.split.words(data[a:a + n].tobytes().decode()) or []
            number[i] = len(own)
            words += own
        return words, number

    def _unknown(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, cut: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of parts begin, and how many they are; keys: of the first parts, which are short."""
        held, order = self.cache, np.concatenate([np.flatnonzero(cut), np.flatnonzero(~cut)])
        words, number = self._words(data, begin, size, cut)
        text = "".join(words)
        raw, ends = np.frombuffer(text.encode(), np.uint8), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if len(raw) > len(text):
            ends = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[ends]
        wide = np.diff(ends, prepend=0)
        at = ends - wide
        first, each = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        short, long = np.flatnonzero(wide <= held.LONGEST), np.flatnonzero(wide > held.LONGEST)
        mine = held.keys(raw, at[short], wide[short])
        one, which = _distinct(mine)
        where, count = held.find(mine[one])
        new = np.flatnonzero(count == 0)
        some = np.concatenate([short[one[new]], long])
        ids, n = self.merges.ids(raw, at[some], wide[some], self._library)
        start = held.add(ids) + np.cumsum(n) - n
        where[new], count[new] = start[:len(new)], n[:len(new)]
        held.put(mine[one[new]], where[new], count[new])
        first[short], each[short] = where[which], count[which]
        first[long], each[long] = start[len(new):], n[len(new):]
        # Ids of parts of several words are kept once more, together.
        ids = held.ids[spread(first, each)]
        ends = np.append(0, np.cumsum(each))[np.cumsum(number[order])]
        n = np.empty(len(begin), np.int64)
        n[order] = np.diff(ends, prepend=0)
        start = np.empty(len(begin), np.int64)
        start[order] = held.add(ids) + ends - n[order]
        several = np.flatnonzero(number[:len(keys)] > 1)
        held.put(keys[several], start[several], n[several])
        return start, n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as integers of `kind`."""
        if not self.merges:
            return [np.array(x, self.kind).tobytes() for x in self._library(texts)]
        held, special = self.cache, self.split.special
        whole = {i for i, t in enumerate(texts) if special.search(t)}
        data, begin = join_bytes(["" if i in whole else t for i, t in enumerate(texts)])
        cut, starts = np.zeros(len(data), bool), np.zeros(len(data), bool)
        cut[_cuts(data)] = True
        starts |= cut
        starts[begin[:-1]] = True
        at = np.flatnonzero(starts)
        owner = np.searchsorted(begin, at, side="right") - 1
        size = np.minimum(np.append(at[1:], len(data)), begin[owner + 1] - 1) - at
        at, owner, size = (x[size > 0] for x in (at, owner, size))
        short = np.flatnonzero(size <= held.LONGEST)
        keys = held.keys(data, at[short], size[short])
        start, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[short], n[short] = held.find(keys)
        lack, long = np.flatnonzero(n[short] == 0), np.flatnonzero(size > held.LONGEST)
        if len(lack) or len(long):
            one, which = _distinct(keys[lack])
            some = np.concatenate([short[lack[one]], long])
            where, count = self._unknown(data, at[some], size[some], cut[at[some]], keys[lack[one]])
            start[short[lack]], n[short[lack]] = where[which], count[which]
            start[long], n[long] = where[len(one):], count[len(one):]
        whole.update(owner[n == 0].tolist())
        raw, width = held.ids[spread(start, n)].tobytes(), self.kind.itemsize
        ends = (width * np.append(0, np.cumsum(n))[np.searchsorted(owner, np.arange(len(texts) + 1))]).tolist()
        held.turn()
        return [np.array(self.split.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes() if i in whole else raw[ends[i]:ends[i + 1]] for i, t in enumerate(texts)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker, so that tasks find its words."""
    return Encoder(path)


class PrefixCounts:
    """Exact BPE token counts at every prefix of a word, by dynamic programming over its symbols.

    The encoding of a prefix ends in exactly one token t whose left neighbour u, the last token of the
    rest, would not have merged across the boundary; so the count is that of the rest plus one. Whether a
    boundary holds depends on the pair (u, t) alone: some merge would cross it if a piece on u's right edge
    and one on t's left edge stand side by side when that merge's turn comes. Pairs are remembered.
    """

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(merges):
            self.parts.setdefault(self.vocab[a + b], (self.vocab[a], self.vocab[b], i))
        self.longest = max(map(len, self.vocab))
        self.held, self.whole = Generations(1 << 19), {}
        self.symbol = _byte_symbols()

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """(piece, rank of the merge that consumes it) along one edge of a token, smallest piece first."""
        out = [(token, float("inf"))]
        while token in self.parts:
            a, b, i = self.parts[token]
            token = b if right else a
            out.append((token, i))
        return out[::-1]

    def boundary(self, u: int, t: int) -> bool:
        key = u << 20 | t
        found = self.held.get(key)
        if found is None:
            found = True
            left, right = self._edge(u, True), self._edge(t, False)
            i = j = 0
            while True:
                # At equal ranks the merge further left comes first: inside u before the boundary, inside t after it.
                m = self.rank.get((left[i][0], right[j][0]))
                if m is not None and m < left[i][1] and m <= right[j][1]:
                    found = False
                    break
                if left[i][1] == right[j][1] == float("inf"):
                    break
                if left[i][1] <= right[j][1]:
                    i += 1
                else:
                    j += 1
            self.held.put(key, found)
        return found

    def _alone(self, token: int) -> bool:
        """Whether the token's own string is encoded as this one token."""
        found = self.whole.get(token)
        if found is None:
            p = self.parts.get(token)
            found = self.whole[token] = p is None or self._alone(p[0]) and self._alone(p[1]) and self._only(p)
        return found

    def _only(self, p: tuple[int, int, int]) -> bool:
        u, t, m = p
        left, right = self._edge(u, True), self._edge(t, False)
        for a, stop_a in left:
            for b, stop_b in right:
                r = self.rank.get((a, b))
                if r is not None and (a, b) != (u, t) and r < stop_a and r <= stop_b:
                    return False
        return True

    def inner(self, symbols: str) -> tuple[list[int], list[int]]:
        """Last token and token count of every prefix of symbols, taken as unfinished words."""
        get, ok, alone = self.vocab.get, self.boundary, self._alone
        last, count = [-1], [0]
        for j in range(1, len(symbols) + 1):
            for i in range(max(0, j - self.longest), j):
                t = get(symbols[i:j])
                if t is not None and (alone(t) if i == 0 else ok(last[i], t) and alone(t)):
                    last.append(t)
                    count.append(count[i] + 1)
                    break
        return last, count

    def finish(self, symbols: str, j: int, last: list[int], count: list[int]) -> int:
        """Tokens of the first j symbols taken as a finished word."""
        for i in range(max(0, j - self.longest), j):
            t = self.vocab.get(symbols[i:j] + self.end)
            if t is not None and (self._alone(t) if i == 0 else self.boundary(last[i], t) and self._alone(t)):
                return count[i] + 1
        return 0

    def word(self, word: str) -> int:
        """Tokens of the whole word."""
        s = word.encode("utf-8").decode("latin-1").translate(self.symbol)
        last, count = self.inner(s[:-1])
        return self.finish(s, len(s), last, count)

    def prefixes(self, word: str) -> list[int]:
        """Tokens of the first 1, 2, ... bytes of the word, each cut taken as the word's end."""
        s = word.encode("utf-8").decode("latin-1").translate(self.symbol)
        last, count = self.inner(s)
        return [self.finish(s, j, last, count) for j in range(1, len(s) + 1)]


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter:
    """Token counts of texts by prefix dynamic programming over their words, with a bounded word cache."""

    def __init__(self, path: str):
        self.split, self.dp = Splitter(path), PrefixCounts(path)
        self.cache = Generations()

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; every distinct word of the batch that isn't known is worked out once."""
        words = [self.split.words(t or "") for t in texts]
        known = self.cache.new
        for w in self.cache.missing(set().union(*filter(None, words))):
            known[w] = self.dp.word(w)
        get = known.__getitem__
        out = [self._pieces(t or "") if w is None else sum(map(get, w)) for t, w in zip(texts, words)]
        self.cache.turn()
        return out

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def _pieces(self, text: str) -> int:
        """A text with special strings or odd characters: the library splits, the words are counted as ever."""
        lib, total, at = self.split.library, 0, 0
        for m in [*self.split.special.finditer(text), None]:
            part = text[at:m.start() if m else len(text)]
            x = lib.normalizer.normalize_str(part) if self.split.lower else part
            total += sum(self.dp.word(x[a:b]) for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(x) if b > a) + (m is not None)
            at = m.end() if m else at
        return total

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text: each prefix taken as a text of its own."""
        out = np.zeros(len(text) + 1, np.int64)
        if self.split.words(text) is None or self.split.lower and len(text.lower()) != len(text):
            # Words never run over white space, so the runs between are done one by one, odd ones prefix by prefix.
            for m in regex.finditer(r"\S+", text):
                a, b = m.span()
                odd = self.split.words(m[0]) is None or len(m[0].lower()) != b - a
                own = [self.count(m[0][:i]) for i in range(1, b - a + 1)] if odd else self.table(m[0])[1:]
                out[a + 1:b + 1] = out[a] + own
                out[b + 1:] = out[b]
            return out
        for m in self.split.pattern.finditer(text.lower() if self.split.lower else text):
            a, b = m.span()
            ends = np.cumsum([len(c.encode()) for c in m[0]]) - 1
            own = np.array(self.dp.prefixes(m[0]))[ends]
            if m[0][0] == "'" and b - a > 2:  # a part of a contraction is a mark and letters
                own[1:-1] = [self.count(m[0][:i]) for i in range(2, b - a)]
            out[a + 1:b + 1] = out[a] + own
            out[b + 1:] = out[b]
        return out

    def truncate(self, text: str, budget: int, table: np.ndarray | None = None) -> str:
        """The longest beginning of text within budget tokens, read off its table, which may serve many budgets."""
        table = self.table(text) if table is None else table
        return text[:int(np.flatnonzero(table <= budget)[-1])]


@functools.cache
def counter(path: str) -> TokenCounter:
    """One counter for each worker, so that tasks find its words."""
    return TokenCounter(path)


def map_texts(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[list[str | None]], pa.RecordBatch]], carry: list[str]) -> DataFrame:
    """df's columns `carry` beside the columns that make()(texts) computes for batches of texts; make runs once a task."""
    safe = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in small_batches(texts, 1 << 21):
                more = work(texts[a:b])
                held = [batch.column(i).slice(a, b - a) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*held, *more.columns], names=[*safe, *more.schema.names])

    bounded_batches(df.sparkSession)
    # Carried columns travel as c0, c1, ..., whatever their own names are.
    fields = ", ".join(f"{s} {df.schema[c].dataType.simpleString()}" for c, s in zip(carry, safe))
    out = df.select(*(F.col(c).alias(s) for c, s in zip(carry, safe)), F.col(text).alias("_text")).mapInArrow(run, f"{fields}, {schema}")
    return out.select(*(F.col(s).alias(c) for c, s in zip(carry, safe)), *out.columns[len(safe):])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document, without begin, end or added special tokens.

    Counts come from prefix dynamic programming over each distinct word (see PrefixCounts and
    TokenCounter.table for counts at every prefix). Nothing is shuffled. A null or empty text has 0 bytes
    and tokens. Repeated rows are counted alike, ids may be null, an empty table gives an empty result, and
    other columns are not read. Special tokens' strings inside a text count as the one token they stand for.
    """
    def make():
        counts = counter(path).counts

        def work(texts: list[str | None]) -> pa.RecordBatch:
            n = counts(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([x > limit for x in n])], names=["n_bytes", "n_tokens", "over_limit"])
        return work

    return map_texts(docs, text, "n_bytes long, n_tokens long, over_limit boolean", make, [id])
