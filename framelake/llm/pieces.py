"""Operator 2: SentencePiece encoding that keeps byte offsets, and decoding."""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm.bytepairs import Generations, map_texts

SPACE = "▁"
#: Kinds of pieces in model files (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if data[i - 1] < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(data, i)
            value, i = data[i:i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 keys, and the replacements its values point to."""

    def __init__(self, blob: bytes):
        self.units = self.text = None
        self.heads = np.ones(256, bool)
        if blob:
            (size,) = struct.unpack("<I", blob[:4])
            self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
            self.text = blob[4 + size:]
            self.heads = np.array([self._step(0, b) is not None for b in range(256)])

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        at = node ^ self._offset(self.units[node]) ^ byte
        return at if at < len(self.units) and self.units[at] & (1 << 31 | 255) == byte else None

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that begins at data[start], if any."""
        node, found = 0, None
        for i in range(start, len(data)):
            nxt = self._step(node, data[i])
            if nxt is None:
                break
            node = nxt
            unit = self.units[node]
            if unit >> 8 & 1:
                value = self.units[node ^ self._offset(unit)] & 0x7FFFFFFF
                found = i + 1 - start, self.text[value:self.text.index(b"\0", value)]
        return found


class Normaliser:
    """The normalising rules of a model file, given as its serialised normaliser specification."""

    def __init__(self, spec: bytes):
        rules = dict(_fields(spec))
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.plain = self.map.units is None and not self.squeeze

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised UTF-8, source): source[i] is the byte of text that normalised byte i comes from; source[-1] is the end.

        At each place the longest key of the character map is replaced, else one character is kept; then
        spaces become marks, with one before the text, and are squeezed and trimmed if the model says so.
        """
        data = text.encode("utf-8")
        mark = SPACE.encode() if self.escape else b" "
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, len(mark), 1)
            source = np.repeat(np.arange(len(raw)), width)
            out = data.replace(b" ", mark)
            if self.prefix and data:
                out, source = mark + out, np.concatenate([np.zeros(len(mark), source.dtype), source])
            return out, np.append(source, len(data))
        parts: list[tuple[bytes, int]] = []
        i = 0
        while i < len(data):
            hit = self.map.longest(data, i) if self.map.units is not None and self.map.heads[data[i]] else None
            if hit is None:
                n = 1 if data[i] < 128 else 2 if data[i] < 224 else 3 if data[i] < 240 else 4
                hit = n, data[i:i + n]
            parts.append((hit[1], i))
            i += hit[0]
        out, source, space = bytearray(), [], self.squeeze
        end = len(data)
        if self.squeeze:
            while parts and not parts[-1][0].strip(b" "):
                end = parts.pop()[1]
        for piece, at in parts:
            if self.squeeze and space:
                piece = piece.lstrip(b" ")
            for b in piece:
                if not out and self.prefix:
                    out += mark
                    source += [at] * len(mark)
                byte = mark if b == 32 else bytes([b])
                out += byte
                source += [at] * len(byte)
            if piece:
                space = piece.endswith(b" ")
        while self.squeeze and out.endswith(mark):
            del out[-len(mark):], source[-len(mark):]
        return bytes(out), np.array([*source, end])


class Model:
    """A SentencePiece model file: pieces, normaliser and the library's processor for it."""

    def __init__(self, path: str):
        import sentencepiece

        data = open(path, "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces, self.kinds, norm = [], [], b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b""))
                self.kinds.append(f.get(3, NORMAL))
            elif number == 3:
                norm = value
        self.rules = Normaliser(norm)
        self.normalise = self.rules.normalise
        texts = [p.decode("utf-8", "replace") for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED)]
        # Words may be encoded one by one if no piece holds a space mark behind another character.
        self.by_word = self.rules.escape and self.rules.prefix and self.rules.plain and USER_DEFINED not in self.kinds \
            and not any(SPACE in x.lstrip(SPACE) for x in texts)
        self.widths = np.array([1 if k == BYTE else len(p) for p, k in zip(self.pieces, self.kinds)])
        self.unknown = np.array(self.kinds) == UNKNOWN
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*")

    def spans(self, out: bytes, source: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(start, end) bytes of the text for every id without begin and end; out, source: the text as `normalise` gives it.

        Pieces are laid along the normalised bytes by their widths, and their edges are read off the source.
        Bytes that normalising added belong to their neighbour. An unknown piece takes what stands between its
        neighbours.
        """
        width = self.widths[ids]
        if self.unknown[ids].any():
            at = 0
            for i, t in enumerate(ids.tolist()):
                if self.kinds[t] == UNKNOWN:
                    nxt = next((self.pieces[x] for x in ids[i + 1:].tolist() if self.kinds[x] != UNKNOWN), None)
                    stop = out.find(nxt, at + 1) if nxt else len(out)
                    width[i] = (stop if stop > 0 else len(out)) - at
                at += width[i]
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(width, out=edges[1:])
        edges = source[edges]
        return np.stack([edges[:-1], edges[1:]], axis=1)


class PieceEncoder:
    """Encodes texts as the library does; words come from a bounded cache where the model lets words stand alone."""

    def __init__(self, path: str):
        self.model, self.cache = Model(path), Generations()
        lib = self.model.library
        #: A lone mark, which no text of its own encodes to: what a space behind a letter adds.
        self.mark = array("I", lib.encode("a ")[len(lib.encode("a")):]).tobytes()

    def encode(self, texts: list[str], normal: list[str]) -> list[array]:
        """Ids of each text without begin and end; normal: the texts as the model normalises them."""
        lib = self.model.library
        if not self.model.by_word:
            return [array("I", x) for x in lib.encode(texts, num_threads=1)]
        words = [self.model.word.findall(t) for t in normal]
        known = self.cache.new
        known[SPACE] = self.mark
        missing = self.cache.missing(set().union(*words))
        # The library puts the first mark back.
        for w, ids in zip(missing, lib.encode([w[1:] for w in missing], num_threads=1) if missing else []):
            known[w] = array("I", ids).tobytes()
        out = [array("I", b"".join(map(known.__getitem__, x))) for x in words]
        self.cache.turn()
        return out


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker, so that tasks find its words."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, path: str, spans: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, and, on demand, decoded, ids and their byte spans) of every document.

    Ids are the library's, with begin and end; decoded is the library's decoding of them. Every id is projected
    to the bytes of the source text that it stands for; begin and end have empty spans. Digests are over ids,
    and over start and end of each span in turn, as little-endian unsigned 32-bit integers, and over the
    decoded text in UTF-8. spans: also decoded string, ids, starts and ends array<int>. Nothing is shuffled. A
    null or empty text is begin and end only. Repeated rows are encoded alike, ids may be null, an empty table
    gives an empty result, and other columns are not read.
    """
    def make():
        encoder = piece_encoder(path)
        model = encoder.model
        lib = model.library
        bos, eos = lib.bos_id(), lib.eos_id()

        def work(texts: list[str | None]) -> pa.RecordBatch:
            texts = [t or "" for t in texts]
            normal = [model.normalise(t) for t in texts]
            bare = encoder.encode(texts, [n.decode("utf-8") for n, _ in normal])
            full = [array("I", [bos, *x, eos]) for x in bare]
            decoded = lib.decode([x.tolist() for x in full])
            at = [np.concatenate([[[0, 0]], model.spans(*n, np.frombuffer(x, np.uint32)), [[n[1][-1]] * 2]]).astype("<u4") for n, x in zip(normal, bare)]
            raw = [np.frombuffer(x, np.uint32).astype("<u4", copy=False) for x in full]
            cols = {"n_tokens": pa.array([len(x) for x in full], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]),
                    "spans_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in at])}
            if spans:
                lists = lambda rows: pa.array([x.tolist() for x in rows], pa.list_(pa.int32()))
                cols |= {"decoded": pa.array(decoded), "ids": lists(raw), "starts": lists([s[:, 0] for s in at]), "ends": lists([s[:, 1] for s in at])}
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        return work

    more = ", decoded string, ids array<int>, starts array<int>, ends array<int>" if spans else ""
    return map_texts(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + more, make, [id])


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, decoded) from a column of id arrays; a null array gives a null text, ids outside the model raise."""
    def make():
        lib = Model(path).library

        def work(rows: list[list[int] | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None if x is None else lib.decode(x) for x in rows], pa.string())], names=["decoded"])
        return work

    return map_texts(df, ids, "decoded string", make, list(carry))
