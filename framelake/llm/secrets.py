"""Operator 8: secrets by pattern, and by structure once a candidate is decoded."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.bytepairs import map_texts
from framelake.llm.shared import fresh
from framelake.llm.words import join_bytes

#: Kinds in the order of a span list; the first three are the base rules.
KINDS = ("assign", "access", "hex", "jwt", "key", "hexkey")
#: Fixed patterns of the base rules. A failing match still takes its characters.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: Candidates for decoding.
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+={0,2}\.[A-Za-z0-9_-]+={0,2}(?:\.[A-Za-z0-9_-]*)?")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(rb"[0-9A-Fa-f]{64,}")
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")


def _from_base64(raw: bytes) -> bytes | None:
    raw = raw.translate(bytes.maketrans(b"-_", b"+/"), b"= \t\r\n\x0b\x0c")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except binascii.Error:
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the DER element at data[at], if its length fits before end."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 128:
        size = n & 127
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at:at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements that fill data[start:end] exactly, else None."""
    out = []
    while start < end:
        e = _element(data, start, end)
        if e is None:
            return None
        out.append(e)
        start = e[2]
    return out


def is_der_key(data: bytes) -> bool:
    """Whether data is one DER sequence, lengths nested exactly, laid out as a private key (PKCS#1, PKCS#8 or EC)."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _children(data, top[1], top[2])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags = [t for t, _, _ in inner]
    if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        algorithm = _children(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if len(tags) >= 2 and tags[1] == 0x04 and data[inner[0][1]] == 1:
        return all(t in (0xA0, 0xA1) and _children(data, a, b) is not None for t, a, b in inner[2:])
    return len(tags) >= 6 and all(t == 0x02 for t in tags[:6])


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key container: its magic, then strings whose lengths nest within it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data)


def is_signed_token(raw: bytes) -> bool:
    """Whether the first part of a dotted token decodes to a JSON object that names its algorithm, and the second decodes."""
    parts = raw.split(b".")
    head, body = _from_base64(parts[0]), _from_base64(parts[1])
    if head is None or body is None:
        return False
    try:
        found = json.loads(head)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def _is_key(raw: bytes) -> bool:
    """Whether base64 text holds a private key, bare or as a PEM block that was encoded once more."""
    data = _from_base64(raw)
    if data is None:
        return False
    return is_der_key(data) or is_ssh_key(data) or data.startswith(b"-----BEGIN") and any(_is_key(m[2]) for m in PEM.finditer(data))


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets in UTF-8 bytes, sorted; kinds number KINDS. Structural spans don't overlap one of their kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    if b"eyJ" in data:
        out += [(m.start(), 3, m.end()) for m in JWT.finditer(data) if is_signed_token(m[0])]
    whole = [m.span() for m in PEM.finditer(data) if _is_key(m[2])] if b"PRIVATE KEY-----" in data else []
    out += [(a, 4, b) for a, b in whole]
    for m in BASE64.finditer(data):
        if not any(a <= m.start() < b for a, b in whole) and m[0][:1] in b"MbL" and _is_key(m[0]):
            out.append((m.start(), 4, m.end()))
    for m in HEX_ANY.finditer(data):
        if len(m[0]) % 2 == 0 and m[0][:2] == b"30" and is_der_key(bytes.fromhex(m[0].decode())):
            out.append((m.start(), 5, m.end()))
    return sorted(out)


def _per_text(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Spans of each text in code points; all texts are scanned as one run of bytes with newlines between."""
    data, begin = join_bytes(texts)
    data, edges = data.tobytes(), begin.tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, kind, end in scan(data):
        i = bisect_right(edges, start) - 1
        if end > edges[i + 1] - 1:
            continue
        low, text = edges[i], texts[i]
        if not text.isascii():
            end -= start
            start = low + len(data[low:start].decode("utf-8", "surrogatepass"))
            end += start
        out[i].append((start - low, kind, end - low))
    return out


def _spans(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    # A block of key text may run over newlines, so texts with one are scanned alone.
    alone = [bool(t) and "PRIVATE KEY-----" in t for t in texts]
    out = _per_text([None if a else t for t, a in zip(texts, alone)])
    for i, a in enumerate(alone):
        if a:
            out[i] = _per_text([texts[i]])[0]
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every document; spans as kind:start:end in code points.

    Base kinds match by pattern. Structural kinds are reported only once a candidate is decoded and parsed:
    jwt (a header that names its algorithm), key (base64 of a private key whose nested lengths fit) and
    hexkey (the same in hexadecimal). Nothing is shuffled. A null or empty text has none. Repeated rows are
    scanned alike, ids may be null, an empty table gives an empty result, and other columns are not read.
    """
    def make():
        def work(texts: list[str | None]) -> pa.RecordBatch:
            found = _spans(texts)
            n = [[sum(k == kind for _, k, _ in s) for s in found] for kind in range(3)]
            base = [hashlib.sha256(_listed([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(map(_listed, found), pa.string())],
                                              names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        return work

    return map_texts(docs, text, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make, [id])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every found span of `text` replaced by mark, overlapping spans by one; rows and other columns stay, whatever their names.

    Null texts stay null, empty ones empty; repeated rows are masked alike; an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c != text]
    (masked,) = fresh(docs.columns, "_masked")

    def make():
        def work(texts: list[str | None]) -> pa.RecordBatch:
            done = [t if not s else redact(t, s, mark) for t, s in zip(texts, _spans(texts))]
            return pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=[masked])
        return work

    out = map_texts(docs, text, f"{masked} string", make, rest)
    return out.select(*(F.col(masked).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
