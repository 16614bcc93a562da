"""Secrets in text, confirmed by structure.

Three patterns always count. The method adds what decodes to a key or a signed token: runs of
base64 or hex, also base64 broken over lines, are decoded and taken only if they are a private key,
open or encrypted, in DER whose nested lengths fill it, an OpenSSH key whose length-prefixed fields
fill it, such a body in a PEM frame, or a token whose header is a JSON object with an algorithm.
Nesting deeper than ``DEPTH`` confirms nothing: no key or header is that deep.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "pem", "jwt", "key")

DEPTH = 12
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z][A-Za-z-]*: [^\n]*\n)*)([A-Za-z0-9+/=\s]*)-----END \1-----")
#: Base64 broken into lines of equal length with a shorter last one.
_LINES = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,100}(?:\r?\n[A-Za-z0-9+/]{1,100})+={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_KEYWORDS = ("pass", "secret", "token", "api")
#: Bytes of base64 and hex runs as b, lower-case hex as h; a text without 32 such bytes in a row has no candidate.
_RUNS = bytes(0x62 if chr(i).isalnum() and i < 128 or chr(i) in "+/_-=" else 0x20 for i in range(256))
_HEXES = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))


def _der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the values in ``data[at:end]`` if their lengths nest exactly, else None."""
    found: list[tuple[int, int, int]] = []
    while at < end:
        if at + 2 > end or depth > DEPTH:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        if tag & 0x20 and _der(data, at, at + size, depth + 1) is None:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def _openssh(data: bytes) -> bool:
    """Whether the fields of OpenSSH's own form fill ``data``: cipher, derivation and its options, public keys, private part."""
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out, at = data[at + 4 : end], end
        return out

    cipher, derivation, options = field(), field(), field()
    if not cipher or not derivation or options is None or not (cipher + derivation).isascii():
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not all(field() for _ in range(keys)):
        return False
    return bool(field()) and at == len(data)


OPENSSH = b"openssh-key-v1\0"


def is_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: PKCS#1, PKCS#8 (open or encrypted) or SEC1 as DER, or OpenSSH's own form."""
    if data.startswith(OPENSSH):
        return _openssh(data)
    if len(data) < 24 or data[0] != 0x30 or (outer := _der(data, 0, len(data))) is None or len(outer) != 1:
        return False
    inner = _der(data, *outer[0][1:]) or []
    tags = [t for t, _, _ in inner]
    if tags == [0x30, 0x04]:  # an algorithm with its parameters and encrypted data
        algorithm = [t for t, _, _ in _der(data, *inner[0][1:]) or []]
        return algorithm == [0x06, 0x30] and inner[1][2] - inner[1][1] >= 16
    if not inner or tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1:  # the version
        return False
    return tags[:9] == [0x02] * 9 or tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04]


def _base64(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def _key_in_lines(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span of a key that begins at ``start`` and whose base64 goes on over lines; what follows on the last line or below is none of it."""
    if text[start] != "M" and not text.startswith("b3BlbnNzaC", start):
        return None
    places = [i for i in range(start, end) if text[i] not in "\r\n="]
    run = "".join(text[i] for i in places)
    data = _base64(run if len(run) % 4 != 1 else run[:-1])
    if data[:1] == b"\x30" and len(data) > 6:  # the outer length tells where it ends
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        data = data[: 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])]
    if not is_key(data):
        return None
    last = places[-(-len(data) * 4 // 3) - 1] + 1
    while last < len(text) and text[last] == "=":
        last += 1
    return start, last


def is_signed_token(run: str) -> bool:
    """Whether header and payload of a dotted run are JSON objects and the header names its algorithm."""
    try:
        header, payload = (json.loads(_base64(x)) for x in run.split(".")[:2])
    except (ValueError, RecursionError):  # no JSON, or nested without end
        return False
    return isinstance(header, dict) and isinstance(payload, dict) and isinstance(header.get("alg"), str)


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all secrets by start and then kind, in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are the base patterns' whole matches, leftmost and not
    overlapping within a kind; matches with too short values count for nothing. ``pem``, ``jwt``
    and ``key`` are what structure confirms and may overlap base spans.
    """
    raw = text.encode("utf-8", "surrogatepass")
    low, out = raw.lower(), []
    if any(k.encode() in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEXES):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    if b"PRIVATE KEY-----" in raw:
        out += [("pem", *m.span()) for m in _PEM.finditer(text) if is_key(_base64("".join(m[3].split()))) or "Proc-Type: 4,ENCRYPTED" in m[2] and len(m[3]) >= 24]
    if b"eyJ" in raw:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if b"b" * 32 in raw.translate(_RUNS):
        for m in _RUN.finditer(text):
            run = m[0]
            if is_key(_base64(run)) or len(run) % 2 == 0 and not run.strip("0123456789abcdefABCDEF") and is_key(bytes.fromhex(run)):
                out.append(("key", *m.span()))
        if "\n" in text:
            out += [("key", *at) for m in _LINES.finditer(text) if (at := _key_in_lines(text, *m.span()))]
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of each row.

    A null or empty text has no spans: counts of 0, the digest of nothing, and an empty string.
    Other columns are not read; rows with repeated ids each get their row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t or "") for t in b.column(1).to_pylist()]
            base = [[s for s in x if s[0] in KINDS[:3]] for x in found]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
            sha = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, sha, pa.array(map(joined, found), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``[secret]``."""
    out, at = [], 0
    for _, a, b in find(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def masked_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked and ``length_col``, if there, as its length.

    A null text stays null; its length stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, columns = b.schema.names, list(b.columns)
            texts = [mask(t.as_py()) if t.is_valid else None for t in columns[names.index(text_col)]]
            columns[names.index(text_col)] = pa.array(texts, pa.string())
            if length_col in names:
                i = names.index(length_col)
                columns[i] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[i].to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if length_col in docs.columns:
        docs = docs.withColumn(length_col, docs[length_col].cast("long"))
    return docs.mapInArrow(run, docs.schema)
