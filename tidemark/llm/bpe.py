"""Byte-level BPE, encoded by a dynamic program over prefixes, and decoded.

A text is cut by the tokenizer's pattern. In a piece, every prefix has one last token in the
encoding that merging would give: the longest vocabulary entry that ends the prefix and is
compatible with the last token of the prefix before it. An automaton over the vocabulary finds
the entries that end at a byte; compatibility undoes merges along the border of the two tokens
and asks at each step whether an earlier merge would have crossed it. The tokens are read off the
back-pointers. Pieces recur, so each worker keeps the ids of pieces it has met, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator, Mapping
from functools import cache
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from .common import give_back


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as they are, the
    others in turn from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """What ``make`` gives for keys, kept for the keys met lately: between ``size`` and twice as many."""

    def __init__(self, make, size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) < 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class Bpe:
    """A byte-level tokenizer read from its file. Ids are given as 4 bytes each, little-endian."""

    def __init__(self, path: str, kept: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._only_known(spec)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items()}
        # rank of a token: when merging makes it, in merge order; single bytes come before all
        self.rank = {i: -1 for i, b in self.bytes_of.items() if len(b) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, m in enumerate(merges):
            x, y = m.split(" ", 1) if isinstance(m, str) else m
            self.joined[vocab[x], vocab[y]] = n
            if vocab[x + y] not in self.rank:
                self.rank[vocab[x + y]], self.halves[vocab[x + y]] = n, (vocab[x], vocab[y])
        self.token_of = {self.bytes_of[i]: i for i in self.rank}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()}
        # the automaton: a state is the longest end of what was read that begins some token
        self.begins = {b[:n] for b in self.token_of for n in range(1, len(b) + 1)} | {b""}
        self.states: dict[bytes, int] = {b"": 0}
        self.names, self.steps, self.longest = [b""], [{}], [-1]
        self.shorter: dict[int, int] = {}  # the next shorter token that ends a token
        self.fits: dict[int, bool] = {}  # by two tokens in one integer
        self.of_piece = _Kept(self._by_prefixes, kept)
        self.of_spaced = _Kept(self._spaced, kept)
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        )
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _only_known(spec: dict) -> None:
        """Raises for a file with settings that this class does not carry out."""
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        wrong = [k for k in ("normalizer",) if spec.get(k)]
        wrong += [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
            wrong.append("pre_tokenizer")
        wrong += [f"{k} of {t['content']}" for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        if wrong:
            raise ValueError(f"the tokenizer's settings are not those of plain byte-level BPE: {', '.join(wrong)}")

    def _ending(self, data: bytes) -> int:
        """The longest token that ends ``data``."""
        return next(self.token_of[data[n:]] for n in range(len(data)) if data[n:] in self.token_of)

    def _step(self, state: int, byte: int) -> int:
        """The automaton's next state; states are made when they are first reached."""
        read = self.names[state] + bytes([byte])
        name = next(read[n:] for n in range(len(read) + 1) if read[n:] in self.begins)
        if name not in self.states:
            self.states[name] = len(self.names)
            self.names.append(name)
            self.steps.append({})
            self.longest.append(self._ending(name))
        self.steps[state][byte] = self.states[name]
        return self.states[name]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves them as these two tokens.

        Of the two tokens at the border, the one made last is undone, while no merge across the
        border comes before the one undone: merging would have taken that one first.
        """
        before = len(self.joined)  # a merge across the border must not come before this one
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, before = self.halves[left][1], a
            else:  # of two equal merges the left one is made first
                right, before = self.halves[right][0], b + 1

    def _by_prefixes(self, piece: str) -> bytes:
        steps, longest, sizes, fits = self.steps, self.longest, self.sizes, self.fits
        last, state = [-1], 0  # the last token of each prefix
        for end, byte in enumerate(piece.encode("utf-8", "surrogatepass"), 1):
            to = steps[state].get(byte)
            state = self._step(state, byte) if to is None else to
            token = longest[state]
            while start := end - sizes[token]:
                key = last[start] << 20 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 1_000_000:
                        fits.clear()
                    ok = fits[key] = self.compatible(last[start], token)
                if ok:
                    break
                if token not in self.shorter:
                    self.shorter[token] = self._ending(self.bytes_of[token][1:])
                token = self.shorter[token]
            last.append(token)
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        ids.reverse()
        return array("I", ids).tobytes()

    def _spaced(self, word: str) -> bytes | None:
        """The ids of a space and what follows it up to the next one; None if that cut is none of the pattern's."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word.isalpha():  # kept by the caller, so not in ``of_piece`` too
            return self._by_prefixes(" " + word)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self.of_spaced[word[:-1]] + self.of_piece[word[-1]]
        return self.pieces(" " + word)

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.of_piece.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids, 4 bytes each.

        Where single spaces stand between other characters, the pattern cuts before each space,
        so what lies between two such cuts can be looked up as a whole.
        """
        if self.cut is not None and self.cut.search(text):
            return b"".join(pack("<I", self.special[x]) if x in self.special else self.encode(x) for x in self.cut.split(text))
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.pieces(text)
        try:
            return self.pieces(first) + b"".join(map(self.of_spaced.__getitem__, rest))
        except TypeError:  # a space beside other white space
            return self.pieces(text)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@cache
def tokenizer(path: str) -> Bpe:
    """One for each worker process. The file must be at this path on every executor."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` as ``ids_col`` (binary, little-endian unsigned 32-bit)."""
    schema = docs.drop(ids_col).schema.add(ids_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            keep = [n for n in b.schema.names if n != ids_col]
            ids = pa.array([bpe.encode(t.as_py() or "") for t in b.column(b.schema.names.index(text_col))], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(n)) for n in keep], ids], names=[*keep, ids_col])

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: Mapping[str, Column] | None = None, kept_pieces: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row: the digests of the ids and of
    the text decoded from them, and the columns of ``keep`` by name.

    A null text counts as empty: no tokens, and the digests of nothing. Rows with null or repeated
    ids each get their row. Other columns are not read, so their names do not matter. With
    ``kept_pieces`` each task has a tokenizer of its own, whose caches have that bound and which goes with it.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[c.alias(k) for k, c in (keep or {}).items()])
    kept = own.schema.names[2:]
    schema = own.select("doc_id", *kept).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = tokenizer(path) if kept_pieces is None else Bpe(path, kept_pieces), hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):  # one at a time: a batch's texts as Python's are as large again
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=schema.names,
            )
        if kept_pieces is not None:
            del bpe
            give_back()

    return own.mapInArrow(run, schema).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *kept)
