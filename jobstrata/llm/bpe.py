"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can be the last of
the prefix's encoding: the token that ends there, whose start is a prefix with
a last token of its own, and that can stand next to that token.  Storing this
last token for every prefix gives the encoding by walking back, makes an
append exact (old entries never change) and lets an edit reuse every entry
before it.

Two tokens can be neighbours if the merges of their joined bytes give just
these two tokens; answers are remembered.

Defined results: null counts as empty, an empty text has no identifiers; any
text has an encoding, as all 256 bytes are tokens.  Repeated rows are encoded
alike.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import HELD, doc_rows, map_slabs, table
from .pieces import UNICODE_SPACE, ChunkCache, PieceCache

PAIRS = 500_000


def explicit_space(pattern: str) -> str:
    """The same pattern with white space spelled out, for the regex module."""
    return pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(r"\S", f"[^{UNICODE_SPACE}]").replace(r"\s", f"[{UNICODE_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes byte strings; ``Prefixes`` keeps the table of one string."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self._pairs: dict[tuple[int, int], bool] = {}
        # every end of a token -> the token it is itself, else -1; a token is
        # usable only if its own bytes encode to itself
        self.ends: dict[bytes, int] = {}
        for b, i in ranks.items():
            for k in range(len(b)):
                self.ends.setdefault(b[k:], -1)
        for b, i in ranks.items():
            if len(self.merged(b)) == 1:
                self.ends[b] = i

    def merged(self, data: bytes) -> list[bytes]:
        """Merge by rank, smallest first: the definition, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        ok = self._pairs.get((left, right))
        if ok is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            ok = self.merged(a + b) == [a, b]
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[left, right] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fill last[i], the last token of data[:i], from len(last) on."""
        look, fit = self.ends.get, self.fit
        for end in range(len(last), len(data) + 1):
            start = end - 1
            while start >= 0:
                token = look(data[start:end])
                if token is None:
                    raise ValueError("no token ends this prefix")
                if token >= 0 and (start == 0 or fit(last[start], token)):
                    last.append(token)
                    break
                start -= 1

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ends.get(data, -1)
        if whole >= 0:
            return [whole]
        last = [-1]
        self.extend(data, last)
        return self.walk(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The table of one growing or edited byte string."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; entries up to ``start`` are reused."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        self.encoder.extend(self.data, self.last)

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


class TextEncoder:
    """Whole texts: pattern matches, each encoded separately."""

    def __init__(self, rank_path: str, pattern: str):
        self.core = PrefixEncoder(load_ranks(rank_path))
        self.findall = regex.compile(explicit_space(pattern)).findall
        # two white-space characters in a row, where chunks may not be cut
        self.unsafe = regex.compile(f"[{UNICODE_SPACE}][{UNICODE_SPACE}]").search
        pieces = PieceCache(lambda p: np.array(self.core.encode(p.encode()), "<u4").tobytes())
        self.first, self.rest, self.pieces = ChunkCache("", self.findall, pieces), ChunkCache(" ", self.findall, pieces), pieces

    def packed(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or self.unsafe(text):
            return b"".join(map(self.pieces.__getitem__, self.findall(text)))
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}
HELD["bpe"] = _ENCODERS.clear


def text_encoder(rank_path: str, pattern: str) -> TextEncoder:
    """One encoder for each worker process."""
    key = (rank_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(rank_path, pattern)
    return _ENCODERS[key]


def digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; counts and digests of both."""

    def run(slab) -> dict:
        enc = text_encoder(rank_path, pattern)
        names = _decimals(len(enc.core.bytes_of))
        n, a, b = [], [], []
        for i in range(len(slab)):
            ids = np.frombuffer(enc.packed(str(slab.raw(i), "utf-8")), "<u4").tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(enc.core.decode(ids)).hexdigest())
        return {"doc_id": slab.ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds="bpe")


_NAMES: list[str] = []


def _decimals(n: int) -> list[str]:
    while len(_NAMES) < n:
        _NAMES.append(str(len(_NAMES)))
    return _NAMES


def encoded(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the identifiers themselves (little-endian unsigned 32-bit)."""
    from .common import binary_column

    def run(slab) -> dict:
        enc = text_encoder(rank_path, pattern)
        return {"doc_id": slab.ids, "ids": binary_column([enc.packed(str(slab.raw(i), "utf-8")) for i in range(len(slab))])}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, ids binary", holds="bpe")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
