"""Cached piece-wise encoding shared by the two tokenizer operators.

A text is cut at single blanks; a chunk (with the blank before it) is a closed
unit of the split patterns used here, so its identifiers can be looked up.
Both lookups, chunk and piece, hold a bounded number of entries and start anew
when full: their size doesn't depend on the input.
"""

from __future__ import annotations

from collections.abc import Callable

#: White space as the pattern's library understands it (fixed values).
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS, PIECES = 700_000, 900_000


class PieceCache(dict):
    """piece -> identifiers as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ChunkCache(dict):
    """chunk without its leading blank -> identifiers of the whole chunk."""

    def __init__(self, lead: str, findall: Callable[[str], list[str]], pieces: PieceCache):
        self.lead, self.findall, self.pieces = lead, findall, pieces

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, self.findall(self.lead + chunk)))
        if len(chunk) <= 48 and "\n" not in chunk:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids
