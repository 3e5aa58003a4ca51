"""BPE encoding and decoding by a contiguous rank array.

A word of the split pattern is held as three flat lists: the borders of its
parts, the identifier of each part, and the rank at which each part may merge
with the next.  The lists are short, so the lowest rank is found by a plain
scan; its border is deleted and the ranks to its left and right are looked up
anew.  Words longer than ``SHORT`` bytes, where repeated scans would cost the
square of the length, go through a heap over the same parts instead.

The merges are those of a vocabulary file in the tokenizers library's format
(byte-level BPE without normalizer); its added tokens are cut out of a text
before it is split, as that library does.

Defined results: null counts as empty, an empty text has no identifiers; a
byte without a token has none; repeated rows are encoded alike; a null doc_id
stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .bpe import explicit_space
from .common import HELD, binary_column, doc_rows, map_slabs, table
from .pieces import UNICODE_SPACE, ChunkCache, PieceCache

#: Words of more bytes than this are merged by a heap.
SHORT = 256
#: The rank of two parts that don't merge.
NEVER = 1 << 62
#: The split of byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable bytes stand for themselves, the rest, in order, for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class RankArray:
    """Merges of a vocabulary; encodes one word of bytes at a time."""

    def __init__(self, vocab: dict[str, int], merges: list, added: list[dict] = ()):
        letter = byte_letters()
        spelt = lambda t: bytes(letter[c] for c in t)
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, i in vocab.items():
            self.bytes_of[i] = spelt(token) if all(c in letter for c in token) else token.encode()
        for t in added:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.width = len(self.bytes_of)
        self.single = [-1] * 256
        for c, b in letter.items():
            self.single[b] = vocab.get(c, -1)
        # two neighbours' identifiers, as one number -> rank; rank -> what they become
        self.rank: dict[int, int] = {}
        self.into: list[int] = []
        for k, pair in enumerate(merges):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.rank[vocab[left] * self.width + vocab[right]] = k
            self.into.append(vocab[left + right])

    def parts(self, word: bytes) -> tuple[list[int], list[int]]:
        """Borders and identifiers of a word's parts after all merges."""
        ids = [i for i in map(self.single.__getitem__, word) if i >= 0]
        if len(ids) > SHORT:
            return self._by_heap(ids)
        rank, width, into = self.rank.get, self.width, self.into
        borders = list(range(len(ids) + 1))
        ranks = [rank(a * width + b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)  # of equal ranks the first
            ids[at] = into[low]
            del ids[at + 1], borders[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(ids[at] * width + ids[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank(ids[at - 1] * width + ids[at], NEVER)
        return borders, ids

    def _by_heap(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """The same for a long word: parts are linked, merges wait in a heap."""
        rank, width, into = self.rank.get, self.width, self.into
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] * width + ids[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] * width + ids[j], NEVER) != r:
                continue  # one of the two has changed since
            ids[i], ids[j] = into[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(ids[i] * width + ids[k], NEVER)) < NEVER:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank(ids[h] * width + ids[i], NEVER)) < NEVER:
                heapq.heappush(heap, (x, h))
        left = [i for i in range(n) if ids[i] >= 0]
        return [*left, n], [ids[i] for i in left]

    def encode(self, word: bytes) -> list[int]:
        return self.parts(word)[1]

    def decode(self, ids) -> str:
        """The text of identifiers; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class TextEncoder:
    """Whole texts: added tokens cut out, the rest split, each word encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take their surroundings aren't supported")
        self.core = RankArray(model["vocab"], model["merges"], added)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(longest) + ")").split if longest else lambda text: [text]
        self.findall = regex.compile(explicit_space(SPLIT)).findall
        self.unsafe = regex.compile(f"[{UNICODE_SPACE}][{UNICODE_SPACE}]").search
        self.pieces = PieceCache(lambda p: np.array(self.core.encode(p.encode()), "<u4").tobytes())
        self.first, self.rest = ChunkCache("", self.findall, self.pieces), ChunkCache(" ", self.findall, self.pieces)

    def packed(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit bytes."""
        if any(t in text for t in self.added):
            return b"".join(self.added.get(part) or self._plain(part) for part in self.cut(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or self.unsafe(text):
            return b"".join(map(self.pieces.__getitem__, self.findall(text)))
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


_ENCODERS: dict[str, TextEncoder] = {}
HELD["rankarray"] = _ENCODERS.clear


def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _texts(slab) -> Iterator[str]:
    return (str(slab.raw(i), "utf-8") for i in range(len(slab)))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and identifiers (little-endian unsigned 32-bit) of every text."""

    def run(slab) -> dict:
        return {"doc_id": slab.ids, "ids": binary_column([text_encoder(path).packed(t) for t in _texts(slab)])}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, ids binary", holds="rankarray")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of identifiers as ``encoded`` gives them."""

    def run(slab) -> dict:
        core = text_encoder(path).core
        return {"doc_id": slab.ids, "text": [core.decode(np.frombuffer(slab.raw(i), "<u4").tolist()) for i in range(len(slab))]}

    return map_slabs(tokens.selectExpr("doc_id", "ids as text"), run, "doc_id long, text string", holds="rankarray")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; counts and digests of both."""

    def run(slab) -> dict:
        enc = text_encoder(path)
        n, a, b = [], [], []
        for text in _texts(slab):
            ids = enc.packed(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(enc.core.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
        return {"doc_id": slab.ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds="rankarray")


def op13_rankarray(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
