"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document's full
windows are cut off first and emitted at once; the rest goes, uncut, into the
fullest open window that still takes it (best fit).  If none does, the fullest
window is emitted and a new one opened.  What is open at the end is merged:
first within the partition, where pieces are cut to fill windows to the brim,
then, for the one unfilled window of each partition, across partitions in
rounds of ``FAN_IN`` until one task holds all that is left over.

Sequences are padded to the window size, save those whose length is a power of
two; so the very last leftover is split into powers of two.

State is bounded: at most ``OPEN_WINDOWS`` windows of identifiers per task.
Defined results: null text is empty and packs as its end mark alone; repeated
rows are packed each on its own; a null doc_id stays null; an empty table
gives no pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, arrow_schema, doc_rows, release, slabs, staged, table
from .pieces import UNICODE_SPACE, ChunkCache, PieceCache

WINDOW = 2048
OPEN_WINDOWS = 64
FAN_IN = 64
END_ID = 1

#: The split of the vocabulary file's pre-tokenizer, its white space spelled out.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{UNICODE_SPACE}\p{{L}}\p{{N}}]+")


class WordEncoder:
    """Identifiers of whole texts, by the library for each new piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        pieces = PieceCache(self._direct)
        self.chunks = ChunkCache("", _SPLIT.findall, pieces)

    def _direct(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        if not text.isascii():
            # sigma is lowered by position in Python, always alike in the library
            if "Σ" in text:
                return self._direct(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return self._direct(text)
        if "<|" in text and any(s in text for s in self.special):
            return self._direct(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split(" ")))


_WORD_ENCODERS: dict[str, WordEncoder] = {}
HELD["words"] = _WORD_ENCODERS.clear


def word_encoder(path: str) -> WordEncoder:
    if path not in _WORD_ENCODERS:
        _WORD_ENCODERS.clear()
        _WORD_ENCODERS[path] = WordEncoder(path)
    return _WORD_ENCODERS[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = PIECE + ", ids binary, part int"


class Packer:
    """Windows of one task.  A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit, self.next = window, open_windows, first_id
        self.open: list[tuple[int, int, list]] = []  # (used, id, pieces), by used
        self.out: list[tuple] = []

    def _id(self) -> int:
        self.next += 1
        return self.next - 1

    def emit(self, sequence: int, pieces: list) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
            offset += len(ids) // 4

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        size = self.window * 4
        total = len(ids) // 4 if total is None else total
        while len(ids) >= size:
            self.emit(self._id(), [(doc, start, total, ids[:size])])
            ids, start = ids[size:], start + self.window
        if ids:
            self.place((doc, start, total, ids))

    def place(self, piece: tuple) -> None:
        need = len(piece[3]) // 4
        at = bisect_right(self.open, (self.window - need, 1 << 62)) - 1
        if at >= 0:
            used, key, pieces = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                self.emit(*self.open.pop()[1:])
            used, key, pieces = 0, self._id(), []
        pieces.append(piece)
        if used + need == self.window:
            self.emit(key, pieces)
        else:
            insort(self.open, (used + need, key, pieces))

    def leftover(self) -> list[tuple]:
        """Refill the open windows to the brim; the pieces of the last one."""
        rest: list[tuple] = []
        used = 0
        # the fullest windows lose least when topped up from the emptiest
        todo = [p for _, _, pieces in reversed(self.open) for p in pieces]
        self.open = []
        for doc, start, total, ids in todo:
            while ids:
                room = (self.window - used) * 4
                part, ids = ids[:room], ids[room:]
                rest.append((doc, start, total, part))
                start, used = start + len(part) // 4, used + len(part) // 4
                if used == self.window:
                    self.emit(self._id(), rest)
                    rest, used = [], 0
        return rest

    def finish(self, rest: list[tuple]) -> None:
        """Emit what is left as sequences whose lengths are powers of two."""
        left = sum(len(p[3]) // 4 for p in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, total, ids = rest[0]
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, total, ids[: take * 4]))
                room -= take
                rest[0:1] = [(doc, start + take, total, ids[take * 4 :])] if take * 4 < len(ids) else []
            self.emit(self._id(), pieces)


def _batch(schema: pa.Schema, out: list[tuple], rest: list[tuple], part: int) -> pa.RecordBatch:
    rows = [(*r, None, None) for r in out]
    rows += [(d, s, len(i) // 4, None, t, None, None, i, part) for d, s, t, i in rest]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack all texts; one row for each piece."""
    spark = docs.sparkSession
    schema = arrow_schema(spark, OPEN)
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        release("words")
        part = TaskContext.get().partitionId()
        packer, encoder = Packer(part << 32, window, open_windows), word_encoder(vocabulary)
        for b in batches:
            for s in slabs(b):
                for i in range(len(s)):
                    packer.add(s.ids[i], encoder.packed(str(s.raw(i), "utf-8")) + end)
                yield _batch(schema, packer.out, [], part)
                packer.out = []
        rest = packer.leftover()
        yield _batch(schema, packer.out, rest, part)

    done = staged(doc_rows(docs, id_col, text_col).mapInArrow(first, OPEN), "packing")
    finished = done.where("part is null").drop("ids", "part")
    over = done.where("part is not null").select("doc_id", "start", "doc_tokens", "ids", "part")
    n = 1 + (over.agg(F.max("part")).first()[0] or 0)
    level = 1
    while True:
        n = -(-n // FAN_IN)
        last = n == 1
        merged = over.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)")).groupBy("part").applyInArrow(_merger(level, last, window, schema), OPEN)
        if last:
            return finished.unionByName(merged.drop("ids", "part"))
        merged = staged(merged, "packing")
        finished = finished.unionByName(merged.where("part is null").drop("ids", "part"))
        over = merged.where("part is not null").select("doc_id", "start", "doc_tokens", "ids", "part")
        level += 1


def _merger(level: int, last: bool, window: int, schema: pa.Schema):
    def merge(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        packer = Packer((level << 56) + (part << 32), window, 1 << 30)
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
        for doc, start, total, ids in rows:
            packer.place((doc, start, total, ids))
        rest = packer.leftover()
        if last:
            packer.finish(rest)
            rest = []
        return pa.Table.from_batches([_batch(schema, packer.out, rest, part)])

    return merge


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
