"""Repeated 100-byte strings from merged Burrows-Wheeler transforms.

*Stretches.*  Each window of ``MATCH`` bytes has an anchor: its k-mer with the
least hash, the leftmost of equals.  Consecutive windows with one anchor make a
stretch; equal windows have equal anchors, so a string that repeats does so in
stretches of one anchor.  Stretches that are equal as a whole are collapsed to
their first place, on the map side first (copies never travel in bulk); what
is left are anchors with several different stretches.

*Transforms.*  The stretches of an anchor meet in one task.  They come in
shards; each shard is suffix-sorted on its own and gives its Burrows-Wheeler
transform, over an alphabet of ``GRAM``-byte symbols (every position is a
suffix; a step goes GRAM bytes back).  The shards are merged by refining the
interleave: round h puts all suffixes in the order of their first h symbols by
one stable distribution of the transforms' symbols, without sorting suffixes
anew.  A border between neighbours is set in the round that tells them apart,
so their common prefix is known; after MATCH / GRAM rounds, suffixes without a
border between them share MATCH bytes.  In each such interval the earliest
place stays and the others are covered.

*Marks.*  What is to be covered, or needed for the merge, is kept by range of
documents (doc_id modulo a prime): a row holds many marks, and a range's marks
stand before its documents in one sorted run.

Defined results: null counts as empty; texts shorter than MATCH lose nothing;
rows with a null doc_id are neither searched nor changed; rows that repeat a
doc_id are the same document and must have its text; overlapping repeats
count, as do repeats within one text; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CODE, Slab, arrow_schema, doc_rows, flat, mix, n_parts, release, slabs, span_hash, staged, table, trim

MATCH, KMER, GRAM = 100, 32, 20
SPAN = MATCH - KMER + 1  # k-mers in a window
UNIT_BYTES = 6 << 20  # text after which the map side gives out what it has
SHARD = 1 << 17  # positions of a shard
MERGE = 1 << 19  # positions after which a task merges what it holds, at an anchor's border
HOT = 2000  # different stretches of an anchor beyond which it is split ...
HOTTER = (1, 8, 16)  # ... and of how many times that by the next of the widths
WIDTHS = {2: 35, 3: 12, 4: 1}
PIECE = 4 << 20  # longest part of a text that is scanned at once
_POS = np.uint64((1 << 24) - 1)


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hash of data[i : i + k] at each i, for k a power of two."""
    h = _CODE[data]
    step = 1
    with np.errstate(over="ignore"):
        while step < k:
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
            step *= 2
    return mix(h)


def stretches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, first and last window of each stretch."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < MATCH:
        return none.view(np.uint64), none, none, none
    h = kmer_hashes(data)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & _POS).astype(np.int32)  # anchor of the window that starts here
    size = np.diff(offs)
    room = np.repeat(offs[1:], size)[: len(at)] - np.arange(len(at))
    valid = room >= MATCH
    start = valid.copy()
    start[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(start), np.flatnonzero(end)
    text = np.searchsorted(offs, lo, side="right") - 1
    return mix(h[at[lo]]), text, lo, hi  # least hashes stand close together; buckets are cut from even ones


ENTRY = "bucket int, kind int, anchor binary, body binary, doc binary, lo binary, more binary, many binary"


def entries(docs: DataFrame, buckets: int) -> DataFrame:
    """Stretches of all texts, packed by bucket of their anchor.

    kind 0: anchor, body hash, doc_id, first window, further windows, and
    whether the map side saw more of the same; kind 1: stretches that an
    earlier place repeats as a whole.
    """
    schema = arrow_schema(docs.sparkSession, ENTRY)

    def give(parts: list[tuple], unit: int) -> pa.RecordBatch:
        anchor, body, doc, lo, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lo, doc, body, anchor))
        anchor, body, doc, lo, more = anchor[order], body[order], doc[order], lo[order], more[order]
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])
        head = np.flatnonzero(first)
        many = (np.diff(np.concatenate([head, [len(first)]])) > 1).astype(np.uint8)
        owner = np.repeat(head, np.diff(np.concatenate([head, [len(first)]])))
        twin = ~first & ~((doc == doc[owner]) & (lo == lo[owner]))
        rows = [(buckets + unit % buckets, 1, b"", b"", doc[twin].tobytes(), lo[twin].tobytes(), more[twin].tobytes(), b"")] if twin.any() else []
        anchor, body, doc, lo, more = anchor[first], body[first], doc[first], lo[first], more[first]
        bucket = bucket_of(anchor, buckets)  # ascends with the anchor
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows.append((int(bucket[a]), 0, *(x[a:b].tobytes() for x in (anchor, body, doc, lo, more, many))))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        release()
        parts, size, unit = [], 0, TaskContext.get().partitionId() * 7919
        for b in batches:
            for s in slabs(b):
                for piece, shift in _pieces(s):
                    anchor, text, lo, hi = stretches(piece.data, piece.offs)
                    if len(lo):
                        doc = np.array([i if i is not None else -(2**63) for i in piece.ids], np.int64)[text]
                        ok = doc != -(2**63)
                        body = span_hash(piece.data, lo, hi + MATCH)
                        if ok.any():
                            parts.append((anchor[ok], body[ok], doc[ok], (lo - piece.offs[text] + shift)[ok].astype(np.int32), (hi - lo)[ok].astype(np.uint8)))
                    size += len(piece.data)
                if size >= UNIT_BYTES and parts:
                    yield give(parts, unit)
                    parts, size, unit = [], 0, unit + 1
        if parts:
            yield give(parts, unit)

    return docs.mapInArrow(run, ENTRY)


def _pieces(s: Slab):
    """The slab itself, or overlapping parts of one very long text."""
    if len(s.data) <= PIECE or len(s) > 1:
        yield s, 0
        return
    for a in range(0, max(1, len(s.data) - MATCH + 1), PIECE):
        part = s.data[a : a + PIECE + MATCH - 1]
        yield Slab(part, np.array([0, len(part)], np.int64), s.ids), a


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Marks of a range of documents: kind 1, stretches to cover; other kinds,
#: stretches whose bytes are needed (of anchors to split by the width WIDTHS[kind]).
MARK = "span int, kind int, doc binary, lo binary, more binary, anchor binary"
_DTYPES = (("doc", np.int64), ("lo", np.int32), ("more", np.uint8), ("anchor", np.uint64))
MARKS = 1 << 20  # marks that a task holds before it gives them out


def n_spans(parts: int) -> int:
    """Ranges of documents: a prime, so that ids in any steps are dealt evenly."""
    n = 8 * parts + 1
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 2
    return n


class Marks:
    """Marks of one task, given out by range of documents and kind.

    Rows of a task hold many marks each; there are never more rows than marks.
    """

    def __init__(self, spans: int, schema: pa.Schema):
        self.spans, self.schema, self.parts, self.size = spans, schema, [], 0

    def add(self, kind, doc, lo, more, anchor=None) -> None:
        if len(doc):
            kind = np.full(len(doc), kind, np.uint8) if np.isscalar(kind) else kind.astype(np.uint8)
            self.parts.append((kind, doc, lo.astype(np.int32), more.astype(np.uint8), np.zeros(len(doc), np.uint64) if anchor is None else anchor))
            self.size += len(doc)

    def give(self, least: int = 1):
        if self.size < least or not self.parts:
            return
        kind, doc, lo, more, anchor = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        span = np.mod(doc, self.spans)
        order = np.lexsort((lo, doc, kind, span))
        kind, doc, lo, more, anchor, span = (x[order] for x in (kind, doc, lo, more, anchor, span))
        cut = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (kind[1:] != kind[:-1])]))
        ends = np.concatenate([cut[1:], [len(doc)]])
        for i in range(0, len(cut), 2000):
            pairs = list(zip(cut[i : i + 2000].tolist(), ends[i : i + 2000].tolist(), strict=True))
            first = cut[i : i + 2000]
            columns = [span[first], kind[first]] + [[v[x:y].tobytes() for x, y in pairs] for v in (doc, lo, more)] + [[anchor[x:y].tobytes() if kind[x] != 1 else b"" for x, y in pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def repeated(packed: DataFrame) -> DataFrame:
    """Marks of stretches that an earlier place repeats as a whole, and of such
    whose bytes are needed because their anchor has several different ones."""
    spark = packed.sparkSession
    schema = arrow_schema(spark, MARK)
    spans = n_spans(n_parts(spark))
    rows = packed.repartition(n_parts(spark), "bucket").sortWithinPartitions("bucket")

    def flush(got: list[tuple], marks: Marks) -> None:
        anchor, body, doc, lo, more, _ = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((lo, doc, body, anchor))
        anchor, body, doc, lo, more = (x[order] for x in (anchor, body, doc, lo, more))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_body = new_anchor | np.concatenate([[True], body[1:] != body[:-1]])
        group = np.cumsum(new_anchor) - 1
        bodies_of = np.bincount(group[new_body])[group]
        head = np.flatnonzero(new_body)
        owner = np.repeat(head, np.diff(np.concatenate([head, [len(new_body)]])))
        twin = ~new_body & ~((doc == doc[owner]) & (lo == lo[owner]))
        marks.add(1, doc[twin], lo[twin], more[twin])
        need = new_body & (bodies_of > 1)
        kind = np.select([bodies_of[need] > HOT * x for x in HOTTER[::-1]], [2 + k for k in range(len(HOTTER))][::-1], 0)
        marks.add(kind, doc[need], lo[need], more[need], anchor[need])

    def run(batches):
        marks, got, bucket = Marks(spans, schema), [], None
        for b in batches:
            for k, (number, kind) in enumerate(zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), strict=True)):
                x = [np.frombuffer(b.column(c)[k].as_buffer(), t).copy() for c, t in (("anchor", np.uint64), ("body", np.uint64), ("doc", np.int64), ("lo", np.int32), ("more", np.uint8), ("many", np.uint8))]
                if number != bucket and got:
                    flush(got, marks)
                    got = []
                bucket = number
                if kind:
                    marks.add(1, *x[2:5])
                else:
                    got.append(x)
                yield from marks.give(MARKS)
        if got:
            flush(got, marks)
        yield from marks.give()
        trim()

    return rows.mapInArrow(run, MARK)


class Held:
    """The marks of one range of documents, found by doc_id."""

    def __init__(self):
        self.parts, self.kind = {c: [] for c, _ in _DTYPES}, []

    def add(self, row: dict) -> None:
        for c, t in _DTYPES:
            got = np.frombuffer(row[c], t)
            self.parts[c].append(got if len(got) or c != "anchor" else np.zeros(len(self.parts["doc"][-1]), t))
        self.kind.append(np.full(len(self.parts["doc"][-1]), row["kind"], np.uint8))

    def ready(self) -> Held:
        if self.kind is not None:
            x = {c: np.concatenate(v) if v else np.zeros(0, t) for (c, t), v in zip(_DTYPES, self.parts.values(), strict=True)}
            x["kind"] = np.concatenate(self.kind) if self.kind else np.zeros(0, np.uint8)
            order = np.argsort(x["doc"], kind="stable")
            self.doc, self.lo, self.more, self.anchor, self.kinds = (x[c][order] for c in ("doc", "lo", "more", "anchor", "kind"))
            self.parts, self.kind = {}, None
        return self

    def of(self, doc: int | None) -> slice:
        if doc is None:
            return slice(0, 0)
        return slice(int(np.searchsorted(self.doc, doc)), int(np.searchsorted(self.doc, doc, side="right")))


def _meeting(docs: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """Documents (as ``row``) behind the marks of their range, range by range."""
    spark = docs.sparkSession
    parts = n_parts(spark)
    number = docs[key].cast("long")
    # a row without an id has no marks: any range does
    other = F.xxhash64(*[docs[f"`{c}`"] for c, t in docs.dtypes if "map<" not in t])
    span = F.pmod(F.coalesce(number, other), F.lit(n_spans(parts))).cast("int")
    mark = F.struct("kind", "doc", "lo", "more", "anchor")
    left = marks.select("span", F.lit(0).alias("turn"), mark.alias("mark"), F.lit(None).cast(docs.schema).alias("row"))
    right = docs.select(span.alias("span"), F.lit(1).alias("turn"), F.lit(None).cast(left.schema["mark"].dataType).alias("mark"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return left.unionByName(right).repartition(parts, "span").sortWithinPartitions("span", "turn")


def _met(batches):
    """(documents as struct array, marks of their range) of a task's rows."""
    span, held = None, Held()
    for b in batches:
        spans, turns = b.column("span").to_numpy(), b.column("turn").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (spans[1:] != spans[:-1]) | (turns[1:] != turns[:-1])])) if len(spans) else np.zeros(0, np.int64)
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(spans)], strict=True):
            if spans[x] != span:
                span, held = spans[x], Held()
            if turns[x] == 0:
                for row in b.column("mark").slice(x, y - x).to_pylist():
                    held.add(row)
            else:
                yield b.column("row").slice(x, y - x), held.ready()


BODY = "bucket int, anchor binary, doc binary, lo binary, more binary, bytes binary"


def bodies(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the stretches that are needed, packed by bucket.

    Stretches of hot anchors are split first; parts that are equal as a whole
    stay once in what a task gives out, the later ones (rows without an anchor)
    are covered.
    """
    schema = arrow_schema(docs.sparkSession, BODY)
    rows = _meeting(docs, "doc_id", marks.where("kind <> 1"))

    def give(parts: list[tuple], unit: int) -> pa.RecordBatch:
        anchor, doc, lo, more, split = (np.concatenate([p[k] for p in parts]) for k in range(5))
        texts = [t for p in parts for t in p[5]]
        out, keep = [], np.ones(len(doc), bool)
        first: dict[tuple, int] = {}
        for k in np.flatnonzero(split)[np.lexsort((lo[split], doc[split]))].tolist():
            same = first.setdefault((int(anchor[k]), texts[k]), k)
            keep[k] = same == k
            if same != k and (doc[same], lo[same]) == (doc[k], lo[k]):
                split[k] = False  # the same row once more: neither kept nor covered
        twin = ~keep & split
        if twin.any():
            out.append((unit % buckets, b"", doc[twin].tobytes(), lo[twin].tobytes(), more[twin].tobytes(), b""))
        at = np.flatnonzero(keep)
        order = at[np.argsort(anchor[at], kind="stable")]
        bucket = bucket_of(anchor[order], buckets)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            pick = order[a:b]
            out.append((int(bucket[a]), anchor[pick].tobytes(), doc[pick].tobytes(), lo[pick].tobytes(), more[pick].tobytes(), b"".join([texts[k] for k in pick.tolist()])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        parts, size, unit = [], 0, TaskContext.get().partitionId() * 7919
        for row, held in _met(batches):
            for i, text in zip(row.field("doc_id").to_pylist(), row.field("text"), strict=True):
                want = held.of(i)
                if want.start == want.stop:
                    continue
                raw = text.as_py()
                raw = raw.encode() if raw else b""
                kinds = held.kinds[want]
                for kind in np.unique(kinds).tolist():
                    of = kinds == kind
                    lo, more, anchor = held.lo[want][of], held.more[want][of], held.anchor[want][of]
                    if kind:
                        lo, more, anchor = split_stretches(raw, lo, more, WIDTHS[kind])
                    texts = [raw[s : s + m + MATCH] for s, m in zip(lo.tolist(), more.tolist(), strict=True)]
                    parts.append((anchor, np.full(len(lo), i, np.int64), lo, more, np.full(len(lo), kind > 0), texts))
                    size += sum(map(len, texts))
                if size >= UNIT_BYTES:
                    yield give(parts, unit)
                    parts, size, unit = [], 0, unit + 1
        if parts and size:
            yield give(parts, unit)
        trim()

    return rows.mapInArrow(run, BODY)


def split_stretches(raw: bytes, lo: np.ndarray, more: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of stretches whose anchor stands ``width`` places apart at most,
    keyed by the MATCH - width + 1 bytes that all windows of a part share.

    Equal windows have their anchor at the same place, so they come into parts
    of the same key; a width of one leaves each window on its own.
    """
    size = more.astype(np.int64) + MATCH
    first = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join([raw[s : s + n] for s, n in zip(lo.tolist(), size.tolist(), strict=True)]), np.uint8)
    if first[-1] > int(_POS) // 2:  # places have 24 bits
        half = len(lo) // 2
        return tuple(np.concatenate(x) for x in zip(*(split_stretches(raw, lo[p], more[p], width) for p in (slice(0, half), slice(half, None))), strict=True))
    h = kmer_hashes(data)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    # the anchor is the least k-mer of those that all windows of the stretch hold
    ends = np.minimum(first[:-1] + SPAN, len(key) - 1)
    ranges = np.stack([first[:-1] + more, ends], 1).ravel()
    low = np.minimum.reduceat(key, ranges)[::2]
    low = np.minimum(low, key[np.minimum(first[:-1] + SPAN - 1, len(key) - 1)])
    at = (low & _POS).astype(np.int64)
    top, bottom = at - first[:-1], at - first[:-1] - more  # places of the anchor in the first and last window
    n = top // width - bottom // width + 1
    of = np.repeat(np.arange(len(lo)), n)
    part = bottom[of] // width + np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    high, least = np.minimum(part * width + width - 1, top[of]), np.maximum(part * width, bottom[of])
    start = top[of] - high
    shared = at[of] - part * width, at[of] - np.minimum(part * width + width - 1, SPAN - 1) + MATCH
    keys = span_hash(data, *shared) ^ mix(part.astype(np.uint64) + np.uint64(1))
    return (lo[of] + start).astype(np.int32), (high - least).astype(np.uint8), keys


# --- transforms --------------------------------------------------------------


def _radix(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers below 2^32."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and int(keys.max()) > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Shard:
    """Strings with their suffix order and transform.

    Suffixes are the positions of all strings; each string also has GRAM empty
    suffixes, one for each residue, that stand first in the order, told apart
    by their place.  ``symbols``: the gram at each position, cut at the
    string's end.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        size = np.diff(offs)
        n, strings = len(data), len(size)
        ends = np.repeat(offs[1:], size)
        self.n, self.empty = n, strings * GRAM
        pos = np.arange(n)
        self.symbols = span_hash(data, pos, np.minimum(pos + GRAM, ends))
        self.left = ends - pos
        # where a suffix goes on: GRAM further, or its string's empty suffix
        number = np.repeat(np.arange(strings), size)
        after = pos + GRAM
        after = np.where(after < ends, after + self.empty, number * GRAM + (pos - offs[:-1][number]) % GRAM)
        self.order = self._sorted(after)
        # the transform: the suffix that each suffix, in order, goes back to
        back = np.full(n + self.empty, -1, np.int64)
        back[after] = np.arange(n)
        self.back = back[self.order].astype(np.int32)
        self.order = self.order.astype(np.int32)
        self.left = self.left.astype(np.int32)

    def _sorted(self, after: np.ndarray) -> np.ndarray:
        """Order of all suffixes, empty ones first, by prefix doubling."""
        total = self.n + self.empty
        _, code = np.unique(self.symbols, return_inverse=True)
        rank = np.concatenate([np.arange(self.empty), code + self.empty]).astype(np.int64)
        after = np.concatenate([np.arange(self.empty), after])
        while True:
            key = rank * total + np.where(np.arange(total) < self.empty, 0, rank[after])
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(total, np.int64)
            rank[order] = new
            if int(new[-1]) == total - 1:
                return order
            after = after[after]


def merged_intervals(shards: list[Shard], rounds: int = MATCH // GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (numbered through all shards) in merged order and their interval.

    Suffixes of one interval share ``rounds`` symbols.
    """
    k = len(shards)
    base = np.concatenate([[0], np.cumsum([s.n + s.empty for s in shards])])
    grams = np.unique(np.concatenate([s.symbols for s in shards]))
    # transforms: the symbol before each suffix, in each shard's own order
    transform = np.concatenate([np.where(s.back >= 0, np.searchsorted(grams, s.symbols[s.back]), -1) for s in shards])
    source = np.repeat(np.arange(k, dtype=np.uint16), [s.empty for s in shards])
    n_empty = len(source)
    # round 0: shard after shard, nothing told apart
    interleave = np.concatenate([source, np.repeat(np.arange(k, dtype=np.uint16), [s.n for s in shards])])
    border = np.zeros(len(interleave), bool)
    border[0] = True
    for _ in range(rounds):
        place = np.argsort(interleave, kind="stable")
        symbol = np.empty(len(transform), np.int64)
        symbol[place] = transform
        keep = np.flatnonzero(symbol >= 0)
        symbol, part, group = symbol[keep], interleave[keep], np.cumsum(border)[keep]
        order = _radix(symbol)
        symbol, part, group = symbol[order], part[order], group[order]
        interleave = np.concatenate([source, part])
        border = np.concatenate([np.ones(n_empty, bool), np.ones(min(1, len(symbol)), bool), (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])])
    suffix = np.empty(len(interleave), np.int64)
    suffix[np.argsort(interleave, kind="stable")] = np.concatenate([s.order + b for s, b in zip(shards, base, strict=False)])
    return suffix, np.cumsum(border) - 1


def covered(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, lo: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows of which an earlier one is among the strings."""
    shards, first = [], []
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + shard, side="right")) - 1)
        j = min(j, n)
        shards.append(Shard(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
        first.append(i)
        i = j
    suffix, interval = merged_intervals(shards)
    # back to positions in data; empty and short suffixes go
    kinds = np.concatenate([np.concatenate([np.full(s.empty, -1), np.arange(s.n) + offs[f]]) for s, f in zip(shards, first, strict=True)])
    left = np.concatenate([np.concatenate([np.zeros(s.empty, np.int64), s.left]) for s in shards])
    whole = left[suffix] >= MATCH
    pos, interval = kinds[suffix[whole]], interval[whole]
    string = np.searchsorted(offs, pos, side="right") - 1
    offset = pos - offs[string]
    start = lo[string] + offset
    order = np.lexsort((start, doc[string], interval))
    string, offset, interval, start = string[order], offset[order], interval[order], start[order]
    new = np.concatenate([[True], interval[1:] != interval[:-1]]) if len(interval) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    owner = np.repeat(head, np.diff(np.concatenate([head, [len(new)]])))
    again = (doc[string] != doc[string[owner]]) | (start != start[owner]) if len(new) else new
    return string[again], offset[again]


def repeats_within(packed: DataFrame) -> DataFrame:
    """Marks (kind 1) of the covered windows of the stretches that were compared."""
    spark = packed.sparkSession
    schema = arrow_schema(spark, MARK)
    spans = n_spans(n_parts(spark))
    rows = packed.repartition(n_parts(spark), "bucket").sortWithinPartitions("bucket")

    def flush(rows: list[tuple], marks: Marks) -> None:
        anchor, doc, lo, more = (np.concatenate([r[k] for r in rows]) for k in range(4))
        size = more.astype(np.int64) + MATCH
        offs = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8)
        # strings of an anchor stand together, so that its shards are neighbours
        order = np.argsort(anchor, kind="stable")
        take = np.repeat(offs[:-1][order] - np.concatenate([[0], np.cumsum(size[order])])[:-1], size[order]) + np.arange(len(data))
        data, size, doc, lo = data[take], size[order], doc[order], lo[order].astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(size)])
        anchor = anchor[order]
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        docs, starts = [], []
        i = 0
        while i < len(cut):
            j = max(i + 1, int(np.searchsorted(offs[cut], offs[cut[i]] + MERGE)))
            x, y = cut[i], cut[j] if j < len(cut) else len(anchor)
            string, offset = covered(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], doc[x:y], lo[x:y])
            docs.append(doc[x:y][string])
            starts.append((lo[x:y][string] + offset).astype(np.int32))
            i = j
        d, s = np.concatenate(docs), np.concatenate(starts)
        # runs of covered windows
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1) | (np.arange(1, len(s)) % 128 == 0)]) if len(s) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(new)]]) - 1
        if len(head):
            marks.add(1, d[head], s[head], s[tail] - s[head])

    def run(batches):
        marks, rows, bucket = Marks(spans, schema), [], None
        for b in batches:
            for k, number in enumerate(b.column("bucket").to_pylist()):
                if number != bucket:
                    if rows:
                        flush(rows, marks)
                        yield from marks.give(MARKS)
                        trim()
                    rows, bucket = [], number
                x = [np.frombuffer(b.column(c)[k].as_buffer(), t).copy() for c, t in (("anchor", np.uint64), ("doc", np.int64), ("lo", np.int32), ("more", np.uint8))]
                if len(x[0]):
                    rows.append((*x, b.column("bytes")[k].as_py()))
                else:
                    marks.add(1, *x[1:])
        if rows:
            flush(rows, marks)
        yield from marks.give()
        trim()

    return rows.mapInArrow(run, MARK)


def cover_marks(docs: DataFrame) -> DataFrame:
    """All stretches of windows to cover, by range of documents."""
    spark = docs.sparkSession
    buckets = 4 * n_parts(spark)
    marks = staged(repeated(entries(docs, buckets)), "suffixes")
    inner = staged(repeats_within(bodies(docs, marks, 4 * buckets)), "suffixes")
    return marks.where("kind = 1").unionByName(inner)


def removed_mask(n: int, lo: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which of n bytes are covered."""
    start = lo.astype(np.int64)
    end = np.minimum(start + more + MATCH, n)
    start = np.minimum(start, n)
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is removed from each text, and a digest of what is kept."""
    docs = doc_rows(docs, id_col, text_col)
    rows = _meeting(docs, "doc_id", cover_marks(docs))
    schema = arrow_schema(docs.sparkSession, REMOVED)

    def run(batches):
        for row, held in _met(batches):
            data, offs = flat(row.field("text"))
            out = []
            for k, i in enumerate(row.field("doc_id").to_pylist()):
                raw, mine = data[offs[k] : offs[k + 1]], held.of(i)
                if mine.start < mine.stop and len(raw):
                    gone = removed_mask(len(raw), held.lo[mine], held.more[mine])
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
                else:
                    out.append((i, len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, REMOVED)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = None) -> DataFrame:
    """All rows and columns, with the covered bytes taken out of the text.

    A character that loses one of its bytes goes as a whole; a null text stays
    null; ``n_chars_col``, if given, is counted anew.
    """
    rows = _meeting(docs, id_col, cover_marks(doc_rows(docs, id_col, text_col)))
    text_type = arrow_schema(docs.sparkSession, "x string").field(0).type
    names = docs.columns

    def run(batches):
        for row, held in _met(batches):
            columns = dict(zip(names, row.flatten(), strict=True))
            texts = columns[text_col].to_pylist()
            for k, i in enumerate(columns[id_col].to_pylist()):
                mine = held.of(i)
                if mine.start < mine.stop and texts[k]:
                    raw = np.frombuffer(texts[k].encode(), np.uint8)
                    gone = removed_mask(len(raw), held.lo[mine], held.more[mine])
                    texts[k] = raw[~gone].tobytes().decode("utf-8", "ignore")
            columns[text_col] = pa.array(texts, text_type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    out = rows.mapInArrow(run, docs.schema)
    if n_chars_col:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out


def op9_suffixes(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
