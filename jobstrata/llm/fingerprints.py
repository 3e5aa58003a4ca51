"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: common
enough to recur, rare enough to tell texts apart.  A text's distinct lexicon
terms, in order, are hashed once for the whole lexicon and once for each of
several random sub-lexicons, drawn at four densities so that texts of any
length have sub-lexicons in which they hold a term or two.  An edit leaves the
hashes of the sub-lexicons alone whose terms it doesn't touch.

At most 1 / LOW times the mean number of distinct terms of a text can have a
document frequency of LOW * N, so the lexicon doesn't grow with the number of
texts.  It is counted before it is broadcast: up to ``LEXICON`` terms are, a
larger one stays a table, and the terms of texts are joined with it.

Defined results: null counts as empty; texts without a lexicon term are
compared by a hash of their bytes; equal texts have equal fingerprints; rows
of equal doc_id follow each other in the order of their texts; a null doc_id
stands last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Slab, arrow_schema, doc_rows, lowered, mix, n_parts, runs, slabs, span_hash, staged, table

LOW, HIGH = 0.0005, 0.1
DENSITIES, SUBSETS = (8, 32, 128, 512), 40
PARTS = len(DENSITIES) * SUBSETS
ENOUGH = 15
#: Terms of a lexicon that is broadcast, at 28 bytes each.
LEXICON = 4_000_000


def terms(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text, in order, and borders."""
    data = lowered(slab.data)
    starts, ends, first = runs(ALNUM[data], slab.offs)
    h = span_hash(data, starts, ends)
    doc = np.repeat(np.arange(len(slab)), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(slab) + 1))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term: hashes of the terms within the band, counted over all texts."""

    def run(batches):
        seen, counts, waiting = [], [], 0

        def merged():
            h, at = np.unique(np.concatenate(seen), return_inverse=True)
            return h, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        def give(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["term", "df"])

        for b in batches:
            for s in slabs(b):
                h, c = np.unique(terms(s)[0], return_counts=True)
                seen.append(h)
                counts.append(c)
                waiting += len(h)
                if waiting > 1_500_000:
                    h, c = merged()
                    if len(h) > 750_000:  # bounded state: the rest is summed after the shuffle
                        yield give(h, c)
                        seen, counts, waiting = [], [], 0
                    else:
                        seen, counts, waiting = [h], [c], len(h)
        if seen:
            yield give(*merged())

    total = docs.count()
    least, most = max(2, int(np.ceil(total * low))), max(2, int(total * high))
    df = docs.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return df.where(F.col("df").between(least, most)).select("term")


def collected(lex: DataFrame, limit: int) -> np.ndarray | None:
    """Sorted hashes of a lexicon; None if it has more than ``limit`` terms."""
    got = lex.limit(limit + 1).toPandas()["term"].to_numpy(np.int64)
    return None if len(got) > limit else np.sort(got.view(np.uint64))


_SALTS = mix(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def members(lex: np.ndarray) -> np.ndarray:
    """(terms, PARTS / 8) bytes: one bit for each sub-lexicon that holds a term."""
    inside = np.zeros((len(lex), PARTS), bool)
    for k in range(PARTS):
        inside[:, k] = mix(lex + _SALTS[k]) % np.uint64(DENSITIES[k // SUBSETS]) == 0
    return np.packbits(inside, axis=1)


#: Odd multiplier of the hash of a list, and its powers as they are needed.
_STEP = 0x9E3779B97F4A7C15


def listed_hash(items: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each owner's list of items: sum of item[r] * _STEP ** r, mixed.

    Owners ascend and an owner's items stand in the order of its list.
    """
    first = np.searchsorted(owner, np.arange(n + 1))
    rank = np.arange(len(items)) - first[owner]
    power = np.ones(int(rank.max()) + 1 if len(rank) else 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumprod(np.full(len(power) - 1, _STEP, np.uint64), out=power[1:])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * power[rank])])
        return mix(sums[first[1:]] - sums[first[:-1]])


def exact_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big")


class Fingerprints:
    """whole: 64-bit hash over the lexicon; parts: (texts, PARTS) sub-lexicon hashes, 0 if empty."""

    def __init__(self, texts: list[bytes], lex: np.ndarray, bits: np.ndarray):
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        slab = Slab(np.frombuffer(b"".join(texts), np.uint8), offs, [None] * len(texts))
        h, first = terms(slab)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.minimum(np.searchsorted(lex, h), max(len(lex) - 1, 0))
        keep = lex[at] == h if len(lex) else np.zeros(len(h), bool)
        self._hash(h[keep], doc[keep], bits[at[keep]], np.array([exact_hash(t) for t in texts], np.uint64))

    @classmethod
    def of_terms(cls, lists: list[np.ndarray], exact: np.ndarray) -> Fingerprints:
        """From the lexicon's terms in each text, and hashes of the texts."""
        out = cls.__new__(cls)
        h = np.concatenate([np.zeros(0, np.uint64), *[np.sort(x) for x in lists]])
        out._hash(h, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), members(h), exact)
        return out

    def _hash(self, h: np.ndarray, doc: np.ndarray, bits: np.ndarray, exact: np.ndarray) -> None:
        n = len(exact)
        self.size = np.bincount(doc, minlength=n)
        self.whole = listed_hash(mix(h), doc, n)
        self.whole[self.size == 0] = exact[self.size == 0]
        term, part = np.nonzero(np.unpackbits(bits, axis=1, count=PARTS)) if len(h) else (np.zeros(0, np.int64),) * 2
        place = doc[term] * PARTS + part
        order = np.argsort(place, kind="stable")  # a list's terms keep their order
        place, term, part = place[order], term[order], part[order]
        total = listed_hash(mix(h[term] ^ _SALTS[part]), place, n * PARTS)
        some = np.zeros(n * PARTS, bool)
        some[place] = True
        self.parts = np.where(some, total & np.uint64(0xFFFF) | np.uint64(1), np.uint64(0)).astype(np.uint16).reshape(n, PARTS)

    def strings(self) -> list[str]:
        a, b = self.whole.astype(">u8").tobytes(), self.parts.astype(">u2").tobytes()
        w = 2 * PARTS
        return [a[8 * i : 8 * i + 8].hex() + b[w * i : w * i + w].hex() for i in range(len(self.whole))]


def likeness(a: Fingerprints, b: Fingerprints, i: slice, j: slice) -> np.ndarray:
    """Share of sub-lexicons with equal hashes, at the sparsest density at
    which enough of them hold a term of either text."""
    x, y = a.parts[i], b.parts[j]
    either = ((x != 0) | (y != 0)).reshape(len(x), len(DENSITIES), SUBSETS)
    same = ((x == y) & (x != 0)).reshape(either.shape)
    out = np.zeros(len(x))
    done = np.zeros(len(x), bool)
    for d in range(len(DENSITIES) - 1, -1, -1):
        n = either[:, d].sum(1)
        use = ~done & (n >= (ENOUGH if d else 1))
        out[use] = same[use, d].sum(1) / n[use]
        done |= use
    equal = a.whole[i] == b.whole[j]
    return np.where(equal, 1.0, out)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, with likenesses."""
    docs = doc_rows(docs, id_col, text_col)
    spark = docs.sparkSession
    found = staged(lexicon(docs), "lexicon")
    lex = collected(found, LEXICON)
    ordered = in_sequence(docs)
    if lex is None:
        return compared_by_join(ordered, found)
    shared = spark.sparkContext.broadcast((lex, members(lex)))
    schema = arrow_schema(spark, RESULT)

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """Rows but the last, each with the one after it."""
        here = [(k, r) for k, r in enumerate(rows[:-1]) if not r[2]]
        own = Fingerprints([r[1].encode() for r in rows], *shared.value)
        texts = [edited(r[1], rows[k + 1][1]).encode() for k, r in here]
        new = Fingerprints(texts, *shared.value)
        at = np.array([k for k, _ in here], np.int64)
        names = own.strings()
        columns = [
            [r[0] for _, r in here],
            [len(r[1]) for _, r in here],
            [hashlib.sha256(t).hexdigest() for t in texts],
            [names[k] for k in at],
            new.strings(),
            likeness(own, new, at, slice(None)),
            likeness(own, own, at, at + 1),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i, t, m in zip(b.column("doc_id"), b.column("text"), b.column("marker"), strict=True):
                t = t.as_py() or ""
                rows.append((i.as_py(), t, m.as_py()))
                size += len(t)
                if size > 1 << 19 and len(rows) > 1:
                    yield work(rows)
                    rows, size = rows[-1:], len(t)
        if len(rows) > 1:
            yield work(rows)

    return ordered.mapInArrow(run, RESULT)


CASES = "uid string, next_uid string, doc_id long, n_chars long, edited_sha256 string, own array<long>, new array<long>, own_hash long, new_hash long, marker boolean"
PRINTED = "uid string, kind int, print string, whole long, parts binary"


def compared_by_join(ordered: DataFrame, lex: DataFrame) -> DataFrame:
    """``compared`` with a lexicon that stays a table.

    The terms of each text and of its edited text are looked up by a join; the
    terms found come back to their text, which hashes them.
    """
    spark = ordered.sparkSession
    cases_schema, printed_schema, schema = (arrow_schema(spark, x) for x in (CASES, PRINTED, RESULT))
    record = lambda rows, names: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(names)], schema=names)

    def listed(texts: list[bytes]) -> list[list[int]]:
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, first = terms(Slab(np.frombuffer(b"".join(texts), np.uint8), offs, [None] * len(texts)))
        return [h[first[k] : first[k + 1]].view(np.int64).tolist() for k in range(len(texts))]

    def cases(batches):
        part, k, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            out = []
            for i, t, m in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("marker").to_pylist(), strict=True):
                row, k = (f"{part}-{k}", i, t or "", m), k + 1
                if last is not None and not last[3]:
                    out.append(case(last, row))
                if m:  # closes its range: only its own fingerprint is asked for
                    out.append(case(row, None))
                last = row
            if out:
                yield record(out, cases_schema)

    def case(row: tuple, after: tuple | None) -> tuple:
        uid, doc, text, marker = row
        new = edited(text, after[2]) if after else text
        own_terms, new_terms = listed([text.encode(), new.encode()])
        signed = lambda t: int(np.array([exact_hash(t.encode())], np.uint64).view(np.int64)[0])
        return (uid, after[0] if after else None, doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own_terms, new_terms, signed(text), signed(new), marker)

    def prints(batches):
        for b in batches:
            hits = [np.array(x or [], np.int64).view(np.uint64) for x in b.column("hits").to_pylist()]
            f = Fingerprints.of_terms(hits, np.array(b.column("exact").to_pylist(), np.int64).view(np.uint64))
            rows = zip(b.column("uid").to_pylist(), b.column("kind").to_pylist(), f.strings(), f.whole.view(np.int64).tolist(), [p.tobytes() for p in f.parts], strict=True)
            yield record(list(rows), printed_schema)

    def liked(batches):
        def side(b, name):
            f = Fingerprints.__new__(Fingerprints)
            f.whole = np.array(b.column(f"{name}_whole").to_pylist(), np.int64)
            f.parts = np.frombuffer(b"".join(b.column(f"{name}_parts").to_pylist()), np.uint16).reshape(-1, PARTS)
            return f

        for b in batches:
            if b.num_rows:
                own, new, after = side(b, "own"), side(b, "new"), side(b, "next")
                near = [likeness(own, x, slice(None), slice(None)).tolist() for x in (new, after)]
                yield record(list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_chars", "edited_sha256", "own_print", "new_print")), *near, strict=True)), schema)

    rows = staged(ordered.mapInArrow(cases, CASES), "cases")
    both = rows.select("uid", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("own").alias("terms"), F.col("own_hash").alias("exact")), F.struct(F.lit(1).alias("kind"), F.col("new").alias("terms"), F.col("new_hash").alias("exact")))).alias("x"))
    both = both.select("uid", "x.kind", "x.terms", "x.exact")
    hits = both.select("uid", "kind", F.explode("terms").alias("term")).join(lex, "term").groupBy("uid", "kind").agg(F.collect_list("term").alias("hits"))
    done = staged(both.select("uid", "kind", "exact").join(hits, ["uid", "kind"], "left").mapInArrow(prints, PRINTED), "prints")
    named = lambda kind, name, key: done.where(F.col("kind") == kind).select(F.col("uid").alias(key), F.col("print").alias(f"{name}_print"), F.col("whole").alias(f"{name}_whole"), F.col("parts").alias(f"{name}_parts"))
    whole = rows.where("not marker").select("uid", "next_uid", "doc_id", "n_chars", "edited_sha256")
    joined = whole.join(named(0, "own", "uid"), "uid").join(named(1, "new", "uid"), "uid").join(named(0, "next", "next_uid").drop("next_print"), "next_uid")
    return joined.mapInArrow(liked, RESULT)


def in_sequence(docs: DataFrame) -> DataFrame:
    """(doc_id, text, marker) in descending doc_id within each partition.

    Ids are dealt to ranges; each range is closed by a marker row, the first
    text of the range that follows (the first range follows the last), so the
    row after a text is always its next text.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = max(4 * n_parts(spark), 8)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("double")
    ids = docs.select("doc_id", key.alias("key"))
    # range borders: at most n of them, whatever the table's size
    cuts = sorted(set(ids.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n)))
    range_of = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="key", outputCol="range") if cuts else None

    def ranged(df: DataFrame) -> DataFrame:
        return (range_of.transform(df) if range_of else df.withColumn("range", F.lit(0.0))).withColumn("range", F.col("range").cast("int"))

    heads = ranged(ids).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    heads = sorted((r["range"], r["doc_id"]) for r in heads)
    # the head of a range closes the range before it in descending order
    closes = [(d, heads[(k + 1) % len(heads)][0]) for k, (_, d) in enumerate(heads)]
    marks = spark.createDataFrame(closes, "head long, closes int")
    rows = ranged(docs.withColumn("key", key)).join(F.broadcast(marks), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    targets = F.when(F.col("closes").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("marker")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("marker")), F.struct(F.col("closes").alias("range"), F.lit(True).alias("marker")))
    )
    rows = rows.select("doc_id", "text", F.explode(targets).alias("t")).select("doc_id", "text", "t.range", "t.marker")
    rows = rows.repartition(n_parts(spark), "range").sortWithinPartitions("range", "marker", F.desc_nulls_last("doc_id"), "text")
    return rows.select("doc_id", "text", "marker")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
