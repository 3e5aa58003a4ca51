"""Near-duplicate groups by SuperMinHash, banding and verification.

SuperMinHash gives an element one random rank in each register through a
random permutation that is built up lazily: round j offers j + u (0 <= u < 1)
to the j-th register of the element's permutation.  Ranks within an element
are so tied to each other that estimates vary less than MinHash's, and once
all registers of a set are below j + 1, later rounds can't change it, so most
sets stop after a few rounds.

Plan: equal sets are collapsed first (so exact copies cost one row each);
registers are cut into bands; the sets that share a band are tied to one pivot
each (a star, never all pairs); ties are verified on the full sets; verified
ties become components.  Candidates of different components that can still be
linked (they share a rare enough shingle) are then compared too, without
exception, so no link between candidates is lost; what comes out of that is a
spanning forest of the components that meet, never the linked pairs.

A set has a number (``sid``) of its own and a representative (``rep``), the
least doc_id that holds it.  Links and components are between representatives.

Defined results: null and empty texts have an empty set and are linked with
nothing; rows with equal sets are one group; rows of one doc_id are one
document, linked by any of its texts, and share its answer; a null doc_id is
its own group (component null, kept); other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Slab, arrow_schema, doc_rows, map_slabs, mix, n_parts, slabs, staged, table, trim
from .components import components
from .shingles import set_keys, shingle_sets

ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
#: Likeness of near copies, and what op2's contract asks for.
PERCENT, OP2_PERCENT = 80, 85


def super_minhash(elements: np.ndarray, borders: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (sets, registers) of many sets; inf where a set is empty."""
    n_sets, m = len(borders) - 1, registers
    sig = np.full(n_sets * m, np.inf)
    owner = np.repeat(np.arange(n_sets), np.diff(borders))
    perm = None
    for j in range(m):
        if not len(owner):
            break
        with np.errstate(over="ignore"):
            a = mix(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            b = mix(a ^ np.uint64(0xD6E8FEB86659FD93))
        u = (a >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + ((b >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            register = k
            first_k = k
        else:
            row = np.arange(len(owner))
            register = perm[row, k].copy()
            perm[row, k] = perm[row, j]
            perm[row, j] = register
        np.minimum.at(sig, owner * m + register, j + u)
        live = (sig.reshape(n_sets, m).max(1) >= j + 1)[owner]
        if j == 0:
            if not live.any():
                break
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int16), (int(live.sum()), 1))
            row, first_k = np.arange(len(perm)), first_k[live]
            perm[row, 0], perm[row, first_k] = first_k, 0
        elif not live.all():
            perm = perm[live]
        if not live.all():
            owner, elements = owner[live], elements[live]
    return sig.reshape(n_sets, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) 64-bit keys of the bands, with the band's number mixed in."""
    bits = mix(sig.view(np.uint64)).reshape(len(sig), -1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bits.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = mix(key + bits[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two set keys and the band keys of each row."""

    def run(slab: Slab) -> dict:
        sets, borders = shingle_sets(slab)
        keys = band_keys(super_minhash(sets, borders))
        k1, k2 = set_keys(sets, borders)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
        return {"doc_id": slab.ids, "n_shingles": np.diff(borders), "k1": k1, "k2": k2, "bands": lists}

    return map_slabs(docs, run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>", 1 << 19)


SETS = "sid long, rep long, items binary"


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full sets of the wanted (sid, rep, k1, k2), once each."""
    spark = docs.sparkSession
    rows = docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["rep"]).select(wanted["sid"].alias("doc_id"), "rep", "k1", "k2", "text")
    schema = arrow_schema(spark, SETS)

    def run(batches):
        for batch in batches:
            reps, want1, want2 = (batch.column(c).to_numpy() for c in ("rep", "k1", "k2"))
            at = 0
            for slab in slabs(batch):
                sets, borders = shingle_sets(slab)
                k1, k2 = set_keys(sets, borders)
                here = slice(at, at + len(slab))
                at += len(slab)
                # a doc_id that is repeated with other texts has other sets too
                mine = np.flatnonzero((k1 == want1[here]) & (k2 == want2[here]))
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(slab.ids, np.int64)[mine]), pa.array(reps[here][mine]), pa.array([raw[8 * borders[i] : 8 * borders[i + 1]] for i in mine.tolist()], pa.binary())],
                    schema=schema,
                )

    return rows.mapInArrow(run, SETS).groupBy("sid").agg(F.first("rep").alias("rep"), F.first("items").alias("items"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    la, lb = len(a), len(b)
    if 100 * min(la, lb) < percent * max(la, lb):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (la + lb - common)


def verified(ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of representatives: ties (a, b) of sets that reach the similarity.

    A pivot's set and those tied to it meet in one sorted run of rows, so a
    task holds one pivot at a time.
    """
    spark = ties.sparkSession
    pivot = ties.select(F.col("a").alias("pivot"), F.col("a").alias("sid"), F.lit(0).alias("rank")).distinct()
    other = ties.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), F.lit(1).alias("rank"))
    # a pivot with very many ties is cut into salted runs, each with its pivot
    size = ties.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("pivot"), F.ceil(F.col("n") / RUN).cast("int").alias("runs"))
    other = other.join(size, "pivot").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("runs")).cast("int")).drop("runs")
    pivot = pivot.join(size, "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")
    rows = pivot.unionByName(other).join(sets, "sid").select("pivot", "salt", "rank", "rep", "items")
    rows = rows.repartition(n_parts(spark), "pivot", "salt").sortWithinPartitions("pivot", "salt", "rank", "rep")

    def run(batches):
        key, mine, rep = None, None, None
        for batch in batches:
            out_a, out_b = [], []
            heads = zip(*(batch.column(c).to_pylist() for c in ("pivot", "salt", "rank", "rep")), strict=True)
            for (p, s, r, d), items in zip(heads, batch.column("items"), strict=True):
                now = np.frombuffer(items.as_buffer(), np.uint64)
                if r == 0:
                    key, mine, rep = (p, s), now.copy(), d
                elif key == (p, s) and linked(mine, now, percent):
                    out_a.append(rep)
                    out_b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        trim()

    return rows.mapInArrow(run, "a long, b long")


#: Ties of a pivot in one salted run.
RUN = 500


def rest_links(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between different components, with no pair left out.

    Sets are ordered by how many candidate sets hold a shingle, rarest first.
    Two sets that reach the similarity share one of the first
    n - ceil(percent * n) + 1 shingles of either, so only sets that share such
    a shingle are compared.  Groups of at most ``SMALL`` sets give candidate
    pairs; sets that meet in larger groups are gathered into blobs and compared
    block against block, with the intersection sizes from one matrix product.
    A block gives one link less than components it unites, at most.
    """
    spark = sets.sparkSession
    sized = sets.select("sid", "rep", (F.octet_length("items") / 8).cast("int").alias("n"))
    items = _exploded(sets)
    shared = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    head = (
        items.join(shared, "item")
        .groupBy("sid")
        .agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("common"))
        .join(sized, "sid")
        .withColumn("k", F.expr(f"cast(n - ({percent}L * n + 99) div 100 + 1 - (n - size(common)) as int)"))
        .where("k > 0")
        .select("sid", "rep", "n", F.explode(F.slice("common", 1, F.col("k"))).alias("first"))
        .select("sid", "rep", "n", F.col("first.item").alias("item"))
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    head = staged(head, "minhash")
    groups = head.groupBy("item").agg(F.count("*").alias("g"), F.min("sid").alias("least"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    joined = staged(head.join(groups.select("item", "g", "least"), "item"), "minhash")
    few = joined.where(F.col("g") <= SMALL).repartition(n_parts(spark), "item").sortWithinPartitions("item", "n", "sid")
    ties = few.select("item", "sid", "n", "component").mapInArrow(_pairs(percent), "a long, b long").distinct()
    found_few = verified(ties, sets, percent)

    many = joined.where(F.col("g") > SMALL)
    if many.isEmpty():
        return found_few
    blob = components(many.select(F.col("least").alias("a"), F.col("sid").alias("b")).where("a <> b").distinct())
    known = joined.select("sid", "component", "n").distinct()
    placed = _chunks(staged(blob.select(F.col("id").alias("sid"), F.col("component").alias("blob")).join(known, "sid"), "minhash"))
    near = _near_chunks(placed, percent)
    sides = near.select("blob", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    blocks = placed.join(sides, ["blob", "chunk"]).join(sets, "sid").select("blob", "i", "j", "component", "items")
    found_many = blocks.groupBy("blob", "i", "j").applyInArrow(_block(percent), "a long, b long")
    return found_few.unionByName(found_many)


#: Members of a group up to which its pairs are listed; shingles of a block of
#: sets, and shingles that a set counts for besides its own (so that a block
#: has at most some BLOCK_ITEMS / SET_ITEMS sets).
SMALL, BLOCK_ITEMS, SET_ITEMS = 48, 60_000, 60


def _chunks(members: DataFrame) -> DataFrame:
    """(blob, chunk, component, sid, n): the sets of each blob cut into chunks.

    Sets of about one size stand together, and a component that fills a chunk
    has chunks of its own.  Places come from sums over size classes (a few
    hundred for each blob), so no blob is sorted or numbered as a whole.
    """
    weighed = members.withColumn("w", F.col("n").cast("long") + SET_ITEMS)
    # size classes: the seven leading bits
    weighed = weighed.withColumn("cut", F.greatest(F.lit(0), F.floor(F.log2("n")).cast("int") - 6)).withColumn("class", F.expr("shiftleft(cast(shiftright(n, cut) as long), cut)")).drop("cut")
    sums = weighed.groupBy("blob", "component", "class").agg(F.sum("w").alias("w"))
    mass = sums.groupBy("blob", "component").agg(F.sum("w").alias("mass"))
    sums = sums.join(mass, ["blob", "component"]).withColumn("alone", F.col("mass") >= BLOCK_ITEMS)
    home = F.when(F.col("alone"), F.col("component")).otherwise(F.lit(0)).alias("home")
    sums = sums.select("blob", "component", "class", "w", "alone", home)
    strata = sums.groupBy("blob", "alone", "home", "class").agg(F.sum("w").alias("all_w"))
    order = Window.partitionBy("blob", "alone", "home").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    strata = strata.withColumn("before", F.sum("all_w").over(order) - F.col("all_w"))
    places = sums.join(strata, ["blob", "alone", "home", "class"]).select("blob", "component", "class", "alone", "home", "all_w", "before")
    at = F.col("before") + F.col("all_w") * (F.pmod(F.xxhash64("sid"), F.lit(1 << 30)) / float(1 << 30))
    chunk = F.struct("alone", "home", F.floor(at / BLOCK_ITEMS).cast("int").alias("number"))
    return staged(weighed.join(places, ["blob", "component", "class"]).select("blob", chunk.alias("chunk"), "component", "sid", "n"), "minhash")


def _near_chunks(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of chunks (i, j) of a blob that can hold links not known yet."""
    spans = placed.groupBy("blob", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = spans.select("blob", F.col("chunk").alias("chunk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    sizes = f"100L * hi >= {percent}L * lo2 and 100L * hi2 >= {percent}L * lo"
    united = "chunk.alone and chunk2.alone and chunk.home = chunk2.home"
    return spans.join(other, "blob").where(f"chunk <= chunk2 and {sizes} and not ({united})").select("blob", F.col("chunk").alias("i"), F.col("chunk2").alias("j"))


def _exploded(sets: DataFrame) -> DataFrame:
    """(sid, item) of each set."""

    def run(batches):
        for b in batches:
            ids = b.column("sid").to_numpy()
            blobs = b.column("items").to_pylist()
            for i in range(0, len(ids), 200):
                part = blobs[i : i + 200]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[i : i + 200], [len(x) // 8 for x in part])), pa.array(np.frombuffer(b"".join(part), np.int64))],
                    names=["sid", "item"],
                )

    return sets.mapInArrow(run, "sid long, item long")


def _pairs(percent: int):
    """Pairs of different components within each group of a sorted run."""

    def flush(group: list, out: set) -> None:
        for y in range(1, len(group)):
            d, n, c = group[y]
            for x in range(y - 1, -1, -1):
                e, m, k = group[x]
                if 100 * m < percent * n:
                    break  # sizes ascend
                if c != k:
                    out.add((min(d, e), max(d, e)))

    def give(out: set) -> pa.RecordBatch:
        rows = sorted(out)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        item, group, out = None, [], set()
        for batch in batches:
            for i, d, n, c in zip(*(batch.column(x).to_pylist() for x in ("item", "sid", "n", "component")), strict=True):
                if i != item:
                    flush(group, out)
                    item, group = i, []
                    if len(out) > 100_000:
                        yield give(out)
                        out = set()
                group.append((d, n, c))
        flush(group, out)
        yield give(out)

    return run


def similar(blobs: list[bytes], percent: int) -> np.ndarray:
    """(n, n) whether two of n distinct-item sets reach the similarity."""
    n = np.array([len(x) // 8 for x in blobs], np.int64)
    item = np.frombuffer(b"".join(blobs), np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    _, code, count = np.unique(item, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    owner, code = owner[keep], (np.cumsum(count > 1) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(n), len(n)), np.float32)
    width = max(1, 2_000_000 // max(1, len(n)))
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [c, c + width])
        x = np.zeros((len(n), width), np.float32)
        x[owner[lo:hi], code[lo:hi] - c] = 1
        common += x @ x.T
    out = np.empty(common.shape, bool)
    size = n.astype(np.float64)
    for i in range(0, len(n), 256):
        part = common[i : i + 256].astype(np.float64)
        out[i : i + 256] = (100 + percent) * part >= percent * (size[i : i + 256, None] + size[None, :])
    return out


def forest(near: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links between parts (known components) that near sets unite: a spanning
    forest, so one link less than parts in each tree."""
    order = np.argsort(part, kind="stable")
    names, start = np.unique(part[order], return_index=True)
    near = np.logical_or.reduceat(near[order], start, axis=0)
    near = np.logical_or.reduceat(near[:, order], start, axis=1)
    left = np.ones(len(names), bool)
    out = []
    for root in range(len(names)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & left).tolist()
            left[new] = False
            todo += new
            out += [(int(names[x]), int(names[y])) for y in new]
    return out


def _block(percent: int):
    """Links between the known components of one block of sets, or of two."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("component").to_numpy()
        found = forest(similar(group.column("items").to_pylist(), percent), part)
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return run


def _of_one_document(full: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links between the sets of a doc_id that is repeated with other texts."""
    span = full.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
    several = staged(span.where("lo <> hi").select("doc_id"), "minhash")
    if several.isEmpty():
        return None
    held = full.select("doc_id", "k1", "k2").join(several, "doc_id").distinct().join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    docs = doc_rows(docs, id_col, text_col)
    sig = staged(signatures(docs), "minhash")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = staged(reps.withColumn("sid", F.monotonically_increasing_id()), "minhash")  # written, so the numbers stay
    spread = reps.select("sid", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("sid").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = staged(spread.join(shared, "band").select("pivot", "sid").distinct(), "minhash")
    wanted = members.select("sid").distinct().join(reps.select("sid", "rep", "k1", "k2"), "sid")
    sets = staged(_sets(docs, wanted), "minhash")
    ties = members.where("pivot <> sid").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    links = staged(verified(ties, sets, percent), "minhash")
    same = _of_one_document(full, reps)
    links = links if same is None else links.unionByName(same)
    more = staged(rest_links(sets, components(links), percent), "minhash")
    group = components(links.unionByName(more)).withColumnRenamed("id", "rep")
    named = reps.select("k1", "k2", "rep").join(group, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one document of each group."""
    gone = near_groups(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone.hint("merge"), docs[id_col].cast("long") == gone["gone"], "left_anti")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), OP2_PERCENT)
