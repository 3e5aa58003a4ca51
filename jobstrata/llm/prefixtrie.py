"""A trie of conversations, rolled up by pointer jumping.

Each distinct sequence of first turns is a node.  A node's key is a digest of
its depth and of the sum of its turns' digests, each taken with its place, so
the keys of all prefixes of a conversation come from running sums, and the key
of a node's parent is known in the node's own row: edges need no join.

Sums over subtrees take a logarithmic number of rounds.  In round k a node
knows its ancestor 2^k levels up and the sums over its descendants less than
2^k levels down.  Adding what the nodes that point to it know, and taking the
pointer's pointer, doubles both.  The root is left out of that: it would be
the pointer of a node of each conversation, and its sums are those of the
whole table.

Large groups: a conversation of any number of turns is dealt into ranges of
its order, and running sums go block by block; a node of any number of members
or children is a partial aggregate; pointers that many nodes share meet joins
that adaptive execution splits.  The list of conversations that end at a node
is made of blocks of ``ENDS`` ids before they travel, and digested as a stream.

Defined results: a null role or text counts as empty; null turns come first,
and equal turns are ordered by their digest, so results don't depend on the
order of rows; repeated rows are turns of their own; rows without a conversation
are left out; conversations without turns are members of the root; an
empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, n_parts, staged, table

#: Turns of a block of running sums; conversation ids of a block of ends.
BLOCK, ENDS = 1024, 4096
#: Nothing at all.
NOTHING = hashlib.sha256().hexdigest()


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest and size of each turn, in order."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        _digest(F.octet_length(word(role_col)).cast("string"), word(role_col), word(text_col)).alias("digest"), F.octet_length(word(text_col)).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = slim.repartitionByRange(n_parts(turns.sparkSession), F.col("conv_id"), *order)
    # a table, so that a range is the same one whenever it is read
    parts = staged(ranged.withColumn("part", F.spark_partition_id()), "turns")
    counts = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    rows = parts.withColumn("place", place).join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    return rows.select("conv_id", (F.col("before") + F.col("place")).alias("pos"), "digest", "size")


def running(turns: DataFrame) -> DataFrame:
    """Keys of each turn's node and its parent's (null: the root), from (conv_id, pos, digest, size)."""
    code = _digest(F.col("pos").cast("string"), F.col("digest"))
    number = lambda at: F.conv(F.substr("code", F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")  # noqa: E731  60 bits
    rows = turns.withColumn("code", code).withColumns({"x": number(1), "y": number(16), "block": F.floor(F.col("pos") / BLOCK)}).drop("code", "digest")
    w = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda c: c.cast("decimal(38,0)")
    inner = rows.withColumns({"sx": F.sum("x").over(w), "sy": F.sum("y").over(w)})
    # only conversations of more than one block have sums before a block
    later = rows.groupBy("conv_id", "block").agg(F.sum("x").alias("bx"), F.sum("y").alias("by"))
    v = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = later.select("conv_id", "block", F.sum("bx").over(v).alias("bx"), F.sum("by").over(v).alias("by")).where("bx is not null")
    both = inner.join(later, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    x, y = whole(F.col("sx")) + F.coalesce(whole(F.col("bx")), zero), whole(F.col("sy")) + F.coalesce(whole(F.col("by")), zero)
    key = lambda depth, a, b: F.substring(F.unhex(_digest(depth.cast("string"), whole(a).cast("string"), whole(b).cast("string"))), 1, 16)
    pos = F.col("pos")
    parent = F.when(pos > 1, key(pos - 1, x - F.col("x"), y - F.col("y")))
    return both.select("conv_id", pos.alias("depth"), "size", key(pos, x, y).alias("key"), parent.alias("parent"))


ENDED = "key binary, ends_sha256 string"


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of each key's conversation ids, ascending, comma-joined.

    Ids are joined in blocks where they lie; a key's blocks then pass one task
    as a stream that holds nothing but the digest's state.
    """
    blocks = ends.groupBy("key", F.floor(F.col("conv_id") / ENDS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    # most keys have one block, which needs no stream
    n = blocks.groupBy("key").agg(F.count("*").alias("n"))
    counted = blocks.join(n, "key")
    few = counted.where("n = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    many = counted.where("n > 1").repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    schema = arrow_schema(ends.sparkSession, ENDED)

    def run(batches):
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(schema)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], schema[0].type), pa.array([state.hexdigest()], schema[1].type)], schema=schema)

    return few.unionByName(many.mapInArrow(run, ENDED))


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """``leaves`` and ``saved`` of nodes (key, parent, leaves, saved), summed over subtrees.

    ``depth``: that of the deepest node; the parents of nodes at the top are null.
    """
    state = nodes.select("key", F.col("parent").alias("up"), "leaves", "saved")
    reach = 1
    while reach < depth:
        told = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        summed = state.join(told, "key", "left").select("key", "up", more("leaves"), more("saved"))
        reach *= 2
        if reach < depth:
            # at most one pointer in 2^k levels leads on, so this side shrinks from round to round
            hops = state.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("next"))
            summed = summed.join(hops, "up", "left").select("key", F.col("next").alias("up"), "leaves", "saved")
        state = staged(summed, f"trie-{reach}")
    return state.select("key", "leaves", "saved")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """All nodes of rebuilt conversations.

    turns: conv_id, pos (1, 2, ...), digest, size; conversations: conv_id and
    n, its number of turns, also of those that have none.
    """
    walked = staged(running(turns).join(conversations.select("conv_id", "n"), "conv_id"), "prefixes")
    grouped = walked.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.first("size").alias("size"), (F.max("n") == F.first("depth")).alias("leaf"),
    )
    nodes = staged(grouped.withColumns({"leaves": F.col("leaf").cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}), "nodes")
    total = nodes.agg(F.max("depth"), F.sum("leaves"), F.sum("saved"), F.count_if(F.col("depth") == 1))
    deepest, leaves, saved, tops = total.first()
    all_ = conversations.agg(F.min("conv_id"), F.count("*")).first()
    sums = subtree_sums(nodes, deepest or 0).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    ends = ends_digest(walked.where("depth = n").select("key", "conv_id"))
    mothers = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = (
        nodes.drop("leaves", "saved").join(sums, "key").join(kids, "key", "left").join(ends, "key", "left").join(mothers, "parent", "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") > 1, F.col("parent_conv_id")).otherwise(F.lit(all_[0])).alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )
    turnless = ends_digest(conversations.where("n = 0").select(F.unhex(F.lit("00")).alias("key"), "conv_id")).select("ends_sha256")
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    spark = turns.sparkSession
    root = spark.createDataFrame([(all_[0], 0, None, all_[1], tops, leaves or 1, saved or 0)] if all_[1] else [], columns.rpartition(",")[0])
    # one row on each side
    root = root.withColumn("one", F.lit(1)).join(turnless.withColumn("one", F.lit(1)), "one", "left").select(*root.columns, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    return root.unionByName(below.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in root.schema]))


def trie_of(table_: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are (conv_id, turn, role, text)."""
    turns = staged(numbered(table_, **columns), "numbered")
    return trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n")))


#: Conversations that share a beginning, and the most turns they may share.
FAMILY, HEADS = 5, 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's rule, on numbered turns: conversation c begins with the first h turns of
    conversation c - c % 5, and goes on with its own turns after its first h; h = crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    lent = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n")), "base", "left").withColumn("lent", lent)
    convs = convs.withColumn("n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "h", "lent", "n"), "conversations")
    rest = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "size")
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = heads.join(convs.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "digest", "size")
    return rest.unionByName(first), convs.select("conv_id", "n")


def op11_prefixtrie(spark, sf_dir: str) -> DataFrame:
    turns = staged(numbered(table(spark, sf_dir, "conversations")), "numbered")
    return trie(*rebuilt(turns))


#: CRC-32 of a decimal number, bit by bit, as DuckDB has no function for it.
_CRC = """xor(list_reduce(list_transform(string_split({c}::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, x:
  list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)), 4294967295::BIGINT), 4294967295)"""

#: DuckDB: a node is the text of its turns' digests; a conversation's nodes below one another are pairs.
OP11_SQL = f"""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS said, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS word FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, sha256(word) AS digest, strlen(said) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(word)) AS pos FROM w),
own AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT o.conv_id, o.conv_id - o.conv_id % 5 AS base, {_CRC.format(c="o.conv_id")} % 9 AS h FROM own o),
r AS (SELECT c.conv_id, pos, digest, size FROM c JOIN t ON t.conv_id = base WHERE pos <= h
  UNION ALL SELECT c.conv_id, pos - h + least(h, coalesce(n, 0)), digest, size FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN own ON own.conv_id = base WHERE pos > h),
l AS (SELECT c.conv_id, count(r.pos) AS len FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1),
a AS (SELECT r.conv_id, pos AS depth, string_agg(digest, '') OVER (PARTITION BY r.conv_id ORDER BY pos) AS key, size, len FROM r JOIN l ON l.conv_id = r.conv_id
  UNION ALL SELECT conv_id, 0, '', 0, len FROM l),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, max(len) = depth AS leaf,
  sha256(coalesce(string_agg(CASE WHEN len = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM a GROUP BY key, depth),
p AS (SELECT DISTINCT x.key AS top, y.key AS sub FROM a x JOIN a y ON y.conv_id = x.conv_id AND y.depth >= x.depth),
s AS (SELECT top, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM p JOIN n ON n.key = sub GROUP BY 1),
k AS (SELECT left(key, 64 * (depth - 1)) AS top, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.key LEFT JOIN k ON k.top = n.key LEFT JOIN n m ON n.depth > 0 AND m.key = left(n.key, 64 * (n.depth - 1))"""
