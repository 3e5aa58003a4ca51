"""Connected components of a table of links, by union-find over partitions.

Every task runs union-find on the links it has at hand, which leaves one link
(root, node) for each node it has seen.  A round then joins what different
tasks know: the parents of a node meet at the least of them, and a parent
gives way to its own.  Rounds go on until every node hangs at a root.  Both
steps are a minimum by key and joins against it, so a root with a third of all
nodes is no single task's load.

Defined results: a link of a node with itself, or one that is repeated, changes
nothing; nodes without links aren't in the result; an empty table has none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _forest(batches):
    """Union-find over a task's links: (root, node) for each node not a root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounded state: give out what is known and begin anew
            yield _links(parent, find)
            parent.clear()
    yield _links(parent, find)


def _links(parent: dict[int, int], find) -> pa.RecordBatch:
    nodes = [x for x in parent if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([parent[x] for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each node: component is the least id it reaches.

    ``links`` has columns a and b; direction and repeats don't matter.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    links = staged(links.mapInArrow(_forest, "a long, b long").distinct(), "components")
    while True:
        parent = links.groupBy("b").agg(F.min("a").alias("p"), F.count("*").alias("n"))
        # done when each node has one parent and no parent has a parent
        if parent.where("n > 1").isEmpty() and links.join(parent.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        parent = parent.drop("n")
        # a node's parents all meet at the least of them ...
        met = links.join(parent, "b").select("p", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).where("p <> x").distinct()
        # ... which gives way to its own parent; a root with very many nodes is
        # the large side of a join that can be split, not a group
        up = parent.select(F.col("b").alias("p"), F.col("p").alias("pp"))
        links = met.join(up, "p", "left").select(F.coalesce("pp", "p").alias("a"), F.col("x").alias("b"))
        # the link from the parent to its own parent stays in place of p
        links = links.unionByName(parent.select(F.col("p").alias("a"), "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = staged(links.mapInArrow(_forest, "a long, b long").distinct(), "components")
    roots = links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return roots.unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("component")))
