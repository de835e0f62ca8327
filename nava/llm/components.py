"""Connected components of a link table, by union-find over pieces and alternating large and small stars.

Links are contracted by union-find within bounded pieces. While they are more than one piece holds, rounds of large and small stars follow,
contracted again; their number grows with the logarithm of the largest component. What fits one piece is finished by one union-find
of at most PIECE nodes. Minima are partial aggregates, and a node that holds much of the links finds its minimum in a
broadcast table of at most HEAVY_KEYS rows, so no node's links are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nava.session import ship, stored

#: Nodes that one union-find holds.
PIECE = 500_000
#: Keys of more rows than this, and than the HEAVY_KEYS-th part of all rows, are heavy: under HEAVY_KEYS keys can be.
HEAVY_ROWS = 1_000
HEAVY_KEYS = 100_000


def lookup(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with facts on key, the column size of facts dropped.

    facts has a row for each key, and in size its number of rows, which are total in all. Rows of heavy keys stay where they are and meet a
    broadcast table, which the bounds keep under HEAVY_KEYS rows; the others are joined by shuffle.
    """
    bound = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = facts.where(F.col(size) > bound).drop(size)
    if total <= bound or heavy.isEmpty():
        return rows.join(facts.drop(size), key)
    light = facts.where(F.col(size) <= bound).drop(size)
    heavy = F.broadcast(heavy)
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def forest(most: int):
    """A spanning star for each component within pieces of at most some nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while (up := parent[x]) != root:
                parent[x], x = root, up
            return root

        def flush() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in list(parent)]
            pairs = [(x, r) for x, r in pairs if x != r]
            parent.clear()
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                if len(parent) >= most:
                    yield flush()
        if parent:
            yield flush()

    return run


def stars(edges: DataFrame, total: int) -> DataFrame:
    """One round: larger neighbours move to the smallest neighbour, then smaller neighbours and the node itself do."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "large-least")
    large = lookup(both, least, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = stored(large, "large-star")
    least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small-least")
    small = lookup(large, least, "u", "n", total).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, piece: int | None = None) -> DataFrame:
    """node, component (its smallest node) for every node of the links a, b."""
    piece = piece or PIECE
    ship(links.sparkSession)
    schema = "a long, b long"
    edges = stored(links.select("a", "b").where("a <> b").mapInArrow(forest(piece), schema), "links")
    before, total = None, edges.count()
    while 2 * total > piece:
        edges = stored(stars(edges, total).mapInArrow(forest(piece), schema).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    else:
        edges = stored(edges.repartition(1).mapInArrow(forest(piece + 1), schema), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
