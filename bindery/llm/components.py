"""Connected components by alternating large and small stars, on DataFrames alone.

Each round joins links with the least neighbour of each node; the least neighbours are
pre-aggregated, and the join splits the partitions of nodes with many links. A round's links
are written to the shared folder, so plans stay short and lost executors cost one round. As soon
as no more than SMALL links are left, one task joins them by union and find, with the same result: rounds
over so few links would cost more in tasks than in work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

SMALL = 1 << 15


def _joined(batches):
    """Links a, b -> node, root of every node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum((F.xxhash64("b", "a") % 1000003)).alias("s")).first()
    return r.n, r.x, r.s


def connected_components(links: DataFrame, few: int = SMALL) -> DataFrame:
    """links: a, b (long). Gives node, root for every node of a link; root is the least node."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        if state[0] <= few:
            return now.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, root long")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        was, now = now, written(small, "links")
        dropped(was)
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
