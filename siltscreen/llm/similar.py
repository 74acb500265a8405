"""Block-wise comparison within groups of any size, and connected components, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import bounded_batches, stored, tidy


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a stream that is sorted by them; a run may span batches."""
    carried: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.ones(len(batch), bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        change[0] = last is None or any(c[0] != v for c, v in zip(columns, last, strict=True))
        cuts = [*np.flatnonzero(change).tolist(), len(batch)]
        if cuts[0] > 0:
            carried.append(batch.slice(0, cuts[0]))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if carried:
                yield pa.Table.from_batches(carried)
            carried = [batch.slice(low, high - low)]
        last = [c[-1] for c in columns]
    if carried:
        yield pa.Table.from_batches(carried)


def in_blocks(members: DataFrame, sizes: DataFrame, group: list[str], row: str, block: int) -> DataFrame:
    """Send every pair of blocks of a group to one place: adds `_a, _b` (the pair) and `_side`.

    `sizes` has the group's columns and `_size`, its number of rows.  A group of up to `block` rows is one
    pair (0, 0); a larger one is cut by a hash of `row`, and each row goes once to every pair its block is
    in, so a task never holds more than two blocks whatever the group's size.
    """
    joined = members.join(sizes.select(*group, "_size"), group)
    blocks = F.ceil(F.col("_size") / block).cast("int")
    mine = F.when(blocks <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(row, F.lit("block")), blocks.cast("bigint")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("_block")).alias("_a"), F.greatest(k, F.col("_block")).alias("_b")),
    )
    return joined.withColumns({"_blocks": blocks, "_block": mine}).select("*", F.inline(pairs)).withColumn("_side", F.col("_block") == F.col("_b")).drop("_blocks", "_size")


def over_groups(df: DataFrame, keys: list[str], make: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """`make` on the rows of each group; groups are bounded (see `in_blocks`), and a task has many.

    One exchange by the keys; the rows of a partition are sorted and cut into groups as they stream by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        rows = 0
        for group in sorted_groups(batches, keys):
            if len(group) and (out := make(group)) is not None and len(out):
                ready.append(out)
                rows += len(out)
            if rows > 20_000:
                yield from ready
                ready, rows = [], 0
        yield from ready

    bounded_batches(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a graph on n nodes: each node but the first of its component, and that first."""
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differs = low != high
        left, right, low, high = left[differs], right[differs], low[differs], high[differs]
        if not len(left):
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    node = np.flatnonzero(parent != np.arange(n))
    return node, parent[node]


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """`node, component` (the smallest node reachable) for every node of `edges` (`a, b`, of any type with an order).

    Alternates two steps until nothing changes: link each node's larger neighbours to its smallest one,
    then its smaller ones.  A node's neighbours are never gathered: each step is one minimum by group,
    joined back, so a node that a third of all edges share is a row count, not a list.  The number of
    rounds grows with the logarithm of the longest chain.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        links = stored(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
