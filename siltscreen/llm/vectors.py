"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines.

Normalised vectors are projected on random directions; a table's bucket is the floor of a few shifted
projections.  Vectors that share a bucket of any table are compared in double precision.  A bucket of
any size is compared block by block, and a pair counts in the first table that it shares, so partner
counts add up without a list of pairs.  Blocks return one count per vector and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import bounded_batches, col, stored, tidy, without
from siltscreen.llm.similar import components, forest, in_blocks, over_groups

THRESHOLD = 0.9
TABLES = 24
PROJECTIONS = 8
WIDTH = 2.0
BLOCK = 1024
SEED = 20


def missed(threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Chance that a pair exactly at the threshold shares no bucket."""
    from math import erf, exp, pi, sqrt

    r = width / sqrt(2 - 2 * threshold)
    one = erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))
    return (1 - one**projections) ** tables


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors that can link, normalised in double precision, and which rows they are."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    finite = np.isfinite(values)  # a null component reads as NaN
    bad = np.add.reduceat(np.append(~finite, False).astype(np.int64), np.minimum(bounds[:-1], len(values))) if len(lengths) else np.zeros(0)
    bad = np.where(lengths > 0, bad, 1)
    size = int(lengths.max(initial=0))
    grid = np.zeros((len(lengths), size))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    grid[owner, np.arange(len(values)) - bounds[owner]] = np.where(finite, values, 0)
    # Scaled first, so that very large and very small components neither overflow nor vanish.
    peak = np.abs(grid).max(axis=1, initial=0)
    ok = (bad == 0) & (peak > 0)
    grid = grid[ok] / peak[ok][:, None]
    return grid / np.linalg.norm(grid, axis=1, keepdims=True), np.flatnonzero(ok)


def _directions(size: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    return rng.normal(size=(size, tables * projections)), rng.uniform(0, width, tables * projections)


def _buckets(x: np.ndarray, lengths: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """A 32-bit bucket for each table; vectors of different lengths never share one's meaning."""
    out = np.zeros((len(x), tables), np.int32)
    salts = np.random.default_rng(SEED).integers(1, 2**62, projections) | 1
    for n in np.unique(lengths):
        rows = lengths == n
        directions, shifts = _directions(int(n), tables, projections, width)
        cells = np.floor((x[rows, :n] @ directions + shifts) / width).astype(np.int64).reshape(-1, tables, projections)
        mixed = ((cells * salts).sum(axis=2) + int(n) * 0x9E3779B9).astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[rows] = (mixed >> np.uint64(32)).astype(np.uint32).astype(np.int32)
    return out


def _compare(group: pa.Table, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a pair of blocks: links whose first shared table is this one."""
    ids = np.array(group.column("_key").to_pylist(), object)
    packed = group.column("_x").to_pylist()
    # A bucket's code holds the length; should two lengths ever share one, the shorter are filled with zeros.
    longest = max(map(len, packed))
    x = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in packed), np.float64).reshape(len(ids), -1)
    codes = np.frombuffer(b"".join(group.column("_codes").to_pylist()), np.int32).reshape(len(ids), -1)
    side, same = group.column("_side").to_numpy(zero_copy_only=False), group.column("_a")[0].as_py() == group.column("_b")[0].as_py()
    left = np.arange(len(ids)) if same else np.flatnonzero(~side)
    right = np.arange(len(ids)) if same else np.flatnonzero(side)
    links_a, links_b = [], []
    for low in range(0, len(left), 256):
        part = left[low : low + 256]
        i, j = np.nonzero(x[part] @ x[right].T >= threshold)
        a, b = part[i], right[j]
        keep = (a < b) if same else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        first = (codes[a, :table] != codes[b, :table]).all(axis=1) if table else np.ones(len(a), bool)
        links_a.append(a[first])
        links_b.append(b[first])
    return ids, np.concatenate([*links_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*links_b, np.zeros(0, np.int64)]).astype(np.int64)


def links(
    vectors: DataFrame, vec: str = "embedding", row: str = "vec_id", threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """`row`, `n_links`, `component_id`, `kept` for every id; see `near_vectors`."""
    keyed = vectors.select(col(row).alias("_id"), col(vec).cast("array<double>").alias("_v"))

    def hashed(batches):
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.slice(low, 4096)
                x, rows = _matrix(part.column(1))
                lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                codes = _buckets(x, lengths, tables, projections, width)
                packed = [x[i, :n].tobytes() for i, n in enumerate(lengths.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(packed, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(codes), pa.list_(pa.int32()))], ["_id", "_x", "_codes", "_list"])

    bounded_batches(vectors.sparkSession)
    schema = T.StructType().add("_id", T.LongType()).add("_x", T.BinaryType()).add("_codes", T.BinaryType()).add("_list", T.ArrayType(T.IntegerType()))
    usable = keyed.filter("_id is not null and _v is not null").mapInArrow(tidy(hashed), schema)
    # Equal vectors are one class, named by a digest; how many rows it has counts as links.
    usable = usable.withColumn("_key", F.unhex(F.md5("_x")))
    first = {c: F.any_value(c).alias(c) for c in ("_x", "_codes", "_list")}
    classes = stored(usable.groupBy("_key").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"), *first.values()))
    entries = classes.select("_key", F.posexplode("_list").alias("_table", "_bucket"))
    sizes = entries.groupBy("_table", "_bucket").agg(F.count("*").alias("_size")).filter("_size > 1")
    placed = in_blocks(entries, sizes, ["_table", "_bucket"], "_key", block).join(classes.select("_key", "_n", "_x", "_codes"), "_key")

    def compare(group: pa.Table) -> pa.RecordBatch:
        ids, a, b = _compare(group, int(group.column("_table")[0].as_py()), threshold)
        n = group.column("_n").to_numpy()
        found = np.zeros(len(ids), np.int64)
        np.add.at(found, a, n[b])
        np.add.at(found, b, n[a])
        node, root = forest(len(ids), a, b)
        parent = ids.copy()
        parent[node] = ids[root]
        hit = np.flatnonzero(found > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit].tolist(), pa.binary()), pa.array(found[hit]), pa.array(parent[hit].tolist(), pa.binary())], ["_key", "_found", "_parent"])

    made = T.StructType().add("_key", T.BinaryType()).add("_found", T.LongType()).add("_parent", T.BinaryType())
    found = stored(over_groups(placed.select("_table", "_bucket", "_a", "_b", "_side", "_key", "_n", "_x", "_codes"), ["_table", "_bucket", "_a", "_b"], compare, made))
    counts = found.groupBy("_key").agg(F.sum("_found").alias("_found"))
    roots = components(found.select(F.col("_key").alias("a"), F.col("_parent").alias("b"))).withColumnRenamed("node", "_key")
    by_class = stored(classes.select("_key", "_low", "_n").join(counts, "_key", "left").join(roots, "_key", "left").withColumn("component", F.coalesce("component", "_key")))
    lowest = by_class.groupBy("component").agg(F.min("_low").alias("component_id"))
    answer = by_class.join(lowest, "component").select("_key", (F.coalesce("_found", F.lit(0)) + F.col("_n") - 1).alias("n_links"), "component_id")
    # Members find their class by its digest; a class with a third of all rows is split by Spark's skew join.
    return usable.select("_id", "_key").join(answer, "_key").select(F.col("_id").alias(row), "n_links", "component_id")


def near_vectors(vectors: DataFrame, vec: str = "embedding", row: str = "vec_id", **options) -> DataFrame:
    """Add `n_links`, `component_id` and `kept` to each vector.

    `n_links` counts the other rows with a cosine of at least the threshold that hashing has found,
    `component_id` is the smallest id reachable by links, and `kept` marks the row of that id.  A vector
    that is null, zero, or holds a null or non-finite component links with nothing; so does a row whose id
    is null (component null, not kept).  Rows that repeat an id with an equal vector link with each other.
    Columns named like the results give way to them; ids are integers.
    """
    keep = without(vectors, "n_links", "component_id", "kept")
    names = {c: f"_d{i}" for i, c in enumerate(keep)}
    bare = vectors.select(*[col(c).alias(n) for c, n in names.items()])
    found = links(bare, names[vec], names[row], **options).withColumnRenamed(names[row], "_id").groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = bare.join(found, bare[names[row]].cast("bigint") == found["_id"], "left")
    ident = F.col(names[row]).cast("bigint")
    component = F.coalesce("component_id", ident)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(ident == component, F.lit(False)).alias("kept"))
