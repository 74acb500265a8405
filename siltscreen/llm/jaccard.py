"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

1. Texts become sets of shingle hashes (five words); equal sets are one class, named by a digest.
2. Each class has a MinHash signature.  Classes whose signatures agree in a band are candidates.
   Within a band's bucket, signatures are compared a few values at a time, and a pair is dropped as soon
   as the posterior probability that its similarity reaches the threshold falls below the tolerance.
   Buckets return a spanning forest of the surviving pairs, never the pairs.
3. Components of that forest are clusters.  Their shingle sets are sent there, once a class (once for
   each pair of blocks in a cluster of more than a block), the signatures are compared and pruned again,
   and the survivors are verified exactly.  Blocks return link counts and a spanning forest of links.
4. Components of the links are the groups.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import col, join_checked, stored, utf8, with_text_columns, without
from siltscreen.llm.similar import components, forest, in_blocks, over_groups
from siltscreen.llm.words import shingles, words

THRESHOLD = 0.8
WORDS = 5
BANDS = 24
ROWS = 5
#: Values of a signature that are compared at a time.
STEP = 20
#: A pair is dropped when its chance to reach the threshold is below this.
TOLERANCE = 1e-5
BLOCK = 4096
#: Classes of a cluster that are verified in one place, at most twice.
VERIFY_BLOCK = 768
SEED = 11


@functools.lru_cache(maxsize=2)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signatures(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n permutations over each row's values, its upper 32 bits; rows are not empty."""
    out = np.zeros((len(bounds) - 1, n), np.uint32)
    if not len(values):
        return out
    a, b = _permutations(n)
    for k in range(n):
        hashed = ((values ^ b[k]) * a[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(hashed.astype(np.uint32), bounds[:-1])
    return out


@functools.lru_cache(maxsize=4)
def least_agreement(n: int, step: int, threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared values, the least number of equal ones that a pair must have.

    With a uniform prior the similarity's posterior after m equal values of t is Beta(m + 1, t - m + 1);
    the chance that it is at least the threshold is a sum of binomial terms.
    """
    out = []
    for t in range(step, n + 1, step):
        # P(Beta(m + 1, t - m + 1) >= s) = P(Binomial(t + 1, s) <= m)
        k = np.arange(t + 2)
        log = np.array([lgamma(t + 2) - lgamma(i + 1) - lgamma(t + 2 - i) for i in k]) + k * np.log(threshold) + (t + 1 - k) * np.log1p(-threshold)
        out.append(int(np.searchsorted(np.cumsum(np.exp(log))[: t + 1], tolerance)))
    return np.array(out)


def surviving(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs (left[a], right[b]) of signatures are left when all values have been compared."""
    n = left.shape[1]
    least = least_agreement(n, STEP, threshold, tolerance)
    live = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for i, low in enumerate(range(0, n - STEP + 1, STEP)):
        part = slice(low, low + STEP)
        equal[live] += (left[a[live], part] == right[b[live], part]).sum(axis=1, dtype=np.int32)
        live = live[equal[live] >= least[i]]
        if not len(live):
            break
    return live


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of left and right rows (each pair once) that pruning leaves.

    While many are left, whole columns of signatures are compared; then single pairs.
    """
    n = sig.shape[1]
    least = least_agreement(n, STEP, threshold, tolerance)
    columns = np.ascontiguousarray(sig[right].T)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    same = left is right
    for low in range(0, len(left), 128):
        part = left[low : low + 128]
        equal = np.zeros((len(part), len(right)), np.uint16)
        alive = np.ones(equal.shape, bool)
        if same:
            alive = part[:, None] < right[None, :]
        step = 0
        while step < len(least):
            for k in range(step * STEP, (step + 1) * STEP):
                equal += sig[part, k][:, None] == columns[k][None, :]
            alive &= equal >= least[step]
            step += 1
            if alive.sum() < alive.size // 8:
                break
        i, j = np.nonzero(alive)
        a, b, e = part[i], right[j], equal[i, j].astype(np.int32)
        for later in range(step, len(least)):
            columns_at = slice(later * STEP, (later + 1) * STEP)
            e += (sig[a, columns_at] == sig[b, columns_at]).sum(axis=1, dtype=np.int32)
            go = e >= least[later]
            a, b, e = a[go], b[go], e[go]
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def bucket_forest(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what surviving pairs connect; pairs within a component so far are not compared.

    Each round compares one member with all that are not yet of its component: a bucket of near copies
    is done after one round, and one of unrelated rows takes as many as it has rows.
    """
    n = len(sig)
    parent = np.arange(n)
    edges_a, edges_b = [], []
    same = left is right
    for i in left.tolist():
        others = right[parent[right] != parent[i]]
        if same:
            others = others[others > i]
        if not len(others):
            continue
        hit = surviving(sig, sig, np.full(len(others), i), others, threshold, tolerance)
        if len(hit):
            found = others[hit]
            edges_a.append(np.full(len(found), i))
            edges_b.append(found)
            merged = np.isin(parent, np.unique(parent[found]))
            parent[merged] = parent[i]
    if not edges_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(n, np.concatenate(edges_a), np.concatenate(edges_b))


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have sets with a Jaccard similarity of at least the threshold."""
    if not len(a):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([a, b]))
    if len(a) < 4 * len(used):
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        # Many pairs: the sets as rows of a 0/1 matrix, a slice of the shingles at a time.
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        values = np.concatenate([sets[i] for i in used])
        rows = np.repeat(np.arange(len(used)), size[used])
        _, column = np.unique(values, return_inverse=True)
        often = np.bincount(column)
        keep = often[column] > 1
        rows, column = rows[keep], np.unique(column[keep], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        counts = np.zeros((len(used), len(used)), np.float32)
        width = int(column.max(initial=-1)) + 1
        for low in range(0, width, 4096):
            p, q = np.searchsorted(column, [low, low + 4096])
            grid = np.zeros((len(used), min(4096, width - low)), np.float32)
            grid[rows[p:q], column[p:q] - low] = 1
            counts += grid @ grid.T
        shared = counts[place[a], place[b]].astype(np.int64)
    union = size[a] + size[b] - shared
    # In whole numbers: similarity >= t as shared * 10**6 >= t * 10**6 * union.
    return shared * 1_000_000 >= round(threshold * 1_000_000) * union


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = len(group)
    if group.column("_a")[0].as_py() == group.column("_b")[0].as_py():
        every = np.arange(n)
        return every, every
    side = group.column("_side").to_numpy(zero_copy_only=False)
    return np.flatnonzero(~side), np.flatnonzero(side)


def _keys(group: pa.Table) -> np.ndarray:
    return np.array(group.column("_key").to_pylist(), object)


def _signed(docs: DataFrame, text: str, keep: list[str], n_words: int, n: int, with_sets: bool) -> DataFrame:
    """`keep` and each text's shingle set: its digest, size and signature (the set itself on demand)."""

    def make(column: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(column)
        found = words(data, offsets)
        hashed, bounds = shingles(found.hashes, found.bounds, n_words)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort(hashed, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        hashed, owner = hashed[order], owner[order]
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
        hashed, owner = hashed[new], owner[new]
        bounds = np.searchsorted(owner, np.arange(len(bounds)))
        raw = hashed.tobytes()
        digests = pa.array([hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
        out = [digests, pa.array(np.diff(bounds))]
        if with_sets:
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(raw)])
            return [*out, packed.cast(pa.binary())]
        full = np.flatnonzero(np.diff(bounds) > 0)
        sig = np.zeros((len(column), n), np.uint32)
        sig[full] = signatures(hashed, np.append(bounds[full], len(hashed)), n)
        at = (np.arange(len(column) + 1) * 4 * n).astype(np.int64)
        signed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at), pa.py_buffer(sig.tobytes())])
        return [*out, signed.cast(pa.binary())]

    made = T.StructType().add("_key", T.BinaryType()).add("_len", T.LongType()).add("_set" if with_sets else "_sig", T.BinaryType())
    return with_text_columns(docs, text, make, made, keep)


def groups(
    docs: DataFrame, text: str = "text", row: str = "doc_id", threshold: float = THRESHOLD, n_words: int = WORDS, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE
) -> DataFrame:
    """`_id, n_links, group_id` for each row of `docs` with words and an id.

    `row` may be of any type with an order; `group_id` is the smallest of its group.
    """
    n = bands * rows
    bare = docs.select(col(row).alias("_id"), col(text).alias("_text")).filter("_id is not null and _text is not null")
    # One pass over all texts; later steps read its narrow result.
    members = stored(_signed(bare, "_text", ["_id"], n_words, n, False).filter("_len > 0"))
    classes = stored(members.groupBy("_key").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"), F.any_value("_len").alias("_len"), F.any_value("_sig").alias("_sig")))

    entries = classes.select("_key", F.posexplode(_band_hashes(F.col("_sig"), bands, rows)).alias("_band", "_bucket"))
    sizes = entries.groupBy("_band", "_bucket").agg(F.count("*").alias("_size")).filter("_size > 1")
    placed = in_blocks(entries, sizes, ["_band", "_bucket"], "_key", BLOCK).join(classes.select("_key", "_sig"), "_key")

    def connect(group: pa.Table) -> pa.RecordBatch | None:
        sig = np.frombuffer(b"".join(group.column("_sig").to_pylist()), np.uint32).reshape(len(group), n)
        node, root = bucket_forest(sig, *_sides(group), threshold, tolerance)
        if not len(node):
            return None
        keys = _keys(group)
        return pa.RecordBatch.from_arrays([pa.array(keys[node].tolist(), pa.binary()), pa.array(keys[root].tolist(), pa.binary())], ["a", "b"])

    pair = T.StructType().add("a", T.BinaryType()).add("b", T.BinaryType())
    place = ["_band", "_bucket", "_a", "_b"]
    near = over_groups(placed.select(*place, "_side", "_key", "_sig"), place, connect, pair)
    clusters = components(near).withColumnRenamed("node", "_key").withColumnRenamed("component", "_cluster")

    # Shingle sets are made anew, for classes that have candidates only.
    involved = stored(clusters.join(classes, "_key").select("_key", "_cluster", "_low", "_n", "_len", "_sig"))
    chosen = involved.select(F.col("_low").alias("_id"), F.col("_key").alias("_class"))
    texts = join_checked(bare, chosen, "_id")
    # An id that repeats with other texts joins too; its other texts' digests differ.
    sets = _signed(texts, "_text", ["_class"], n_words, n, True).filter("_class = _key").groupBy("_key").agg(F.any_value("_set").alias("_set"))
    # A cluster counts by its rows or by its shingles, whatever is more, so long texts make smaller blocks.
    weight = F.greatest(F.count("*"), F.ceil(F.sum("_len") / 1024)).alias("_size")
    blocks = in_blocks(involved, involved.groupBy("_cluster").agg(weight), ["_cluster"], "_key", VERIFY_BLOCK)
    together = blocks.select("_cluster", "_a", "_b", "_side", "_key", "_n", "_sig").join(sets, "_key")

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        sig = np.frombuffer(b"".join(group.column("_sig").to_pylist()), np.uint32).reshape(len(group), n)
        a, b = surviving_pairs(sig, *_sides(group), threshold, tolerance)
        if not len(a):
            return None
        shingled = [np.frombuffer(x, np.uint64) for x in group.column("_set").to_pylist()]
        linked = exact_links(shingled, a, b, threshold)
        a, b = a[linked], b[linked]
        number = group.column("_n").to_numpy()
        found = np.zeros(len(group), np.int64)
        np.add.at(found, a, number[b])
        np.add.at(found, b, number[a])
        node, root = forest(len(group), a, b)
        parent = np.arange(len(group))
        parent[node] = root
        hit = np.flatnonzero(found > 0)
        keys = _keys(group)
        return pa.RecordBatch.from_arrays([pa.array(keys[hit].tolist(), pa.binary()), pa.array(found[hit]), pa.array(keys[parent[hit]].tolist(), pa.binary())], ["_key", "_found", "_parent"])

    made = T.StructType().add("_key", T.BinaryType()).add("_found", T.LongType()).add("_parent", T.BinaryType())
    place = ["_cluster", "_a", "_b"]
    found = stored(over_groups(together.select(*place, "_side", "_key", "_n", "_sig", "_set"), place, verify, made))
    counts = found.groupBy("_key").agg(F.sum("_found").alias("_found"))
    roots = components(found.select(F.col("_key").alias("a"), F.col("_parent").alias("b"))).withColumnRenamed("node", "_key")
    linked = stored(roots.join(classes.select("_key", "_low", "_n"), "_key").join(counts, "_key", "left"))
    lowest = linked.groupBy("component").agg(F.min("_low").alias("group_id"))
    groups_of = linked.join(lowest, "component").select("_key", F.coalesce("_found", F.lit(0)).alias("_found"), "group_id")
    answer = classes.select("_key", "_low", "_n").join(groups_of, "_key", "left")
    answer = answer.select("_key", (F.coalesce("_found", F.lit(0)) + F.col("_n") - 1).alias("n_links"), F.coalesce("group_id", "_low").alias("group_id"))
    return members.select("_id", "_key").join(answer, "_key").select("_id", "n_links", "group_id")


def _band_hashes(sig: Column, bands: int, rows: int) -> Column:
    """A 64-bit hash of each band's values."""
    width = 4 * rows
    return F.array(*[F.xxhash64(F.substring(sig, 1 + k * width, width)) for k in range(bands)])


def near_documents(docs: DataFrame, text: str = "text", row: str = "doc_id", **options) -> DataFrame:
    """Add `n_links`, `group_id` and `kept` to each document.

    `n_links` counts the other rows whose shingle sets have a Jaccard similarity of at least the threshold
    (equal ones included), `group_id` is the smallest id reachable by links, `kept` marks the row of that
    id.  Words are runs of digits, a-z (A-Z count as a-z) and characters beyond ASCII; a shingle is five
    of them, a shorter text's words are one shingle.  Null texts and texts without words link with
    nothing; a null id has a null group and is not compared, but kept.  Rows that repeat an id share its
    largest count and smallest group.  Columns named like the results give way to them.
    """
    keep = without(docs, "n_links", "group_id", "kept")
    names = {c: f"_d{i}" for i, c in enumerate(keep)}
    bare = docs.select(*[col(c).alias(n) for c, n in names.items()])
    place = {c.lower(): n for c, n in names.items()}
    ident = F.col(place[row.lower()])
    found = groups(bare, place[text.lower()], place[row.lower()], **options).groupBy("_id").agg(F.max("n_links").alias("_links"), F.min("group_id").alias("_group"))
    out = bare.join(found, ident == F.col("_id"), "left")
    group = F.coalesce("_group", ident)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), group.alias("group_id"), F.coalesce(ident == group, F.lit(True)).alias("kept"))


def _placed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns under their new names, and `_place`, which is the row's own and the same on every read.

    Only filters and projections may lie between a scan and its use: other steps repeat a row's place.
    """
    renamed = [col(c).alias(n) for c, n in names.items()]
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # no file source, or one without row numbers
            file = docs.metadataColumn("_metadata")
            return docs.select(*renamed, F.struct(F.xxhash64(file["file_path"]).alias("f"), file["row_index"].alias("r")).alias("_place"))
    return stored(docs.select(*renamed, F.monotonically_increasing_id().alias("_place")))


def one_of_each(docs: DataFrame, text: str = "text", row: str = "doc_id", **options) -> DataFrame:
    """One document of each group, with its columns as they came: the smallest id, and of repeated rows one.

    Rows are told apart by their file and place in it where `docs` is a scan of files, however the files
    are split; rows of any other table are numbered once and stored with their columns.  Documents
    without words and with a null id stay: null ids come first in the order, by place.
    """
    names = docs.columns
    lower = [c.lower() for c in names]
    bare = _placed(docs, {c: f"_d{i}" for i, c in enumerate(names)})
    ident = F.struct(F.col(f"_d{lower.index(row.lower())}").alias("i"), F.col("_place").alias("p"))
    found = groups(bare.select(ident.alias("_row"), F.col(f"_d{lower.index(text.lower())}").alias("_t")), "_t", "_row", **options)
    gone = stored(found.filter("_id <> group_id").select(F.col("_id.p").alias("_place")))
    return join_checked(bare, gone, "_place", "left_anti").select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
