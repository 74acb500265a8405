"""Histogram sort into shards: exact counts below key boundaries, refined until splitters are close enough.

Rows are ordered by a hash of their text, then by a hash of their id, so equal texts lie together and yet
a group of any size can be cut; between shards it is cut only where it is larger than that can bear.  Each round counts bytes and rows between evenly spaced boundaries inside
the intervals that still hold a cut, all partitions at once, until every cut is within the tolerance of
its ideal place.  Then one exchange brings every row to its range; a row's slot is the exact number of
rows before its range plus its place there.  DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltscreen.llm.common import col, stored, without

SHARDS = 24
#: Bytes of a row beside its text.
ROW_BYTES = 8
#: Bytes of a range, the unit that one task sorts; a shard is a whole number of ranges.
RANGE_BYTES = 32 << 20
#: How far a cut may be from its ideal place, as a share of a range.
TOLERANCE = 0.002
#: How far a cut between shards may be from there to leave equal texts together, as a share of a shard.
GROUP_TOLERANCE = 0.025
#: Ranges, at most; of a larger table they are larger.  Splitters and offsets are this many small rows.
RANGES = 1 << 16
#: Boundaries that one round counts at, at most: the bound of what comes to the driver.  A round narrows no more
#: intervals than there are ranges, so it always has bits to count.
PROBES = 1 << 20
KEY_BITS = 128
TEXT_BITS = 64
FIRST_BITS = 16
SIGN = -(1 << 63)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def _bits(high: Column, low: Column, start: int, count: int) -> Column:
    """`count` bits from bit `start` of the 128-bit key; keys are signed, their order is that of the flipped bits."""
    out = None
    for word, at in ((high, 0), (low, 64)):
        first, last = max(start, at), min(start + count, at + 64)
        if first >= last:
            continue
        part = F.shiftrightunsigned(word.bitwiseXOR(F.lit(SIGN)), 64 - (last - at))
        if last - first < 64:
            part = part.bitwiseAND(F.lit((1 << (last - first)) - 1))
        out = part if out is None else F.shiftleft(out, last - first).bitwiseOR(part)
    return out


class Cuts:
    """Splitters as 128-bit numbers, with the exact rows below each; ideal places are counted in bytes."""

    def __init__(self, splitters: list[int], rows_below: list[int], total_rows: int, total_bytes: int, rounds: int) -> None:
        self.splitters, self.rows_below = splitters, rows_below
        self.total_rows, self.total_bytes, self.rounds = total_rows, total_bytes, rounds


def _numbers(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A small table of integers (of at most RANGES rows), made from one literal."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast("bigint").alias(n) for n in names])
    text = ";".join(",".join(map(str, r)) for r in rows)
    made = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("_r"))
    values = F.split("_r", ",")
    return made.select(*[F.element_at(values, i + 1).cast("bigint").alias(n) for i, n in enumerate(names)])


def number_of_ranges(total_bytes: int, shards: int, range_bytes: int) -> int:
    """A whole number for each shard, of about `range_bytes` unless that would be more than RANGES."""
    if not 1 <= shards <= RANGES:
        raise ValueError(f"shards must be from 1 to {RANGES}")
    return shards * max(1, min(-(-total_bytes // (shards * range_bytes)), RANGES // shards))


def find_cuts(keys: DataFrame, shards: int, range_bytes: int = RANGE_BYTES, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> Cuts:
    """Splitters between ranges of near equal bytes, for rows `_high, _low, _size`."""
    spark = keys.sparkSession
    depth, width = 0, FIRST_BITS
    open_nodes: dict[int, tuple[int, int]] = {0: (0, 0)}  # prefix: bytes and rows before it
    wanted: dict[int, list[int]] = {}
    done: dict[int, tuple[int, int]] = {}
    total = rows = rounds = 0
    ideal = 0.0
    while open_nodes and depth < KEY_BITS:
        rounds += 1
        digit = _bits(F.col("_high"), F.col("_low"), depth, width).alias("_digit")
        if depth == 0:
            counted = keys.select(F.lit(0).cast("bigint").alias("_node"), digit, "_size")
        else:
            # A prefix is compared as its part in the first word and its part in the second.
            rest = max(0, depth - 64)
            known = [(k, _signed(p >> rest), p & ((1 << rest) - 1)) for k, p in enumerate(sorted(open_nodes))]
            nodes = _numbers(spark, known, ["_node", "_p", "_q"])
            head = _bits(F.col("_high"), F.col("_low"), 0, min(depth, 64))
            tail = _bits(F.col("_high"), F.col("_low"), 64, rest) if rest else F.lit(0).cast("bigint")
            counted = keys.withColumns({"_p": head, "_q": tail}).join(F.broadcast(nodes), ["_p", "_q"]).select("_node", digit, "_size")
        found = counted.groupBy("_node", "_digit").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()
        prefixes = sorted(open_nodes)
        by_node: dict[int, list[tuple[int, int, int]]] = {}
        for r in found:
            by_node.setdefault(prefixes[r._node], []).append((r._digit, r.b, r.n))
        if depth == 0:
            total, rows = sum(r.b for r in found), sum(r.n for r in found)
            ranges = number_of_ranges(total, shards, range_bytes)
            each = ranges // shards
            ideal = total / ranges
            wanted = {0: list(range(1, ranges))}
        following: dict[int, tuple[int, int]] = {}
        waiting: dict[int, list[int]] = {}
        for prefix, (before, rows_before) in open_nodes.items():
            buckets = sorted(by_node.get(prefix, []))
            edges = [(before, rows_before)]
            for _, b, n in buckets:
                edges.append((edges[-1][0] + b, edges[-1][1] + n))
            for cut in wanted[prefix]:
                place = cut * ideal
                at = min(max(0, bisect_right([e[0] for e in edges], place) - 1), max(0, len(buckets) - 1))
                if not buckets:
                    done[cut] = (prefix << (KEY_BITS - depth), rows_before)
                    continue
                lower = (prefix << width) | buckets[at][0]
                shift = KEY_BITS - depth - width
                options = [(abs(edges[at][0] - place), lower << shift, edges[at][1]), (abs(edges[at + 1][0] - place), (lower + 1) << shift, edges[at + 1][1])]
                distance, splitter, below = min(options)
                # At this depth the boundaries on both sides lie between different texts.
                apart = shift == KEY_BITS - TEXT_BITS and cut % each == 0 and distance <= group_tolerance * each * ideal
                if distance <= tolerance * ideal or apart or shift == 0:
                    done[cut] = (splitter, below)
                else:
                    following[lower] = edges[at]
                    waiting.setdefault(lower, []).append(cut)
        depth += width
        open_nodes, wanted = following, waiting
        room = max(1, PROBES // max(1, len(open_nodes))).bit_length() - 1
        width = min(max(1, min(16, room)), (TEXT_BITS if depth < TEXT_BITS else KEY_BITS) - depth)
    order = [done[c] for c in sorted(done)]
    return Cuts([s for s, _ in order], [n for _, n in order], rows, total, rounds)


def _signed(value: int) -> int:
    """A 64-bit pattern as Spark's signed number."""
    return value - (1 << 64) if value >= 1 << 63 else value


def ranged(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Add `_range`, the number of splitters at or below each row's key.

    The first bits of the key find a row of a table of 65,536, which is broadcast; splitters that share
    those bits are compared there.
    """
    shift = KEY_BITS - FIRST_BITS
    inside: dict[int, list[int]] = {}
    for s in cuts.splitters:
        if s & ((1 << shift) - 1):
            inside.setdefault(s >> shift, []).append(s)
    rows, k = [], 0
    for bucket in range(1 << FIRST_BITS):
        while k < len(cuts.splitters) and cuts.splitters[k] <= bucket << shift:
            k += 1
        rows.append((bucket, k))
    flip = 1 << 63
    pairs = [(b, (s >> 64) - flip, (s & ((1 << 64) - 1)) - flip) for b, own in inside.items() for s in own]
    spark = df.sparkSession
    base = _numbers(spark, rows, ["_bucket", "_base"])
    own = _numbers(spark, pairs, ["_bucket", "_h", "_l"]).groupBy("_bucket").agg(F.collect_list(F.struct("_h", "_l")).alias("_cuts"))
    table = base.join(F.broadcast(own), "_bucket", "left")
    key = F.struct(F.col("_high").alias("_h"), F.col("_low").alias("_l"))
    more = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= key)), F.lit(0))
    out = df.withColumn("_bucket", _bits(F.col("_high"), F.col("_low"), 0, FIRST_BITS)).join(F.broadcast(table), "_bucket")
    return out.withColumn("_range", (F.col("_base") + F.greatest(more, F.lit(0))).cast("int")).drop("_bucket", "_base", "_cuts")


def with_keys(docs: DataFrame, text: Column, row: Column) -> DataFrame:
    return docs.withColumns({"_high": F.xxhash64(text), "_low": F.xxhash64(row.cast("string"), F.lit("row")), "_size": text_size(text)})


def shard(docs: DataFrame, text: str = "text", row: str = "doc_id", shards: int = SHARDS, range_bytes: int = RANGE_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """Add `size`, `shard` and `slot`: shards hold near equal bytes, slots are gapless from 0 in each.

    Null texts have no bytes (a row still counts ROW_BYTES).  Equal texts are neighbours, and a
    shard ends before or after them where that moves its end by no more than GROUP_TOLERANCE of a shard; only
    larger groups are cut.  Rows that are equal in text and id have one
    key and stay together; their order among themselves is free.  An empty table gives an empty one.
    Columns named like the results give way to them.
    """
    keep = without(docs, "size", "shard", "slot")
    names = {c: f"_d{i}" for i, c in enumerate(keep)}
    place = {c.lower(): F.col(n) for c, n in names.items()}
    keyed = with_keys(docs.select(*[col(c).alias(n) for c, n in names.items()]), place[text.lower()], place[row.lower()])
    # The rounds read keys and sizes only, which are written once.
    cuts = find_cuts(stored(keyed.select("_high", "_low", "_size")), shards, range_bytes, tolerance)
    ranges = len(cuts.splitters) + 1
    each = max(1, ranges // shards)
    starts = [0, *cuts.rows_below]
    offsets = _numbers(docs.sparkSession, [(r, r // each, starts[r] - starts[r // each * each]) for r in range(ranges)], ["_range", "_shard", "_offset"])
    numbered = ranged(keyed, cuts).withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy("_high", "_low")))
    out = numbered.join(F.broadcast(offsets), "_range")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_size").alias("size"), F.col("_shard").cast("int").alias("shard"), (F.col("_offset") + F.col("_place") - 1).alias("slot"))
