"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley share.

For documents with a set of filters each fails, v(S) counts those that at least one filter of the
coalition S removes.  A part's 2**n coalition counts tell everything: a step of an order removes
v(prefix with it) - v(prefix without it), and the Shapley values are the weights of the additive
game nearest to v, in squares weighted by the Shapley kernel, that shares out v(all) whole.  Its
normal equations are solved in rationals once, for the number of filters, and give whole numbers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.llm.common import col, join_checked, stored

#: The five filters of the query, by letter; each reads the text, COPY stands for the comparison with other documents.
COPY = "copy"
#: White space between words: fixed values.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Filter(NamedTuple):
    letter: str
    #: From the text column, words and distinct words to "the document fails"; COPY: an equal text has a smaller id.
    fails: object


def text_filters() -> list[Filter]:
    """A: under 200 words; B: under half of the words distinct; C: over 2 % capitals; D: marks of code; E: copies."""
    return [
        Filter("A", lambda text, words, kinds: words < 200),
        Filter("B", lambda text, words, kinds: 100 * kinds < 50 * words),
        Filter("C", lambda text, words, kinds: 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text)),
        Filter("D", lambda text, words, kinds: text.rlike("[#$%&*|]")),
        Filter("E", COPY),
    ]


def kernel_solution(n: int) -> tuple[list[list[int]], int]:
    """Whole numbers c[i][S] and a divisor d: the Shapley value of filter i is sum(c[i][S] * v(S)) / d.

    Minimises sum over coalitions S but none and all of k(|S|) * (v(S) - sum of x_i in S)**2 with
    sum(x) = v(all), where k(s) = (n - 1) / (C(n, s) * s * (n - s)).  The normal equations with the
    constraint's multiplier are inverted by elimination over fractions, so nothing is rounded.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, math.comb(n, s) * s * (n - s)) for s in range(1, n)}
    inner = [c for c in range(1, full)]
    rows = [[sum((weight[c.bit_count()] for c in inner if c >> i & 1 and c >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0)])
    size = n + 1
    both = [row + [Fraction(int(i == j)) for j in range(size)] for i, row in enumerate(rows)]
    for k in range(size):
        pivot = next(i for i in range(k, size) if both[i][k])
        both[k], both[pivot] = both[pivot], both[k]
        both[k] = [x / both[k][k] for x in both[k]]
        for i in range(size):
            if i != k and both[i][k]:
                both[i] = [x - both[i][k] * y for x, y in zip(both[i], both[k], strict=True)]
    inverse = [row[size:] for row in both]
    exact = [[Fraction(0)] * (full + 1) for _ in range(n)]
    for i in range(n):
        for c in inner:
            exact[i][c] = sum((inverse[i][j] * weight[c.bit_count()] for j in range(n) if c >> j & 1), Fraction(0))
        exact[i][full] = inverse[i][n]
    divisor = math.lcm(*(x.denominator for row in exact for x in row))
    return [[int(x * divisor) for x in row] for row in exact], divisor


def failures(docs: DataFrame, filters: Sequence[Filter], text: str = "text", doc: str = "doc_id", part: str = "source") -> DataFrame:
    """`_doc`, `_part`, `_mask` (filters that the text itself fails, filter i at bit i), `_digest` of the text. Narrow."""
    body = F.coalesce(col(text), F.lit(""))
    cut = docs.select(col(doc).alias("_doc"), F.coalesce(col(part).cast("string"), F.lit("")).alias("_part"), body.alias("_text"))
    words = cut.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    counted = words.select("*", F.size("_words").cast("bigint").alias("_n"), F.size(F.array_distinct("_words")).cast("bigint").alias("_kinds"))
    bits = [F.when(f.fails(F.col("_text"), F.col("_n"), F.col("_kinds")), 1 << i).otherwise(0) for i, f in enumerate(filters) if f.fails is not COPY]
    return counted.select("_doc", "_part", sum(bits, F.lit(0)).alias("_mask"), F.unhex(F.sha2("_text", 256)).alias("_digest"))


def cells(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter], text: str = "text", doc: str = "doc_id", part: str = "source") -> DataFrame:
    """`_part`, `_mask`, and the rows, good rows and toxic rows that fail exactly these filters: at most 2**n rows a part."""
    good, toxic = (F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"_{c}") for c in ("quality", "toxic"))
    known = stored(labels.select(col(doc).alias("_doc"), "quality", "toxic").filter("_doc is not null").groupBy("_doc").agg(good, toxic))
    # Equal rows are one before any shuffle, so neither copies of a row nor a hot id travel one by one.
    rows = failures(docs, filters, text, doc, part).groupBy("_doc", "_part", "_mask", "_digest").agg(F.count("*").alias("_rows"))
    marked = join_checked(rows, known, "_doc", "left").select(
        "_doc", "_part", "_mask", "_digest", "_rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_quality", "_toxic")]
    )
    copy = sum(1 << i for i, f in enumerate(filters) if f.fails is COPY)
    if copy:
        # A text's rows with its smallest id are first; the struct's second field is how many rows carry that id.
        alike = marked.groupBy("_digest", "_part", "_mask", "_quality", "_toxic").agg(
            F.sum("_rows").alias("_rows"),
            F.sum(F.when(F.col("_doc").isNull(), F.col("_rows")).otherwise(0)).alias("_nameless"),
            F.min(F.when(F.col("_doc").isNotNull(), F.struct("_doc", "_rows"))).alias("_low"),
        )
        kept = stored(alike)
        # Only a text in several such groups needs the smallest id of all of them.
        many = kept.groupBy("_digest").agg(F.min("_low._doc").alias("_first"), F.count("*").alias("_groups")).filter("_groups > 1").drop("_groups")
        joined = kept.join(many, "_digest", "left")
        first = F.coalesce("_first", F.col("_low._doc"))
        alone = F.col("_nameless") + F.when(F.col("_low._doc") == first, F.col("_low._rows")).otherwise(0)
        split = F.array(F.struct(alone.alias("n"), F.col("_mask").alias("m")), F.struct((F.col("_rows") - alone).alias("n"), (F.col("_mask") + copy).alias("m")))
        marked = joined.select("_part", "_quality", "_toxic", F.inline(split)).filter("n > 0").select("_part", "_quality", "_toxic", F.col("n").alias("_rows"), F.col("m").alias("_mask"))
    return marked.groupBy("_part", "_mask").agg(
        F.sum("_rows").alias("n"), F.sum(F.col("_rows") * F.col("_quality")).alias("good"), F.sum(F.col("_rows") * F.col("_toxic")).alias("toxic")
    )


def coalitions(found: DataFrame, n: int) -> DataFrame:
    """`_part`, `total`, and arrays `v`, `good`, `toxic` over all 2**n coalitions: rows that at least one member removes."""
    sets = range(1 << n)

    def removed(column: str) -> Column:
        hit = lambda s: F.sum(F.when(F.col("_mask").bitwiseAND(s) != 0, F.col(column)).otherwise(0))
        return F.array(*[hit(s) for s in sets])

    return found.groupBy("_part").agg(F.sum("n").alias("total"), removed("n").alias("v"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] | None = None, text: str = "text", doc: str = "doc_id", part: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step, with what the step does to the part's documents.

    `kept`, `removed`, `redundant` (fail the step's filter, but went before), `unique_fails` (fail no
    other filter), `good_lost` and `toxic_lost` (removed here, by `labels`), and `shapley`: the
    filter's Shapley value times the number of orders, so the sum of its `removed` over all orders.

    Null text is empty; a null part is the empty string.  Every row counts, repeated ones too.  A row
    fails the copy filter if an equal text (by SHA-256) has a smaller id anywhere in the table; a null
    id is neither smaller nor larger, rows of the smallest id are all first.  An id with several labels
    has a mark if one row of it has.  Empty `docs` gives no rows, empty `labels` zero losses.  Only the
    named columns of `docs` are read, so others may have any name.

    Work: one narrow pass; digests, ids and counts are shuffled, never texts; a group of copies is one
    row for each part and label.  From the coalition counts on there are 2**n numbers a part.
    """
    filters = list(filters or text_filters())
    n = len(filters)
    letters = "".join(f.letter for f in filters)
    full = (1 << n) - 1
    table = coalitions(cells(docs, labels, filters, text, doc, part), n)
    weights, divisor = kernel_solution(n)
    orders_count = math.factorial(n)
    # The solution's rows as an array of arrays; 120 orders times it leave no remainder.
    shares = F.array(*[sum((F.col("v")[s] * c for s, c in enumerate(row) if c), F.lit(0)) * orders_count for row in weights])
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(letters))), ",")
    steps = table.withColumn("_shares", shares).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = lambda k: F.instr(F.lit(letters), F.substring("filter_order", k, 1)) - 1
    bit = lambda k: F.call_function("shiftleft", F.lit(1), place(k))
    before = sum((F.when(F.col("step") > k, bit(F.lit(k))).otherwise(0) for k in range(1, n)), F.lit(0))
    own = place(F.col("step"))
    named = steps.select("*", before.alias("_before"), own.alias("_own"), F.call_function("shiftleft", F.lit(1), own).alias("_bit"))
    after = F.col("_before") + F.col("_bit")
    step = lambda c: F.get(c, after) - F.get(c, F.col("_before"))
    return named.select(
        F.col("_part").alias("part"),
        "filter_order",
        "step",
        (F.col("total") - F.get("v", after)).alias("kept"),
        step("v").alias("removed"),
        (F.get("v", F.col("_bit")) - step("v")).alias("redundant"),
        (F.col("v")[full] - F.get("v", F.lit(full) - F.col("_bit"))).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.expr(f"get(_shares, _own) div {divisor}").alias("shapley"),
    )
