"""Ranked lexical search: short posting lists summed first, long ones walked document by document.

Texts are read once, into postings of the queries' terms.  Each task then takes its postings in
shards and answers every query there.  A query's short lists are summed into accumulators, sorted by
document, which from then on are one list with bounds of its own.  The long lists and that list are
walked together in ascending document id: a block of documents whose bounds (the largest entry of each
list in the block) cannot beat the tenth best score so far is skipped whole, and within a block the
lists are added from the largest bound down until no document can still get there.

Scores are whole numbers, see `ranked`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import bounded_batches, col, shared_path, stored, tidy, utf8, with_text_columns
from siltscreen.llm.words import words

#: Pairs of a query and a term that go along to the tasks at once; more queries are answered in blocks of about this size.
BLOCK_PAIRS = 200_000
#: Postings and documents of a shard, at most; a document with more postings is a shard of its own.
SHARD_POSTINGS, SHARD_ROWS = 2_000_000, 1 << 16
#: Documents that are skipped or scored together.
SPAN = 128
#: A list with entries for at most this share of a shard's documents is short.
SHORT = 1 / 16

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query_terms(queries: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """`_item, _term`: each item's different terms; several rows of one item are one query."""
    found = F.regexp_extract_all(F.translate(col(text), *LETTERS), F.lit(TERM), 0)
    return queries.select(col(item).alias("_item"), F.explode(found).alias("_term")).distinct()


class Plan(NamedTuple):
    """Queries of a block as term numbers, and the terms' hashes in ascending order."""

    hashes: np.ndarray
    queries: list[np.ndarray]


def term_hashes(terms: list[str]) -> np.ndarray:
    return words(*utf8(pa.array(terms, pa.string()))).hashes


def postings(docs: DataFrame, hashes: np.ndarray, text: str, doc: str) -> DataFrame:
    """`_doc`, `_n` (terms with repeats), `_terms` and `_tfs` (the terms among `hashes`, by number, and their counts). Narrow.

    Terms are told apart by 64-bit hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def make(column: pa.Array) -> list[pa.Array]:
        known = shared.value
        found = words(*utf8(column))
        counts = np.diff(found.bounds)
        at = np.searchsorted(known, found.hashes)
        at[at == len(known)] = 0
        mine = known[at] == found.hashes if len(known) else np.zeros(len(at), bool)
        keys, tf = np.unique(found.rows[mine] * max(len(known), 1) + at[mine], return_counts=True)
        rows, terms = np.divmod(keys, max(len(known), 1))
        bounds = pa.array(np.searchsorted(rows, np.arange(len(column) + 1)).astype(np.int32))
        made = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (terms, tf)]
        return [pa.array(counts.astype(np.int64)), *made]

    fields = T.StructType().add("_n", T.LongType()).add("_terms", T.ArrayType(T.IntegerType())).add("_tfs", T.ArrayType(T.IntegerType()))
    return with_text_columns(docs.select(col(doc).alias("_doc"), col(text).alias("_text")), "_text", make, fields, ["_doc"])


class Corpus(NamedTuple):
    """Documents with a term, all their terms, and each query term's weight."""

    documents: int
    terms: int
    weights: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m = 100 - 90 + ((90 * n * N) div L), in whole numbers of any size."""
        values, back = np.unique(n, return_inverse=True)
        return np.array([10 + 90 * int(v) * self.documents // self.terms for v in values], np.int64)[back]


def corpus(index: DataFrame, terms: int) -> Corpus:
    """Counts over the whole index; as many rows as there are query terms come to the driver."""
    row = index.filter("_n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("l")).first()
    df = np.zeros(terms, np.int64)
    for r in index.select(F.explode("_terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * row.n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    return Corpus(row.n, row.l, weights)


class Lists:
    """A shard's posting lists: documents by place in ascending id, and what each entry adds to a score."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray, stats: Corpus):
        self.rows = len(n)
        self.spans = -(-self.rows // SPAN)
        place = np.repeat(np.arange(self.rows), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        tf = tf[order].astype(np.int64)
        self.docs = place[order]
        self.terms = terms[order]
        self.adds = stats.weights[self.terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * stats.lengths(n)[self.docs]))
        self.starts = np.searchsorted(self.terms, np.arange(len(stats.weights) + 1))
        self.long = functools.cache(self._long)

    def entries(self, term: int) -> slice:
        return slice(self.starts[term], self.starts[term + 1])

    def _long(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A list's largest entry in each span, and where each span's entries begin."""
        return bounds_of(self.docs[self.entries(term)], self.adds[self.entries(term)], self.spans)

    def best(self, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the `top` documents of a query, best first, equal scores by place."""
        sizes = self.starts[query + 1] - self.starts[query]
        query, sizes = query[sizes > 0], sizes[sizes > 0]
        few = sizes <= SHORT * self.rows
        walked = [(self.docs[self.entries(t)], self.adds[self.entries(t)], *self.long(int(t))) for t in query[~few]]
        short = [self.entries(t) for t in query[few]]
        if short:
            docs, adds = sums(np.concatenate([self.docs[s] for s in short]), np.concatenate([self.adds[s] for s in short]))
            walked.append((docs, adds, *bounds_of(docs, adds, self.spans)))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not walked:
            return places, scores
        tops = np.stack([w[2] for w in walked])
        bound, least = tops.sum(0), 0
        for span in range(self.spans):
            if bound[span] <= least:
                continue
            total = np.zeros(min(SPAN, self.rows - span * SPAN), np.int64)
            rest = int(bound[span])
            for i in np.argsort(-tops[:, span], kind="stable"):
                if not tops[i, span] or int(total.max()) + rest <= least:
                    break
                docs, adds, _, begins = walked[i]
                part = slice(begins[span], begins[span + 1])
                total[docs[part] - span * SPAN] += adds[part]
                rest -= int(tops[i, span])
            found = np.flatnonzero(total > least)
            if len(found):
                places, scores = np.append(places, found + span * SPAN), np.append(scores, total[found])
                order = np.lexsort((places, -scores))[:top]
                places, scores = places[order], scores[order]
                least = int(scores[-1]) if len(scores) == top else 0
        return places, scores


def bounds_of(docs: np.ndarray, adds: np.ndarray, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest entry of a list in each span of documents (0 without entries), and where each span's entries begin."""
    begins = np.searchsorted(docs, np.arange(spans + 1) * SPAN)
    full = np.flatnonzero(begins[1:] > begins[:-1])
    tops = np.zeros(spans, np.int64)
    if len(full):
        tops[full] = np.maximum.reduceat(adds, begins[full])
    return tops, begins


def sums(docs: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators: every document once, ascending, with the sum of its entries."""
    order = np.argsort(docs, kind="stable")
    docs, adds = docs[order], adds[order]
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    return docs[first], np.add.reduceat(adds, first)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, and cut where a shard would be too large."""
    held, rows, size = [], 0, 0
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
        low = 0
        while low < batch.num_rows:
            fit = int(np.searchsorted(ends, ends[low] + SHARD_POSTINGS - size, "right")) - 1
            high = max(min(fit, low + SHARD_ROWS - rows, batch.num_rows), low + (not held))
            if high > low:
                held.append(batch.slice(low, high - low))
                rows, size = rows + high - low, size + int(ends[high] - ends[low])
            if high < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
            low = high
    if held:
        yield pa.Table.from_batches(held)


def ranked(
    docs: DataFrame, queries: DataFrame, top: int = 10, text: str = "text", doc: str = "doc_id", item: str = "item_id", block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """Each item's `top` highest-scoring documents with a score above 0: the item's column, `rank`, the id's column, `score`.

    Terms are runs of digits, letters and characters beyond ASCII, only A-Z lower-cased.  N documents
    have a term, L terms in all; a document's n terms give m = 100 - 90 + (90 * n * N) div L, a term in
    df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and a document scores the sum of
    w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's terms.  Equal scores go by ascending id,
    null ids last.

    Every row of `docs` is a document, repeated ones too; null and empty texts have no terms and never
    rank, nor count.  Rows of one item (a null item is one too) are one query; an item without terms, or
    without a document, has no row; empty tables give none.  Other columns are not read.  Ids are whole
    numbers; item ids any type.

    Queries go along in blocks of about `block_pairs` items' terms; each block reads the texts once and
    stores its postings in the shared folder.  Every shard gives `top` rows an item, of which Spark
    keeps the best before and after one shuffle.
    """
    if not isinstance(docs.schema[doc].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{doc} must hold whole numbers")
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = stored(query_terms(queries, text, item))
    blocks = max(1, -(-pairs.count() // block_pairs))
    block = F.pmod(F.xxhash64("_item"), F.lit(blocks))
    done = [answers(docs, pairs.filter(block == b), top, text, doc) for b in range(blocks)]
    every = functools.reduce(DataFrame.unionByName, done)
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_doc").asc_nulls_last())
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select(F.col("_item").alias(item), "rank", F.col("_doc").alias(doc), "score")


def answers(docs: DataFrame, pairs: DataFrame, top: int, text: str, doc: str) -> DataFrame:
    """`_item, _doc, score`: the best of every shard for one block of queries."""
    spark = docs.sparkSession
    rows = sorted(pairs.collect(), key=lambda r: (str(r["_item"]), r["_term"]))
    items = list(dict.fromkeys(r["_item"] for r in rows))
    number = {x: i for i, x in enumerate(items)}
    terms = sorted({r["_term"] for r in rows})
    hashes = term_hashes(terms)
    order = np.argsort(hashes)
    place = dict(zip((terms[i] for i in order), range(len(terms)), strict=True))
    asked: list[list[int]] = [[] for _ in items]
    for r in rows:
        asked[number[r["_item"]]].append(place[r["_term"]])
    path = shared_path(spark, "postings")
    postings(docs, hashes[order], text, doc).write.parquet(path)
    index = spark.read.parquet(path)
    stats = corpus(index, len(terms))
    wanted = [np.array([t for t in q if stats.weights[t] > 0], np.int64) for q in asked]
    shared = spark.sparkContext.broadcast((stats, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, wanted = shared.value
        for shard in shards(batches):
            shard = shard.combine_chunks()
            ids = shard.column(0).combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            shard = shard.take(pa.array(np.lexsort((ids.fill_null(0).to_numpy(), null)))).combine_chunks()
            term, tf = (shard.column(c).combine_chunks() for c in (2, 3))
            lists = Lists(shard.column(1).to_numpy(), term.offsets.to_numpy() - term.offsets[0].as_py(), term.flatten().to_numpy(), tf.flatten().to_numpy(), stats)
            for i, query in enumerate(wanted):
                places, scores = lists.best(query, top)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), i, np.int32)), shard.column(0).combine_chunks().take(pa.array(places)), pa.array(scores)], ["_number", "_doc", "score"])

    made = T.StructType().add("_number", T.IntegerType()).add("_doc", docs.schema[doc].dataType).add("score", T.LongType())
    found = index.filter(F.size("_terms") > 0).mapInArrow(tidy(run), made)
    names = spark.createDataFrame(list(enumerate(items)), T.StructType().add("_number", T.IntegerType()).add("_item", pairs.schema["_item"].dataType))
    return found.join(F.broadcast(names), "_number").select("_item", "_doc", "score")
