"""Language identification: the nearest of several centroids per language, by cosine.

A text is a vector of hashed byte n-grams (2, 3 and 4 bytes of its letters, lower-cased, one space
between words), weighted (1 + ln tf) * idf and scaled to length 1.  Each language has a few centroids,
found by clustering its sample on the sphere.  A text whose nearest centroid is farther than its
language's own sample ever was is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import STEP_BYTES, bounded_batches, col, held_out, steps, stored, tidy, utf8, with_text_columns, without
from siltscreen.llm.words import lowered

#: Rows that centroids are fitted on, of all languages together, at most; only their n-gram counts come to the driver.
SAMPLE_ROWS = 4000
#: Languages told apart, at most: the ones with most rows.
LANGUAGES = 500
#: Centroids of a language, at most.
CENTROIDS = 4
ROUNDS = 12
BITS = 13
DIMENSIONS = 1 << BITS
SIZES = (2, 3, 4)
#: A text is rejected below this share of the lowest cosine that a hundredth of its language's sample stays under.
SLACK = 0.6
#: The language of a text without a letter.
UNKNOWN = "und"
SPACE = np.uint8(0x20)


class Model(NamedTuple):
    languages: list[str]
    #: One row per centroid, of length 1, and its language.
    centroids: np.ndarray
    owners: np.ndarray
    idf: np.ndarray
    #: The least cosine that is not rejected, by language.
    least: np.ndarray


class Counts(NamedTuple):
    """Entries of a sparse table of n-gram counts, by row, then bucket."""

    rows: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray


def letters(data: np.ndarray) -> np.ndarray:
    """Letters a-z and bytes beyond ASCII as they are (A-Z lower-cased), all else a space."""
    data = lowered(data)
    return np.where(((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80), data, SPACE)


def grams(units: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of all n-grams; those over two rows or of a space alone are left out."""
    code = np.zeros(len(units), np.uint32)
    for k in range(max(SIZES)):
        code = code[: len(units) - k] | units[k:].astype(np.uint32) << np.uint32(8 * k)
        if k + 1 in SIZES:
            same = rows[: len(code)] == rows[k:]
            mixed = code[same] * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * (k + 1) & 0xFFFFFFFF)
            mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            yield rows[: len(code)][same], mixed >> np.uint32(32 - BITS)


def collapsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row between two spaces, with single spaces inside, and the rows of the bytes."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n, dtype=np.uint32), sizes + 2)
    units = np.full(len(data) + 2 * n, SPACE)
    units[np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1] = letters(data)
    blank = units == SPACE
    keep = ~blank
    keep[0:1] = True
    keep[1:] |= ~blank[:-1] | (rows[1:] != rows[:-1])
    return units[keep], rows[keep]


def count_grams(data: np.ndarray, offsets: np.ndarray) -> Counts:
    """N-gram counts of whole texts; a text longer than a step is counted in pieces that overlap by an n-gram."""
    if len(offsets) == 2 and len(data) > STEP_BYTES:
        total, tail = np.zeros(DIMENSIONS, np.int64), np.full(1, SPACE)
        for low in range(0, len(data), STEP_BYTES):
            piece = np.concatenate([tail, letters(data[low : low + STEP_BYTES]), np.full(int(low + STEP_BYTES >= len(data)), SPACE)])
            piece = piece[np.append(True, (piece[1:] != SPACE) | (piece[:-1] != SPACE))]
            for _, buckets in grams(piece, np.zeros(len(piece), np.uint32)):
                total += np.bincount(buckets, minlength=DIMENSIONS)
            tail = piece[-(max(SIZES) - 1) :]
            # N-grams inside the tail come again with the next piece.
            if low + STEP_BYTES < len(data):
                for _, buckets in grams(tail, np.zeros(len(tail), np.uint32)):
                    total -= np.bincount(buckets, minlength=DIMENSIONS)
        buckets = np.flatnonzero(total)
        return Counts(np.zeros(len(buckets), np.int64), buckets, total[buckets])
    if not len(offsets) - 1:
        return Counts(*(np.zeros(0, np.int64) for _ in range(3)))
    found = [r << np.uint32(BITS) | b for r, b in grams(*collapsed(data, offsets))]
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return Counts((keys >> np.uint32(BITS)).astype(np.int64), (keys & np.uint32(DIMENSIONS - 1)).astype(np.int64), counts)


def vectors(found: Counts, idf: np.ndarray, rows: int) -> np.ndarray:
    """The entries' values, every row of length 1 (or 0)."""
    values = (1 + np.log(found.counts)) * idf[found.buckets]
    norms = np.sqrt(np.bincount(found.rows, values * values, minlength=rows))
    return values / np.where(norms > 0, norms, 1)[found.rows]


def cosines(found: Counts, model: Model, rows: int) -> np.ndarray:
    """Every row's cosine with every centroid."""
    values = vectors(found, model.idf, rows)
    out = np.zeros((rows, len(model.centroids)))
    for k, centre in enumerate(model.centroids):
        out[:, k] = np.bincount(found.rows, values * centre[found.buckets], minlength=rows)
    return out


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """At most `k` centroids of length 1 for rows of length 1: spherical k-means from rows far from each other."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    centres = x[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        moved = np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centres, atol=1e-7):
            break
        centres = moved
    return centres


def document_frequencies(learned: DataFrame) -> np.ndarray:
    """In how many of all rows each bucket occurs; DIMENSIONS numbers come to the driver. Last: the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in steps(offsets):
                found = count_grams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                total[:-1] += np.bincount(found.buckets, minlength=DIMENSIONS)
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(total)], ["_bucket", "_n"])

    parts = learned.select("_text").mapInArrow(tidy(run), T.StructType().add("_bucket", T.IntegerType()).add("_n", T.LongType()))
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in parts.groupBy("_bucket").agg(F.sum("_n").alias("n")).collect():
        out[r["_bucket"]] = r["n"]
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model:
    """Centroids from rows with a language and a text that are not held out.

    The weights of n-grams come from all such rows.  Centroids are fitted on at most `rows` of them, as
    many for each of the `languages` most frequent languages, chosen by a hash of id and text; equal rows
    are one.  Without any row the model has no language.
    """
    bounded_batches(docs.sparkSession)
    learned = docs.select(col(doc).alias("_doc"), col(lang).alias("_lang"), col(text).alias("_text")).filter("_lang is not null and _text is not null").filter(~held_out(F.col("_doc")))
    known = learned.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(languages).collect()
    names = sorted(r["_lang"] for r in known)
    if not names:
        return Model([], np.zeros((0, DIMENSIONS)), np.zeros(0, np.int64), np.zeros(DIMENSIONS), np.zeros(0))
    frequent = document_frequencies(learned)
    idf = np.log((1 + frequent[-1]) / (1 + frequent[:-1])) + 1
    each = max(1, rows // len(names))

    def make(column: pa.Array) -> list[pa.Array]:
        found = count_grams(*utf8(column))
        ends = np.searchsorted(found.rows, np.arange(len(column) + 1))
        packed = [found.buckets.astype(np.uint16), np.minimum(found.counts, 2**32 - 1).astype(np.uint32)]
        return [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in packed]

    # Twice the wanted share of each language by a hash, then exactly the first ones: bounded before any sort.
    place = F.xxhash64("_doc", "_text")
    share = F.create_map(*[F.lit(x) for r in known for x in (r["_lang"], min(1.0, (2 * each + 50) / r["count"]))])
    near = F.pmod(place, F.lit(1 << 40)) < F.element_at(share, F.col("_lang")) * float(1 << 40)
    few = learned.filter(F.col("_lang").isin(names)).filter(near).withColumn("_place", place)
    once = stored(with_text_columns(few, "_text", make, T.StructType().add("_b", T.BinaryType()).add("_c", T.BinaryType()), ["_lang", "_place"]).dropDuplicates(["_lang", "_place"]))
    centroids, owners, least = [], [], []
    for i, name in enumerate(names):
        sample = once.filter(F.col("_lang") == name).orderBy("_place").limit(each).collect()
        x = np.zeros((len(sample), DIMENSIONS), np.float32)
        for j, r in enumerate(sample):
            entries = Counts(np.zeros(len(r["_b"]) // 2, np.int64), np.frombuffer(r["_b"], np.uint16).astype(np.int64), np.frombuffer(r["_c"], np.uint32))
            x[j, entries.buckets] = vectors(entries, idf, 1)
        made = clustered(x, CENTROIDS)
        centroids.append(made)
        owners += [i] * len(made)
        least.append(float(np.quantile((x @ made.T).max(1), 0.01)) * SLACK)
    return Model(names, np.concatenate(centroids).astype(np.float64), np.array(owners), idf, np.array(least))


def identify(docs: DataFrame, model: Model, text: str = "text", reject: bool = True, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `lang_pred`, `score` (the nearest centroid's cosine, 0 to 1) and `rejected`.

    Null texts, texts without a letter (any script) and every text under a model without languages are
    `und` with score 0, not rejected.  `rejected`: too far from the nearest centroid; such a text is
    `und` too with `reject`, else it keeps its nearest language.  Equal cosines go to the first language
    in order.  Whole texts count; repeated rows stay; empty tables give none.  Columns of `docs` named
    as the new ones are replaced.  Narrow: one Arrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = without(docs, "lang_pred", "score", "rejected") if keep is None else keep

    def make(column: pa.Array) -> list[pa.Array]:
        model, n = shared.value, len(column)
        if not model.languages:
            return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))]
        close = cosines(count_grams(*utf8(column)), model, n)
        best = close.argmax(1)
        own = model.owners[best]
        score = np.clip(close[np.arange(n), best], 0, 1)
        return [pa.array(model.languages, pa.string()).take(pa.array(own)), pa.array(score), pa.array(score < model.least[own])]

    made = T.StructType().add("_lang", T.StringType()).add("_score", T.DoubleType()).add("_far", T.BooleanType())
    # Letters are looked for before the pass: scripts are Spark's business.
    asked = docs.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(keep)], col(text).alias("_text"))
    asked = asked.withColumn("_spoken", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)))
    found = with_text_columns(asked, "_text", make, made, [*[f"_k{i}" for i in range(len(keep))], "_spoken"])
    spoken = F.col("_spoken")
    far = spoken & F.col("_far")
    said = F.when(spoken & ~(far if reject else F.lit(False)), F.col("_lang")).otherwise(UNKNOWN)
    return found.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], said.alias("lang_pred"), F.when(spoken, F.col("_score")).otherwise(0.0).alias("score"), far.alias("rejected")
    )
