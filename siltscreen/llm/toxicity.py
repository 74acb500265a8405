"""Toxicity: a convolutional text classifier in numpy, applied to whole texts on the executors.

Words are hashed into a table of embeddings; filters of several widths run over the word sequence and
the largest response of each filter over the whole text goes into a logistic layer.  Training needs
only the places of the largest responses, so it stays cheap on long texts.  In use, what a
word adds to each filter is worked out once for each different word of a step; the rest is sums.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import col, held_out, utf8, with_text_columns, without
from siltscreen.llm.words import lowered, run_hashes, words

#: Labelled rows the model is fitted on, at most: the bound of the driver's memory.
SAMPLE_ROWS = 5000
#: Longer texts are scored in full but not used for fitting.
SAMPLE_WORDS = 20_000
BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 12
RATE = 0.03
BATCH = 48
#: Rows of either label from which a fifth is set apart to scale scores; with fewer, all are trained on.
CALIBRATE_FROM = 60


#: A word is the sum of the embeddings of itself and of its first so many bytes, so inflected forms share what they learn.
PREFIXES = (4, 5, 6, 7)
PARTS = 1 + len(PREFIXES)


class Model(NamedTuple):
    #: One row per bucket; each part of a word has BUCKETS of its own.
    embed: np.ndarray
    #: For each width: place under the filter, embedding, filter.
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    #: Decision thresholds by language; None is for others and unknown ones.
    thresholds: dict[str | None, float]


def word_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The buckets of each word and of its beginnings, a row a word."""
    data = lowered(data)
    cut = [run_hashes(data, starts, np.minimum(ends, starts + k)) for k in PREFIXES]
    hashes = np.stack([run_hashes(data, starts, ends), *cut], axis=1)
    return (hashes >> np.uint64(48)).astype(np.int32) + np.arange(PARTS, dtype=np.int32) * BUCKETS


def _responses(places: list[np.ndarray], bias: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each text, and all responses.

    places[k] has what each word adds to a filter when it is k words after the filter's first; a word
    beyond the text's end adds nothing.
    """
    out = places[0]
    for k in range(1, len(places)):
        part = places[k][k:]
        inside = np.ones(len(part), bool)
        for j in range(1, k + 1):
            edges = starts[1:] - j
            inside[edges[(edges >= 0) & (edges < len(inside))]] = False
        part[~inside] = 0
        out[: len(part)] += part
    out += bias
    best = np.tile(bias, (len(lengths), 1)).astype(np.float32)
    full = np.flatnonzero(lengths > 0)
    if len(full):
        best[full] = np.maximum.reduceat(out, starts[full], axis=0)
    return np.maximum(best, 0), out


def score_words(model: Model, parts: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Scores of texts whose words are `kinds`, places among the different words of `parts`."""
    vectors = model.embed[parts].sum(1)
    starts, lengths = bounds[:-1], np.diff(bounds)
    pooled = [_responses([(vectors @ k)[kinds] for k in kernel], b, starts, lengths)[0] for kernel, b in zip(model.kernels, model.biases, strict=True)]
    z = np.concatenate(pooled, axis=1).astype(np.float64) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7, epochs: int = 8, least_steps: int = 200) -> Model:
    """Train by Adam on four fifths of the rows; scale scores and set thresholds on the rest.

    With no rows, or rows of one label only, every score is the share of label 1 (a half of none).
    """
    rng = np.random.default_rng(seed)
    share = float((labels.sum() + 0.5) / (len(labels) + 1))
    dims = FILTERS * len(WIDTHS)
    embed = (rng.normal(size=(BUCKETS * PARTS, SIZE)) * 0.004).astype(np.float32)
    kernels = [(rng.normal(size=(w, SIZE, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    biases = [np.full(FILTERS, 0.02, np.float32) for _ in WIDTHS]
    weights, bias = (rng.normal(size=dims) * 0.3).astype(np.float32), float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(embed, kernels, biases, np.zeros(dims), bias, {None: 0.5})
    order = rng.permutation(len(texts))
    # Both parts get their share of either label.
    held = np.zeros(len(texts), bool)
    for y in (0, 1):
        held[order[labels[order] == y][::5]] = True
    if min(labels.sum(), (1 - labels).sum()) < CALIBRATE_FROM:
        held[:] = False
    train = order[~held[order]]
    embed += np.outer(np.clip(_surprise(texts, labels, train, len(embed)), -2, 8) * 0.05, rng.normal(size=SIZE)).astype(np.float32)
    state: dict[str, list] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    scale = np.zeros((len(embed), 1), np.float32)
    step = 0
    head = np.append(weights, np.float32(bias)).astype(np.float32)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    batches = max(1, len(train) // BATCH)
    # Few rows are gone through more often.
    for _ in range(max(epochs, -(-least_steps // batches))):
        for batch in np.array_split(rng.permutation(train), batches):
            step += 1
            lengths = np.array([len(texts[i]) for i in batch])
            at = np.concatenate([texts[i] for i in batch])
            starts = np.zeros(len(batch), np.int64)
            np.cumsum(lengths[:-1], out=starts[1:])
            pooled, raw = [], []
            vectors = embed[at].sum(1)
            for kernel, b in zip(kernels, biases, strict=True):
                p, r = _responses([vectors @ k for k in kernel], b, starts, lengths)
                pooled.append(p)
                raw.append(r)
            x = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ head[:-1] + head[-1], -30, 30)))
            d = (p - labels[batch]) * balance[batch] / len(batch)
            dx = d[:, None] * head[None, :-1] * (x > 0)
            grad_head = np.append(d @ x, d.sum()).astype(np.float32)
            touched, moves = [np.zeros(0, np.int64)], [np.zeros((0, SIZE), np.float32)]
            for j, (kernel, r) in enumerate(zip(kernels, raw, strict=True)):
                g = dx[:, j * FILTERS : (j + 1) * FILTERS]
                top = np.zeros((len(batch), FILTERS), np.int64)
                for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                    if n:
                        top[i] = s + np.argmax(r[s : s + n], axis=0)
                grad_kernel = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    inside = top + k < (starts + lengths)[:, None]
                    row, f = np.nonzero(inside & (g != 0))
                    word = top[row, f] + k
                    value = g[row, f][:, None]
                    np.add.at(grad_kernel[k].T, f, value * vectors[word])
                    touched.append(at[word].reshape(-1))
                    moves.append(np.repeat(value * kernel[k].T[f], PARTS, axis=0))
                adam(f"k{j}", kernel, grad_kernel, 0.01, step)
                adam(f"b{j}", biases[j], g.sum(0).astype(np.float32) + 1e-3 * biases[j], 0.003, step)
            rows, group = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(grad, group, np.concatenate(moves))
            scale[rows] += (grad**2).mean(1, keepdims=True)
            embed[rows] -= RATE * grad / (np.sqrt(scale[rows]) + 1e-8)
            embed[rows] *= 1 - 1e-4
            adam("head", head, grad_head + 1e-4 * head, 0.01, step)
    model = Model(embed, kernels, biases, head[:-1].astype(np.float64), float(head[-1]), {None: 0.5})
    return _calibrated(model, [texts[i] for i in np.flatnonzero(held)], labels[held], [langs[i] for i in np.flatnonzero(held)])


def _scores(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Scores of texts given as parts of all their words, some texts at a time."""
    out = [np.zeros(0)]
    for low in range(0, len(texts), BATCH):
        some = texts[low : low + BATCH]
        bounds = np.cumsum([0, *map(len, some)])
        out.append(score_words(model, np.concatenate(some), np.arange(bounds[-1]), bounds))
    return np.concatenate(out)


def _surprise(texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """How many more texts of label 1 have each bucket than its texts' number suggests, in standard deviations.

    Embeddings start on one line by it, so that training sets out from words that many texts share.
    """
    seen, ones = np.zeros(size), np.zeros(size)
    for i in rows.tolist():
        own = np.unique(texts[i])
        seen[own] += 1
        ones[own] += labels[i]
    share = labels[rows].mean()
    return (ones - seen * share) / np.sqrt(seen * share * (1 - share) + 1)


def _calibrated(model: Model, texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> Model:
    """Scale scores to probabilities (two numbers, by Newton steps), then set each language's threshold."""
    if not len(texts):
        return model
    p = np.clip(_scores(model, texts), 1e-9, 1 - 1e-9)
    z = np.clip(np.log(p / (1 - p)), -15, 15)
    # Targets are smoothed so that separable rows give finite numbers.
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    def loss(x: np.ndarray) -> float:
        return float(np.logaddexp(0, x[0] * z + x[1]).sum() - (target * (x[0] * z + x[1])).sum() + 0.5 * (x[0] - 1) ** 2)

    x = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x[0] * z + x[1], -30, 30)))
        w = q * (1 - q)
        g = np.array([((q - target) * z).sum() + x[0] - 1, (q - target).sum()])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(x - size * move) > loss(x):
            size /= 2
        x = x - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    if x[0] > 0.05:
        model = model._replace(weights=model.weights * x[0], bias=float(model.bias * x[0] + x[1]))
    p = _scores(model, texts)
    groups: dict[str | None, np.ndarray] = {None: np.ones(len(labels), bool)}
    for lang in {x for x in langs if x is not None}:
        groups[lang] = np.array([x == lang for x in langs])
    thresholds = {k: t for k, rows in groups.items() if (t := _threshold(p[rows], labels[rows])) is not None}
    return model._replace(thresholds={None: 0.5} | thresholds)


def _threshold(p: np.ndarray, labels: np.ndarray) -> float | None:
    """The middle of the best cut by F1; None with fewer than five rows of either label."""
    if min(labels.sum(), (1 - labels).sum()) < 5:
        return None
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + labels.sum())
    best = int(np.argmax(f1))
    after = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order[best]] + after) / 2, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "toxic", lang: str | None = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents, chosen by a hash of their id, held-out ones never among them.

    Rows with a null id, label or text, and texts of over SAMPLE_WORDS words, are not learned from.  An
    id with several labels counts with each of them, once whatever the number of its rows (by the least of
    its word buckets).  Only word buckets come to the driver.
    """
    known = labels.select(col(doc).alias("_doc"), col(label).cast("int").alias("_label")).filter("_doc is not null and _label in (0, 1)").filter(~held_out(F.col("_doc"))).distinct()
    # The ids are chosen first: texts of other documents are never moved.
    chosen = known.orderBy(F.xxhash64("_doc"), "_doc", "_label").limit(rows)
    language = col(lang) if lang and lang.lower() in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    joined = docs.select(col(doc).alias("_doc"), col(text).alias("_text"), language.cast("string").alias("_lang")).filter("_text is not null").join(F.broadcast(chosen), "_doc")

    def make(column: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(column)
        found = words(data, offsets)
        raw = (word_parts(data, found.starts, found.ends) % BUCKETS).astype("<u2").tobytes()
        bounds = found.bounds.astype(np.int64) * (2 * PARTS)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        return [packed.cast(pa.binary()), pa.array(np.diff(found.bounds))]

    made = T.StructType().add("_at", T.BinaryType()).add("_n", T.LongType())
    found = with_text_columns(joined, "_text", make, made, ["_doc", "_label", "_lang"]).filter(F.col("_n") <= SAMPLE_WORDS)
    # One row of each id and label, so no more than were chosen, and copies displace no other label.
    once = found.groupBy("_doc", "_label").agg(F.min(F.struct("_at", "_lang")).alias("_x")).select("_doc", "_label", "_x.*")
    sample = sorted(once.collect(), key=lambda r: (r._doc, r._label))
    shift = np.arange(PARTS, dtype=np.int32) * BUCKETS
    return fit([np.frombuffer(r._at, "<u2").reshape(-1, PARTS).astype(np.int32) + shift for r in sample], np.array([r._label for r in sample], np.int64), [r._lang for r in sample])


def score(docs: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Add `score` (0 to 1), `threshold` (of the row's language) and `toxic` (score >= threshold).

    A null or empty text has no words and gets the score of one.  The language picks the threshold only.
    Columns named like the results give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(column: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(column)
        found = words(data, offsets)
        kinds, _ = pd.factorize(found.hashes)
        first = np.zeros(kinds.max(initial=-1) + 1, np.int64)
        first[kinds[::-1]] = np.arange(len(kinds))[::-1]
        parts = word_parts(data, found.starts[first], found.ends[first])
        return [pa.array(score_words(shared.value, parts, kinds, found.bounds))]

    scored = with_text_columns(docs, text, make, T.StructType().add("score", T.DoubleType()), without(docs, "score", "threshold", "toxic"))
    default = F.lit(model.thresholds[None])
    by_lang = {k: v for k, v in model.thresholds.items() if k is not None}
    threshold = default
    if by_lang and lang and lang.lower() in {c.lower() for c in scored.columns}:
        table = F.create_map(*[x for k, v in sorted(by_lang.items()) for x in (F.lit(k), F.lit(v))])
        threshold = F.coalesce(F.try_element_at(table, col(lang).cast("string")), default)
    return scored.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def civil(docs: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The documents that are not toxic, with their columns as they came."""
    names = docs.columns
    bare = docs.select(*[col(c).alias(f"_d{i}") for i, c in enumerate(names)])
    place = {c.lower(): f"_d{i}" for i, c in enumerate(names)}
    scored = score(bare, model, place[text.lower()], place.get(lang.lower()) if lang else None)
    return scored.filter(~F.col("toxic")).select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
