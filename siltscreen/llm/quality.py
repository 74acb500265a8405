"""Quality: a document classifier combined with host and path posteriors by empirical Bayes.

A logistic model of text shape gives each document its evidence, the log odds that its text adds to the
base rate.  Grouped sums of the classifier's probabilities give each host and each path on it a mean;
sparse ones are shrunk, paths towards their host and hosts towards the whole corpus, as strongly as the
spread between sites says.  A document's posterior is its evidence on top of its path's shrunken mean,
in which its own probability does not count.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import col, held_out, join_checked, stored, utf8, with_text_columns, without
from siltscreen.llm.words import words

#: Labelled rows the classifier is fitted on, at most: the bound of the driver's memory.
SAMPLE_ROWS = 8000
#: Documents whose posterior of being good is below this are rejected.
REJECT_BELOW = 0.3
#: Prior rows that a site's mean is shrunk by, at least and at most.
SHRINK = (1.0, 1e6)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    #: Log odds of label 1 among the rows of the fit.
    base: float


def features(column: pa.Array) -> np.ndarray:
    """Shape of each text: shares of bytes, word lengths, repetition, line lengths."""
    data, offsets = utf8(column)
    n, sizes = len(column), np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    histogram = np.bincount(rows * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    share = np.sqrt(histogram[:, :128] / np.maximum(sizes, 1)[:, None])
    beyond = histogram[:, 128:].sum(1) / np.maximum(sizes, 1)
    upper, lower = histogram[:, 65:91].sum(1), histogram[:, 97:123].sum(1)
    digits, marks = histogram[:, 48:58].sum(1), histogram[:, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]].sum(1)
    found = words(data, offsets)
    counts = np.diff(found.bounds)
    many = np.maximum(counts, 1)
    width = np.bincount(found.rows, weights=found.ends - found.starts, minlength=n)
    again = np.zeros(n)
    if len(found.hashes) > 1:
        same = (found.hashes[1:] == found.hashes[:-1]) & (found.rows[1:] == found.rows[:-1])
        again = np.bincount(found.rows[1:][same], minlength=n)
    order = np.lexsort((found.hashes, found.rows))
    h, r = found.hashes[order], found.rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    kinds = np.bincount(r[new], minlength=n)
    letters = np.maximum(upper + lower, 1)
    lines = histogram[:, 10] + 1
    shape = np.stack(
        [beyond, upper / letters, digits / np.maximum(sizes, 1), marks / np.maximum(sizes, 1), width / many, again / many, np.sqrt(again / many), kinds / many, np.log1p(counts), np.log1p(counts / lines), histogram[:, 124] / many, marks / many],
        axis=1,
    )
    return np.concatenate([share, shape], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> Model:
    """Logistic regression with a ridge, by Newton steps; rows of one label only, or none, give their share."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    mean = x.mean(0) if n else np.zeros(k)
    scale = np.maximum(x.std(0), 1e-4) if n else np.ones(k)
    w, b = np.zeros(k), base
    if len(set(y.tolist())) > 1:
        z = np.clip((x - mean) / scale, -8, 8)
        z1 = np.concatenate([z, np.ones((n, 1))], axis=1)
        theta = np.append(w, b)
        penalty = np.append(np.full(k, ridge), 0.0)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z1 @ theta, -30, 30)))
            grad = z1.T @ (p - y) + penalty * theta
            hess = (z1 * (p * (1 - p))[:, None]).T @ z1 + np.diag(penalty + 1e-6)
            move = np.linalg.solve(hess, grad)
            theta -= move * min(1.0, 4.0 / np.abs(move).max())
            if np.abs(move).max() < 1e-6:
                break
        w, b = theta[:-1], float(theta[-1])
    return Model(mean, scale, w, b, base)


def log_odds(model: Model, x: np.ndarray) -> np.ndarray:
    return np.clip(np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights + model.bias, -30, 30)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents, chosen by a hash of their id, held-out ones never among them.

    Rows with a null id, label or text are not learned from; an id with several labels counts with each,
    once whatever the number of its rows (by the least of its features).  Only features come to the driver.
    """
    known = labels.select(col(doc).alias("_doc"), col(label).cast("int").alias("_label")).filter("_doc is not null and _label in (0, 1)").filter(~held_out(F.col("_doc"))).distinct()
    chosen = known.orderBy(F.xxhash64("_doc"), "_doc", "_label").limit(rows)
    texts = docs.select(col(doc).alias("_doc"), col(text).alias("_text")).filter("_text is not null").join(F.broadcast(chosen), "_doc")

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([r.tobytes() for r in features(column)], pa.binary())]

    found = with_text_columns(texts, "_text", make, T.StructType().add("_x", T.BinaryType()), ["_doc", "_label"])
    # One row of each id and label, so no more than were chosen, and copies displace no other label.
    once = found.groupBy("_doc", "_label").agg(F.min("_x").alias("_x"))
    sample = sorted(once.collect(), key=lambda r: (r._doc, r._label, bytes(r._x)))
    width = features(pa.array([""])).shape[1]
    x = np.frombuffer(b"".join(r._x for r in sample)).reshape(-1, width) if sample else np.zeros((0, width))
    return fit(x, np.array([r._label for r in sample], np.int64))


def evidence(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """`keep`, `_odds` (log odds of the text) and `_p`; null counts as an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(column: pa.Array) -> list[pa.Array]:
        z = log_odds(shared.value, features(column))
        return [pa.array(z), pa.array(1 / (1 + np.exp(-z)))]

    return with_text_columns(docs, text, make, T.StructType().add("_odds", T.DoubleType()).add("_p", T.DoubleType()), keep)


class Sites(NamedTuple):
    """Paths with `_host, _path, _sum, _rows, _host_mean`, the corpus mean, and the strengths of both shrinkings."""

    paths: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def strength(groups: DataFrame, total: str, rows: str, centre: Column) -> float:
    """Prior rows for means of groups: within-group variance over the variance between group means.

    By moments, over all groups: sum of rows * (mean - centre) ** 2 is (groups) * within + between * rows.
    """
    mean = F.col(total) / F.col(rows)
    row = groups.agg(
        F.sum(F.col(rows) * (mean - centre) * (mean - centre)).alias("spread"), F.sum(rows).alias("n"), F.count("*").alias("k"),
        F.sum(F.col(rows) * centre * (1 - centre)).alias("within"),
    ).first()
    if not row.n:
        return SHRINK[1]
    within = row.within / row.n
    between = (row.spread - row.k * within) / row.n
    return float(np.clip(within / between, *SHRINK)) if between > 0 else SHRINK[1]


def sites(scored: DataFrame) -> Sites:
    """Host and path sums over all rows: partial sums before one exchange, so a hot host is a few rows."""
    sums = stored(scored.groupBy("_host", "_path").agg(F.sum("_p").alias("_sum"), F.count("*").alias("_rows")))
    hosts = sums.groupBy("_host").agg(F.sum("_sum").alias("_hs"), F.sum("_rows").alias("_hn"))
    whole = sums.agg(F.sum("_sum").alias("s"), F.sum("_rows").alias("n")).first()
    mean = float(np.clip(whole.s / whole.n, 1e-6, 1 - 1e-6)) if whole.n else 0.5
    k0 = strength(hosts, "_hs", "_hn", F.lit(mean))
    shrunk = hosts.select("_host", ((F.col("_hs") + k0 * mean) / (F.col("_hn") + k0)).alias("_host_mean"))
    paths = stored(sums.join(shrunk, "_host"))
    return Sites(paths, mean, k0, strength(paths, "_sum", "_rows", F.col("_host_mean")))


def site_columns(docs: DataFrame, host: str | None, path: str | None) -> dict[str, Column]:
    """Null counts as the empty name, and so does a column that there is not."""
    have = {c.lower() for c in docs.columns}
    name = lambda c: F.coalesce(col(c).cast("string"), F.lit("")) if c and c.lower() in have else F.lit("")
    return {"_host": name(host), "_path": name(path)}


def url_sites(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for tables that have one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def posterior(scored: DataFrame, known: Sites, base: float) -> DataFrame:
    """Add `evidence`, `site_prior` and `posterior` to rows with `_host, _path, _odds, _p`."""
    joined = join_checked(scored, known.paths, ["_host", "_path"])
    k = F.lit(known.path_strength)
    # Without the row's own probability.
    prior = (F.col("_sum") - F.col("_p") + k * F.col("_host_mean")) / (F.col("_rows") - 1 + k)
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("_odds") - base + F.log(prior / (1 - prior))
    return joined.withColumns({"evidence": F.col("_odds") - base, "site_prior": prior, "posterior": 1 / (1 + F.exp(-odds))})


def assess(docs: DataFrame, model: Model, text: str = "text", host: str | None = "source", path: str | None = "lang", keep: list[str] | None = None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """`keep`, then `evidence, site_prior, posterior, good` for each document.

    Scores are written once, without texts, and read for the site sums and for the posteriors.  Null and
    empty texts get the evidence of an empty text; a null host or path counts as the empty name; repeated
    rows count once each.  Columns named like the results give way to them.
    """
    keep = keep if keep is not None else without(docs, text)
    keep = [c for c in keep if c.lower() not in ("evidence", "site_prior", "posterior", "good")]
    names = {c: f"_d{i}" for i, c in enumerate(keep)}
    bare = docs.select(*[col(c).alias(n) for c, n in names.items()], *[c.alias(n) for n, c in site_columns(docs, host, path).items()], col(text).alias("_text"))
    scored = stored(evidence(bare, model, "_text", [*names.values(), "_host", "_path"]))
    done = posterior(scored, sites(scored), model.base)
    return done.select(*[F.col(n).alias(c) for c, n in names.items()], "evidence", "site_prior", "posterior", (F.col("posterior") >= reject_below).alias("good"))


def good_documents(docs: DataFrame, model: Model, text: str = "text", host: str | None = "source", path: str | None = "lang", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The documents that are not rejected, with their columns as they came.

    Texts are scored twice, for the site sums and for the decision, instead of being moved or written.
    """
    names = docs.columns
    bare = docs.select(*[col(c).alias(f"_d{i}") for i, c in enumerate(names)], *[c.alias(n) for n, c in site_columns(docs, host, path).items()], col(text).alias("_text"))
    known = sites(evidence(bare, model, "_text", ["_host", "_path"]))
    scored = evidence(bare, model, "_text", [c for c in bare.columns if c != "_text"])
    return posterior(scored, known, model.base).filter(F.col("posterior") >= reject_below).select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
