"""The corpus pipeline: filter, deduplicate, decontaminate and encode `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscreen.llm import bpe, decontaminate, jaccard, quality, toxicity
from siltscreen.llm.common import shared_path
from siltscreen.llm.queries import table, tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    return toxicity.civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    encoder = bpe.make_encoder(docs, tokenizer_path())
    done = bpe.decode(bpe.encode(docs, encoder), encoder, packed="packed")
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", unseen),
    ("BPE encoding and decoding", encoded),
]

#: Models and searches of the stages have no SQL form; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, name.replace(" ", "-"))
    df.write.parquet(path)
    return spark.read.parquet(path)
