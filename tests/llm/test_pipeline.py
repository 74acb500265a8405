"""The pipeline and every stage against brute force; the SQL of the operators that have one; rules for the code."""

import hashlib
import struct
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siltscreen.llm import quality, queries, toxicity
from siltscreen.llm.common import utf8
from test_near import expected
from test_near import words as plain_words

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]


def good_rows(rows, model):
    """The posterior of every row, one row at a time, from sums over plain dictionaries."""
    odds = [float(quality.log_odds(model, quality.features(pa.array([r.text], pa.string())))[0]) for r in rows]
    p = [1 / (1 + np.exp(-z)) for z in odds]
    paths, hosts = {}, {}
    for r, x in zip(rows, p):
        for table, key in ((paths, (r.source, r.lang)), (hosts, r.source)):
            total = table.setdefault(key, [0.0, 0])
            total[0] += x
            total[1] += 1
    mean = sum(p) / len(p)

    def strength(groups, centre):
        n = sum(c for _, c in groups.values())
        within = sum(c * centre(k) * (1 - centre(k)) for k, (_, c) in groups.items()) / n
        spread = sum(c * (s / c - centre(k)) ** 2 for k, (s, c) in groups.items())
        between = (spread - len(groups) * within) / n
        return float(np.clip(within / between, *quality.SHRINK)) if between > 0 else quality.SHRINK[1]

    k0 = strength(hosts, lambda _: mean)
    shrunk = {h: (s + k0 * mean) / (c + k0) for h, (s, c) in hosts.items()}
    k1 = strength(paths, lambda k: shrunk[k[0]])
    out = set()
    for r, z, x in zip(rows, odds, p):
        s, c = paths[r.source, r.lang]
        prior = (s - x + k1 * shrunk[r.source]) / (c - 1 + k1)
        if 1 / (1 + np.exp(-(z - model.base + np.log(prior / (1 - prior))))) >= quality.REJECT_BELOW:
            out.add(r.doc_id)
    return out


def civil_rows(rows, model):
    out = set()
    for r in rows:
        raw, offsets = utf8(pa.array([r.text], pa.string()))
        found = toxicity.words(raw, offsets)
        parts = toxicity.word_parts(raw, found.starts, found.ends)
        # Largest response of each filter, place by place.
        vectors = model.embed[parts].sum(1)
        pooled = []
        for kernel, bias in zip(model.kernels, model.biases):
            best = np.maximum(bias, 0) if not len(vectors) else np.zeros(len(bias))
            for i in range(len(vectors)):
                here = bias + sum(vectors[i + k] @ kernel[k] for k in range(len(kernel)) if i + k < len(vectors))
                best = np.maximum(best, here)
            pooled.append(best)
        z = float(np.concatenate(pooled) @ model.weights + model.bias)
        if 1 / (1 + np.exp(-z)) < model.thresholds.get(r.lang, model.thresholds[None]):
            out.add(r.doc_id)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    labels = queries.table(spark, SF, "labels")
    items = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    windows = set()
    for text in items.values():
        w = plain_words(text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1 if w else 0))}
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        done = stage(spark, docs, SF)
        done.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        kept = {r.doc_id for r in after}
        assert len(kept) == len(after) > 0
        if k == 0:
            want = good_rows(before, quality.train(spark.createDataFrame(before), labels))
        elif k == 1:
            want = civil_rows(before, toxicity.train(spark.createDataFrame(before), labels))
        elif k == 2:
            want = {i for i, (_, _, first) in expected({r.doc_id: r.text for r in before}).items() if first}
        elif k == 3:
            sizes = {len(w) for w in windows}
            clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
            want = {r.doc_id for r in before if clean(plain_words(r.text))}
        else:
            want = {r.doc_id for r in before}
        assert kept == want, name
        if k < 4:
            assert docs.columns == columns
            whole = {r.doc_id: r for r in before}
            assert all(r == whole[r.doc_id] for r in after)
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_stages_take_awkward_rows(spark, awkward, tmp_path):
    docs = awkward
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(f"{tmp_path}/in{k}")
        done = stage(spark, spark.read.parquet(f"{tmp_path}/in{k}"), SF)
        nothing = stage(spark, spark.read.parquet(f"{tmp_path}/in{k}").limit(0), SF)
        assert nothing.collect() == []
        if k < 4:
            assert done.columns == awkward.columns
        docs = done


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_nothing_of_the_corpus_is_copied_to_one_place():
    root = Path(queries.__file__).parent
    for file in root.glob("*.py"):
        code = file.read_text()
        for banned in ("crossJoin", "localCheckpoint", ".toPandas(", ".rdd"):
            assert banned not in code, (file, banned)
    # The rest of the library does not know the subpackage.
    for file in root.parent.rglob("*.py"):
        if file.parent != root:
            assert "siltscreen.llm" not in file.read_text(), file
