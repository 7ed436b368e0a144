"""Top-k search on vectors, and the pipeline end to end."""

from __future__ import annotations

import random
from pathlib import Path

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from zonecast.llm import exact_dedup, near_dedup, quality, topk
from zonecast.llm.catalog import QUERIES
from zonecast.session import stage


def _brute(rows, k, picked):
    valid = [
        (n, key, np.floor(64 * np.array(v)).astype(np.int64))
        for n, (key, v) in enumerate(rows)
        if v is not None and key is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n, key, q in valid:
        if picked(key):
            d = [(int(q[: len(c)] @ c[: len(q)]), i, m) for m, i, c in valid if m != n]
            best = sorted(d, key=lambda x: (-x[0], x[1]))[:k]
            out += [(key, r + 1, i, s) for r, (s, i, _) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["lengths", "ties", "odd", "few"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "lengths":
        m = rng.standard_normal((900, 8)) * rng.lognormal(0, 1.5, (900, 1))
        rows = [(k, v.tolist()) for k, v in enumerate(m)]
    elif kind == "ties":
        rows = [(k, [1.0, 0.5] if k % 3 == 0 else [float(k % 5), 1.0]) for k in range(400)]
    elif kind == "odd":
        rows = [(k, rng.standard_normal(4).tolist()) for k in range(60)]
        rows += [(100, None), (120, [None, 1.0]), (140, [float("nan")]), (160, [float("inf"), 1.0]), (None, [1.0])]
        rows += [(0, [1.0, 2.0, 3.0, 4.0]), (20, [0.0, 0.0, 0.0, 0.0]), (21, []), (40, [9.0])]
    else:
        rows = [(k, [float(k), 1.0]) for k in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x"))
    got = topk.top_k(df.coalesce(1), "vec_id % 20 = 0", 20).drop("query_row").collect()
    assert sorted(map(tuple, got)) == _brute(rows, 20, lambda k: k % 20 == 0)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, "vec_id % 20 = 0").count() == 0


def test_pruning_loses_nothing():
    """A block search with a bound returns all scores that reach it, by either kind of pruning."""
    rng = np.random.default_rng(2)
    c = rng.integers(-60, 60, (500, 6))
    c = np.concatenate([c, rng.integers(-3, 3, (100, 6)) + np.array([50, 40, -30, 20, 0, 0])])
    order = np.argsort(-np.sqrt((c**2).sum(1)), kind="stable")
    block = topk._Block.__new__(topk._Block)
    block.vectors, block.norms = c[order].astype(np.int32), np.sqrt((c[order] ** 2.0).sum(1))
    block.ids = block.rows = np.arange(600)
    for share in (0.5, 0.8, 0.95, 1.0):
        q = topk._Block.__new__(topk._Block)
        q.vectors, q.norms, q.ids, q.rows = block.vectors[:40], block.norms[:40], block.ids[:40], block.rows[:40] + 10_000
        products = q.vectors.astype(int) @ block.vectors.T.astype(int)
        bounds = share * products.max(1)
        found = {i: s.tolist() for i, _, s in topk.search_block(q, block, bounds, 20)}
        for i in range(40):
            assert sorted(found.get(i, []), reverse=True) == sorted((p for p in products[i] if p >= bounds[i]), reverse=True)[:20]


def test_pipeline_stages(spark):
    """Each stage does what its operator decided, on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    kept = []
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = stage(apply(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept.append((name, docs))
    first = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(first, *quality.fit(first, labels)).select("doc_id", "quality_score", "clean_score", "good").collect()
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(kept[0][1]) == {r.doc_id for r in scored if r.good}
    assert 0 < sum(r.good for r in scored) < len(scored)
    assert ids(kept[1][1]) == ids(exact_dedup.exact_groups(kept[0][1]).where("kept"))
    want = brute.near_components([(r.doc_id, r.text) for r in kept[1][1].collect()], width=5)
    assert ids(kept[2][1]) == {doc for doc, (_, component) in want.items() if doc == component}
    assert ids(kept[3][1]) <= ids(kept[2][1])
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[3][1], SF)
    assert pieces.select("doc_id", "start").distinct().groupBy("doc_id").count().count() == len(ids(kept[3][1]))
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert QUERIES.keys() >= {f"op{n}_" + q for n, q in enumerate(["topk", "packing", "near_dedup", "lm_scoring"], 1)}


def test_near_copies_keep_one_of_each_group(spark):
    rng = random.Random(3)
    base = " ".join(f"v{rng.randint(0, 999)}" for _ in range(80))
    rows = [(1, base), (1, base + " more"), (2, base + " other"), (3, None), (4, ""), (5, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "") for r in near_dedup.drop_near_copies(df).collect())
    assert [g[0] for g in got] == [1, 3, 4, 5]


def test_nothing_else_imports_the_package():
    root = Path(__file__).parents[2]
    outside = [p for p in root.glob("zonecast/**/*.py") if "llm" not in p.parts] + [root / "bench.py", root / "check.py"]
    assert not [p for p in outside if "llm" in p.read_text()]


def test_toxic_documents_are_rejected(spark):
    """Held-out documents of good quality: most toxic ones go, nearly all clean ones stay; a null label is passed over."""
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(1600):
        text, toxic = list(rng.choice(words, 80)), k % 5 == 0
        text[10:13] = rng.choice(["badone", "badtwo", "badthree"], 3) if toxic else text[10:13]
        docs.append((k, " ".join(text), "en", "a", 500))
        if k < 1200:
            labels.append((k, None if k % 50 == 7 else int(k % 7 > 0), int(toxic) if k % 50 != 9 else None))
    sent = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    _, clean, words = quality.fit(sent, known)
    kept = {r.doc_id for r in quality.score(sent, None, clean, words).where("good").collect()}
    fresh = range(1200, 1600)
    assert sum(k in kept for k in fresh if k % 5 == 0) < 0.3 * 80
    assert sum(k in kept for k in fresh if k % 5) > 0.95 * 320
