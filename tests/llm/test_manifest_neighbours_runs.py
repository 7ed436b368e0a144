"""Merkle manifest, nearest neighbours and periodic runs: against loops, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_documents import empty, odd  # noqa: F401

from zonecast.llm import ann, merkle, periodic_runs
from zonecast.llm.catalog import QUERIES
from zonecast.llm.hashing import hash_words


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row) -> str:
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _grow(hashes: list[str], fan: int) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h(*now[k : k + fan]) for k in range(0, len(now), fan)])
    return levels


def _path(levels: list[list[str]], at: int, fan: int) -> list[tuple[str, str]]:
    out = []
    for now in levels[:-1]:
        low = at - at % fan
        out.append(("".join(now[low:at]), "".join(now[at + 1 : low + fan])))
        at //= fan
    return out


def _manifest(rows: list[tuple], fan: int = 8) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[lang] = own, _grow([_leaf(r) for r in own], fan)
    crown = _grow([trees[lang][1][-1][0] for lang in order], fan)
    out = []
    for at, lang in enumerate(order):
        own, levels = trees[lang]
        for k, r in enumerate(own):
            path = _path(levels, k, fan) + _path(crown, at, fan)
            leaf = folded = _leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = _leaf((*r[:4], r[4].translate(brute.LOWER)))
            for a, z in path:
                folded = _h(a, folded, z)
            root = crown[-1][0]
            out.append((r[0], leaf, levels[-1][0], root, _h(*(a + z for a, z in path)), folded, folded == root))
    return out


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def _shown(docs):
    """op11's columns of any table of documents."""
    lowered = merkle.leaf(*(F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS))
    found = merkle.manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered)).collect()
    out = []
    for r in found:
        folded = r.tampered or r.leaf
        for s in r.path:
            folded = _h(s.left, folded, s.right)
        out.append((r.doc_id, r.leaf, r.subroot, r.root, _h(*(s.left + s.right for s in r.path)), folded, folded == r.root))
    return out


def test_merkle_query(spark):
    got = [tuple(r) for r in QUERIES["op11_merkle"](spark, SF).collect()]
    assert _sorted(got) == _sorted(_manifest(_rows(spark.read.parquet(f"{SF}/documents.parquet"))))
    assert {r[-1] for r in got} == {True, False}


def test_merkle_odd_and_empty(odd, empty):  # noqa: F811
    assert _sorted(_shown(odd)) == _sorted(_manifest(_rows(odd)))
    assert merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("digits", [1, 2])
def test_merkle_tiers(spark, monkeypatch, digits):
    """Several tiers of blocks, runs of one node, a lone leaf, more languages than one run holds."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "FAN", 3)
    langs = ["a"] * 60 + ["b"] * 28 + ["c"] * 4 + ["d", None, None, "e", "é", "", "f", "g", "h", "i", "j"]
    rows = [(k * 7 % 101, f"s{k % 3}", lang, k, f"Text {k}") for k, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _sorted(_shown(df)) == _sorted(_manifest(rows, 3))


def _neighbours(rows, k, picked):
    valid = [
        (n, key, [float(x) for x in v])
        for n, (key, v) in enumerate(rows)
        if v is not None and key is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=False):
            total += x * y
        return total

    out = []
    for n, key, q in valid:
        if picked(key):
            d = [(dot(q, c) / (math.sqrt(dot(q, q)) * math.sqrt(dot(c, c))), i) for m, i, c in valid if m != n]
            out += [(key, r + 1, i, s) for r, (s, i) in enumerate(sorted(d, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "copies", "close", "odd", "few"])
def test_nearest(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 5)
    rng = np.random.default_rng(4)
    if kind == "random":
        rows = [(k, (rng.standard_normal(12) * 10 ** rng.uniform(-6, 6)).tolist()) for k in range(500)]
    elif kind == "copies":
        # A third of all vectors are the same one: ties go to the smaller id.
        rows = [(k, [0.3, -0.7, 0.2] if k % 3 == 0 else rng.standard_normal(3).tolist()) for k in range(450)]
    elif kind == "close":
        # Differences far below the quantisation step.
        rows = [(k, (np.array([0.5, 0.1, -0.4, 0.9]) + rng.standard_normal(4) * 1e-5).tolist()) for k in range(400)]
    elif kind == "odd":
        rows = [(k, rng.standard_normal(4).tolist()) for k in range(120)]
        rows += [(100, None), (150, [None, 1.0]), (200, [float("nan")]), (250, [float("inf"), 1.0]), (None, [1.0])]
        rows += [(0, [1.0, 2.0, 3.0, 4.0]), (50, [0.0, 0.0, 0.0, 0.0]), (51, []), (100, [9.0])]
    else:
        rows = [(50 * k, [float(k + 1), 1.0]) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x"))
    got = ann.nearest(df, "vec_id % 50 = 0").drop("query_row").collect()
    assert sorted(map(tuple, got)) == _neighbours(rows, 5, lambda k: k % 50 == 0)


def test_nearest_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, "vec_id % 50 = 0").count() == 0
    zeros = spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(zeros, "vec_id % 50 = 0").count() == 0


def test_bounds_hold():
    """No cosine is further from the estimate of its tile than the tile says."""
    rng = np.random.default_rng(6)
    m = rng.standard_normal((300, 24)) * np.where(rng.random((300, 24)) < 0.2, 30, 1)
    codes, step, lost, left = ann.quantise(m)
    b = ann._Block.__new__(ann._Block)
    b.codes, b.step, b.lost, b.left = codes, step, lost, left
    cosine, off = ann.tile(b, b)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    error = np.abs(unit @ unit.T - cosine)
    assert (error <= off).all() and off.max() < 0.1 and error.max() > 1e-4


def _runs(w: list, copies: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by going through all periods."""
    seen: dict = {}
    for q in range(1, len(w) // copies + 1):
        k = 0
        while k + q < len(w):
            to = k
            while to + q < len(w) and w[to] == w[to + q]:
                to += 1
            if to > k and to + q - k >= max(shortest, copies * q):
                seen.setdefault((k, to + q - k), q)
            k = max(to, k) + 1
    return sorted((s, n, q) for (s, n), q in seen.items())


def test_runs_of_many_sequences():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
            w = [rng.randrange(letters) for _ in range(n)]
            p, at = rng.randint(1, 6), rng.randint(0, n)
            for i in range(at + p, min(n, at + p * rng.randint(1, 8))):
                w[i] = w[i - p]
            texts.append(w)
        copies, shortest = rng.choice([2, 3, 4]), rng.choice([1, 4, 6])
        flat, counts = np.array([x for w in texts for x in w], np.uint64), np.array([len(w) for w in texts])
        got = zip(*(x.tolist() for x in periodic_runs.runs_of(periodic_runs.SuffixArray(flat, counts), copies, shortest)), strict=True)
        want, at = [], 0
        for w in texts:
            want += [(s + at, s + n + at, q) for s, n, q in _runs(w, copies, shortest)]
            at += len(w)
        assert list(got) == sorted(want, key=lambda r: (r[0], r[2]))


def _planted(doc: int, w: list[str]) -> list[str]:
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def _digests(w: list[str], runs: list) -> tuple:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *top, _h(text), _h(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_periodic_runs_query(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for doc, text in texts:
        w = _planted(doc, brute.words(text))
        if len(w) < 4000:
            assert got[doc] == _digests(w, _runs(w))
    assert len(got) == len(texts) and sum(r[0] > 0 for r in got.values()) > 10


def test_periodic_runs_odd_and_empty(spark, odd, empty):  # noqa: F811
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == 12 and periodic_runs.periodic_runs(empty).count() == 0
    assert [(r.n_words, r.runs, r.collapsed_text) for r in rows if r.doc_id in (3, 4, 5)] == [(0, [], "")] * 3
    loops = [(1, "x " * 50_000), (2, "a b  a\tb a b a b a b c"), (2, "ab ab ab ab ab ab"), (3, "no loop here")]
    df = spark.createDataFrame(loops, "doc_id long, text string")
    got = sorted((r.doc_id, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs.periodic_runs(df).collect())
    assert got == [
        (1, [(0, 50_000, 1)], "x"), (2, [(0, 6, 1)], "ab"), (2, [(0, 10, 2)], "a b c"), (3, [], "no loop here"),
    ]


def test_one_suffix_array_for_many_texts():
    """Texts of a batch do not see each other's words."""
    words, counts = hash_words([b"a b a b", b"a b a b", b"", b"a b a b a b a b"])
    start, end, period = periodic_runs.runs_of(periodic_runs.SuffixArray(words, counts), 4, 6)
    assert (start.tolist(), end.tolist(), period.tolist()) == ([8], [16], [2])
