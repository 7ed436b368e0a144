"""Operators on documents: against loops, and on odd tables."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from check import compare
from conftest import SF
from pyspark.sql import functions as F

from zonecast.llm import (
    encode,
    exact_dedup,
    gru,
    hashing,
    lm,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    substring_dedup,
    token_counts,
)
from zonecast.llm.catalog import QUERIES, SQL
from zonecast.session import stage

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def real():
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, names that clash with result columns."""
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(20_000))
    text = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, text, "en", "a", 5), (2, text, "en", "a", 5), (2, text, "en", "a", 5), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \n\t", "de", None, 3), (6, long, "en", "a", None), (7, long + " end", "fr", "b", 1),
        (None, "no id here", "en", "a", 10), (8, "same", "en", "c", 4), (9, "s a\tm e", "en", "c", 4), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    clash = ["kept", "size", "score", "length", "bit", "node", "pick", "block", "group", "target", "base", "digest"]
    return stage(df.withColumns({c: F.lit("clash") for c in clash}).repartition(3), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()) == "ok"


NO_LABELS = "doc_id long, quality int, toxic int"
WHOLE = {
    "exact": exact_dedup.exact_groups,
    "near": near_dedup.near_groups,
    "substring": substring_dedup.remove_repeats,
    "pii": pii.find_pii,
    "lm": lm.score_documents,
    "quality": lambda d: quality.score(d, *quality.fit(d, d.sparkSession.createDataFrame([], NO_LABELS))),
    "mixing": lambda d: mixing.mix(d, mixing.word_count(F.col("text"))),
}


@pytest.mark.parametrize("name", WHOLE)
def test_one_row_per_document(odd, empty, name):
    assert WHOLE[name](odd).count() == 12
    assert WHOLE[name](empty).count() == 0


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, near_dedup.drop_near_copies, mixing.mixed_documents])
def test_stages_keep_columns(odd, empty, drop):
    assert drop(odd).columns == odd.columns and drop(odd).count() > 0
    assert drop(empty).columns == empty.columns and drop(empty).count() == 0


def test_exact_groups(odd):
    rows = exact_dedup.exact_groups(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    assert sorted(len(g) for g in by.values()) == [1, 1, 1, 2, 3, 4]
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    keep = {r.doc_id: r.keep_id for r in rows}
    assert keep[2] == 1 and keep[8] == 9 and keep[3] == keep[4] == 5
    assert exact_dedup.drop_copies(odd).count() == 6


def test_filter_lets_every_repeat_through(spark):
    """A full filter (one piece of bits for many rows) changes no group."""
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.sha2((F.col("id") % 50_000).cast("string"), 256).alias("digest")
    )
    flagged = exact_dedup.flag_possible(rows, "digest", exact_dedup.repeat_filter(rows, 1 << 15), 1 << 15, "maybe")
    assert flagged.where("(doc_id % 50000 < 10000) AND NOT maybe").isEmpty()


def test_near_groups(spark, real):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_near_dedup"](spark, SF).collect()}
    assert got == brute.near_components(real)


def test_near_groups_chain_and_ring(spark):
    """Links that no first centre sees: a chain of small edits is one component, its ends alone are not."""
    rng = random.Random(2)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(120)]
    docs = []
    for k in range(40):
        docs.append((k, " ".join(base)))
        base[(k * 7) % 120] = f"new{k}"
    docs += [(100 + k, " ".join(rng.choice("abc") for _ in range(6))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect()}
    assert got == brute.near_components(docs)


def test_sketch_agrees_like_the_sets():
    rng = np.random.default_rng(1)
    for n in (4, 20, 300):
        same = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 4 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(np.r_[both, both[:0]]), np.unique(np.r_[both[: 3 * n], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])
            same.append((near_dedup.sketch(a) == near_dedup.sketch(b)).mean())
        assert abs(np.mean(same) - 3 * n / (4 * n + 1)) < 0.06


def test_substring(spark, real):
    got = QUERIES["op5_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.without_repeats(real)


def test_substring_at_all_shifts(spark):
    """Passages of 33 to 60 words at every alignment, a repeated word, and a repeat inside one document."""
    rng = random.Random(9)
    fresh = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    docs = []
    for n in (33, 34, 35, 36, 45, 60):
        for shift in range(0, 21, 4):
            p = fresh(n)
            docs.append((len(docs), " ".join(fresh(shift) + p + fresh(3))))
            docs.append((len(docs), " ".join(fresh(9) + p)))
    p = fresh(40)
    docs += [(1000, " ".join(p + fresh(5) + p)), (1001, "for " * 100), (1002, "for " * 35), (1003, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = substring_dedup.remove_repeats(df, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.without_repeats(docs)


def test_cover_has_every_difference():
    c, p = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_pii_base_spans(spark, real):
    texts = dict(real)
    for r in QUERIES["op6_pii"](spark, SF).collect():
        want = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == __import__("hashlib").sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in brute.PII]


def test_pii_patterns_match_like_the_plain_ones(spark):
    rng = random.Random(4)
    parts = ["a", "b@c.d", "@", ".", "-", "_", "1", "255", "256", "+", " ", "(", ")", "é", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "\n", "🙂"]
    docs = [(k, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for k in range(3000)]
    docs += [(5000, "1 " * 20_000), (5001, "1" * 20_000), (5002, "a" * 100_000), (5003, "1." * 4000)]
    found = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = {r.doc_id: r.spans for r in found.select("doc_id", pii._joined(F.col("base")).alias("spans")).collect()}
    assert got == {k: ",".join(brute.base_spans(t)) for k, t in docs}


def test_pii_adds_what_labelers_agree_on(spark):
    docs = [(k, f'text here token = "{k:08x}b{k:07d}aaf0c1d2e3" and more, mail x{k}@y.org') for k in range(40)]
    docs += [(100 + k, f"order no {k:03d}-44-{k:04d} was sent") for k in range(40)]
    docs += [(200 + k, f"my ssn: {100 + k}-45-{6700 + k}") for k in range(40)]
    rows = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kinds = {r.doc_id: {s.kind for s in r.added} for r in rows}
    assert all(kinds[k] == {"secret"} for k in range(40)) and all(kinds[200 + k] == {"national_id"} for k in range(40))
    assert not any(kinds[100 + k] for k in range(40))


def test_pii_time_grows_with_the_text(spark):
    """Runs of a million characters, and a text of a hundred thousand numbers: each takes seconds.

    A run that holds a valid card number is no candidate: base spans come first.
    """
    rng = random.Random(1)
    run = "".join(rng.choices("abcdefghijklmnopqXYZ012", k=1_000_000))
    with_cards = "".join(rng.choices("abcdefXYZ0123456789", k=1_000_000))
    numbers = " ".join(f"n{k}" for k in range(100_000))
    found = []
    for text in (run, with_cards, numbers):
        text = "token = " + text + " mail a@b.cd"
        df = stage(spark.createDataFrame([(1, text)], "doc_id long, text string"), "long")
        begin = time.perf_counter()
        found.append(pii.candidates(df).collect()[0])
        assert time.perf_counter() - begin < 20
    bases = [[f"{s.kind}:{s.start}:{s.end}" for s in row.base] for row in found]
    assert bases[0] == ["email:1000014:1000020"]
    assert bases[2] == brute.base_spans(text)
    assert [(s.kind, s.start, s.end) for s in found[0].loose] == [("secret", 8, 1_000_008)]
    assert found[0].loose[0].variety == 1
    assert any(s.startswith("card:") for s in bases[1]) and not found[1].loose


def test_lm_base_and_held_out(spark, real):
    rows = QUERIES["op4_lm_scoring"](spark, SF).collect()
    want = brute.base_scores(real)
    assert len(rows) == len(real)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-6)


def test_lm_beats_word_counts_on_held_out_text(spark):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    score, base = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_lm_trains_on_every_training_document_whole(real):
    """Each document that is not held out is in one round, from its first token to its end."""
    texts = [(t or "").encode() for _, t in real] + [b"long " * 5000]
    ids = [d for d, _ in real] + [next(d for d in range(10**6, 10**7) if not lm.held_out(d))]
    hashes, sizes = lm._tokens(texts)
    row = dict(zip(("sizes", "hashes", "codes"), lm._numbered(texts), strict=True), docs=ids)
    block = lm._Block(row)
    assert (block.distinct[block.codes] == hashes).all() and (np.diff(block.distinct) > 0).all()
    symbols = lm._Symbols(np.unique(hashes))
    rounds = [lm._whole_texts(row, symbols, k) for k in range(lm.ROUNDS)]
    train = [not lm.held_out(d) for d in ids]
    assert sorted(len(x) for r in rounds for x in r) == sorted(sizes[train].tolist())


@pytest.mark.parametrize("ranges", [1, 3, 8, 10**6])
def test_only_ranges_that_occur_are_visited(ranges):
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64))
    hashes = np.concatenate([np.zeros(1, np.uint64), hashes, np.full(1, (1 << 64) - 1, np.uint64)])
    parts = hashing.by_range(hashes, ranges)
    assert len(parts) <= len(hashes) and [lo for _, lo, _ in parts[1:]] == [hi for _, _, hi in parts[:-1]]
    assert parts[0][1] == 0 and parts[-1][2] == len(hashes) and parts[-1][0] == ranges - 1
    step = (1 << 64) // ranges
    assert all(min(int(h) // step, ranges - 1) == r for r, lo, hi in parts for h in hashes[lo:hi])
    assert hashing.by_range(hashes[:0], ranges) == []


def test_gru_lanes_start_each_text_anew():
    """Texts one after the other in a lane give the gradient of the same texts side by side."""
    rng, classes, w = _tiny()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    texts = [rng.integers(0, classes.n + 1, n) for n in (9, 6, 5, 0, 3)]
    found = []
    for lanes in (1, 2, 5):
        squares = {k: np.zeros_like(v) for k, v in w.items()}
        assert gru.train({k: v.copy() for k, v in w.items()}, classes, texts, squares, rate=0.0, lanes=lanes) == 23
        found.append(np.concatenate([squares[k].ravel() for k in gru.SHAPES]))
    assert np.allclose(found[0], found[2], rtol=1e-6) and np.allclose(found[1], found[2], rtol=1e-6)


def _tiny():
    rng = np.random.default_rng(3)
    classes = gru.Classes(np.array([50.0, 30, 20, 9, 8, 7, 3, 2, 1]), 12.0)
    w = {k: v + (rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in gru.initial(classes, 5).items()}
    return rng, classes, w


def test_gru_probabilities_sum_to_one_and_ignore_the_batch():
    rng, classes, w = _tiny()
    every = [np.array([2, 5, k]) for k in range(classes.n + 1)]
    before = gru.scores(w, classes, [np.array([2, 5])])[0]
    assert np.exp(gru.scores(w, classes, every) - before).sum() == pytest.approx(1, abs=1e-4)
    texts = [rng.integers(0, classes.n + 1, n) for n in (0, 1, 200, 70, 64)]
    alone = [gru.scores(w, classes, [t], window=1000)[0] for t in texts]
    assert np.allclose(gru.scores(w, classes, texts, window=64), alone, rtol=1e-4)


def test_gru_gradient():
    """One step along the gradient changes the loss as finite differences say."""
    rng, classes, w = _tiny()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    texts = [rng.integers(0, classes.n + 1, n) for n in (7, 5)]
    for name in gru.SHAPES:
        moved = {k: v.copy() for k, v in w.items()}
        squares = {k: np.zeros_like(v) for k, v in w.items()}
        gru.train(moved, classes, texts, squares, window=24, rate=0.0)
        slope = np.sqrt(squares[name]) * np.sqrt(12)
        at = np.unravel_index(np.argmax(slope), slope.shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        change = (gru.scores(up, classes, texts).sum() - gru.scores(down, classes, texts).sum()) / 2e-4
        assert abs(change) == pytest.approx(slope[at], rel=0.02)


def test_quality(spark):
    """On labelled rows that nothing was learnt from: what the labels say, but for their noise."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id").unionByName(docs.join(labels.select("doc_id"), "doc_id", "left_anti").limit(1500))
    docs = stage(docs, "some")
    seen = labels.where("doc_id % 3 > 0")
    model, clean, words = quality.fit(docs, seen)
    assert min(*model.handed, *clean.handed) > 0 and len(words) > 100
    rows = quality.score(docs, model, clean, words).join(labels.where("doc_id % 3 = 0"), "doc_id").select("good", "quality", "toxic").collect()
    share = lambda pick: np.mean([r.good for r in rows if pick(r)])
    assert share(lambda r: r.quality and not r.toxic) > 0.97
    # About one label in five of the toxic ones is noise in these tables.
    assert share(lambda r: not r.quality) < 0.15 and share(lambda r: r.quality and r.toxic) < 0.35


def test_quality_of_odd_rows(spark, odd):
    """Fitted models on nulls, long texts, clashing columns and an id that a third of all rows repeat."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = labels.orderBy("doc_id").first().doc_id
    many = base.where(F.col("doc_id") == first).crossJoin(spark.range(100)).drop("id")
    clash = odd.withColumns({"quality": F.lit("x"), "sign": F.lit("x"), "marks": F.lit("x"), "clean": F.lit("x")})
    docs = clash.unionByName(base, allowMissingColumns=True).unionByName(many, allowMissingColumns=True)
    more = spark.createDataFrame(
        [(1, 1, 0), (2, 0, None), (3, None, 1), (5, 1, 0), (6, 1, 1), (None, 1, 1), (10**9, 0, 0), (first, 1, 1)], NO_LABELS
    )
    fitted = quality.fit(docs, labels.unionByName(more))
    assert fitted[0] and fitted[1]
    scored = quality.score(docs, *fitted)
    assert scored.count() == docs.count()
    assert scored.where("quality_score is null or clean_score is null or isnan(quality_score) or isnan(clean_score)").isEmpty()
    added = ["content_score", "metadata_score", "quality_score", "clean_score", "good"]
    assert scored.columns == [*docs.columns, *added]


def test_views_hand_over_labels():
    """Rows that the other view labelled make up for few labelled ones."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000).astype(float)
    views = [(y[:, None] * 1.2 + rng.standard_normal((4000, 5))).astype(np.float32) for _ in range(2)]
    few, fold = np.arange(200), np.arange(200) % 4 == 0
    free = np.arange(200, 4000)
    none = [(v[:0], y[:0]) for v in views]
    model = quality.fit_views([v[few] for v in views], y[few], fold, none)
    for _ in range(2):
        handed = []
        for v in (1, 0):
            z = model.views[v].logit(views[v][free])
            sure = np.concatenate([free[np.argsort(z)[:300]], free[np.argsort(-z)[:300]]])
            handed.append((views[1 - v][sure], np.repeat([0.0, 1.0], 300)))
        model = quality.fit_views([v[few] for v in views], y[few], fold, handed)
    assert model.handed == (600, 600)
    assert ((model.scores(*views)[2] > 0.5) == y).mean() > 0.95


def test_features_of_a_batch_are_those_of_each_text():
    rng = random.Random(4)
    texts = [b"", b"ab", b"abc", b"one two two", b"It's, (bad)!\n" * 40] + [bytes(rng.choices(range(32, 127), k=200)) for _ in range(20)]
    vocabulary = np.sort(np.unique(quality.word_hashes([b"bad it two"])[0]))
    together = quality.content_features(texts), quality.word_features(texts, vocabulary)
    for k, t in enumerate(texts):
        assert np.allclose(together[0][k], quality.content_features([t])[0])
        assert (together[1][k] == quality.word_features([t], vocabulary)[0]).all()
    cells = together[0] ** 2
    assert np.allclose(cells.sum(1), [min(max(len(t) - 2, 0), 1) for t in texts], atol=1e-5)
    assert together[1][3].sum() == 1 and together[1][4].sum() == 2


def test_encoder_gives_the_ids_of_the_library(real):
    from tokenizers import Tokenizer

    path = encode.default_vocabulary()
    reference = Tokenizer.from_file(path)  # as it comes: added tokens stand for themselves
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n ", "a", "b'", "'s", "é", "9", "\t", "\xa0", " ", "<|endoftext|>", "don't", " 's", "中文", "🙂", "_"]
    texts = [t for _, t in real] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch_fast(texts, add_special_tokens=False)]
    coder = encode.encoder(path)
    assert [coder.ids(t) for t in texts] == want
    marked = np.frombuffer(coder.ids("a <|endoftext|> b<|endoftext|><|endoftext|>"), "<u4").tolist()
    assert marked == [64, 220, 50256, 275, 50256, 50256]


def _check_packing(rows, docs, window=2048):
    coder = encode.encoder(encode.default_vocabulary())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, text in docs:
        ids = coder.ids(text or "") + (1).to_bytes(4, "little")
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start * 4 == at and r.doc_tokens * 4 == len(ids)
            assert zlib.crc32(ids[at : at + 4 * r.length]) == r.ids_crc32
            at += 4 * r.length
        assert at == len(ids)
    assert not by_doc
    total = sum(n for p in bins.values() for _, n in p)
    return len(bins) - total / window


def test_packing(spark, real):
    """The slack of all sequences together stays below two windows: only the last few have any."""
    assert _check_packing(QUERIES["op2_packing"](spark, SF).collect(), real) < 2


def test_packing_odd(odd, empty):
    rows = packing.packed_documents(odd).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_tokens == 1) == 3
    assert packing.packed_documents(empty).count() == 0


def test_slack_is_least():
    """The pattern fills the room as well as trying all multisets does."""
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        used = packing.fill(counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in used.items())


def test_token_counts(spark, real):
    sf = SF
    hist = token_counts.histogram(spark.read.parquet(f"{sf}/documents.parquet"))
    table = token_counts.context_table(hist)
    coder = encode.encoder(encode.default_vocabulary())
    sources = dict(duckdb.connect().execute(f"SELECT doc_id, source FROM '{sf}/documents.parquet'").fetchall())
    lengths = defaultdict(list)
    for doc, text in real:
        lengths[sources[doc]].append(len(coder.ids(text)) // 4)
    rows = table.collect()
    assert sum(r.n_docs for r in rows) == len(real)
    for r in rows:
        own = lengths[r.group]
        assert r.n_docs == own.count(r.length) and r.docs_below == sum(n < r.length for n in own)
        assert r.truncated_total == sum(min(n, r.length) for n in own) and r.total_tokens == sum(own)
    for limit in (1, 100, 2048, 10**6):
        for r in token_counts.at_limit(table, limit).collect():
            own = lengths[r.group]
            assert (r.docs_cut, r.tokens_kept) == (sum(n > limit for n in own), sum(min(n, limit) for n in own))
    half = {r.group: r.length for r in token_counts.quantile(table, 0.5).collect()}
    assert half == {s: sorted(own)[-(-len(own) // 2) - 1] for s, own in lengths.items()}


def test_token_counts_odd(odd, empty):
    rows = token_counts.context_table(token_counts.histogram(odd)).collect()
    assert sum(r.n_docs for r in rows) == 12 and {r.group for r in rows} == {None, "a", "b", "c"}
    assert token_counts.context_table(token_counts.histogram(empty)).count() == 0


def test_mixing_targets_and_reruns(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("source"))
    )
    run = lambda: mixing.mix(docs, mixing.word_count(F.col("text"))).select("doc_id", "source", "size", "source_size", "target", "taken")
    rows = run().collect()
    assert sorted(map(str, rows)) == sorted(map(str, run().repartition(5).collect()))
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    total = sum(r.size for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(odd.where("doc_id in (3, 4, 5)"), mixing.word_count(F.col("text"))).agg(F.sum("taken")).first()[0] == 0


def test_pii_long_runs_are_candidates(spark):
    docs = [(k, f'token = "{"a1B2c3D4" * (3 + 80 * k)}" end') for k in range(3)]
    found = pii.candidates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [[(s.kind, s.end - s.start) for s in r.loose] for r in sorted(found)] == [[("secret", 8 * (3 + 80 * k))] for k in range(3)]


def test_trigrams_of_many_short_texts_stay_small():
    """Counts of 512 short texts are made a few texts at a time (before: 17 MB at once)."""
    import tracemalloc

    from zonecast.llm import quality

    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(0, 500, 512)]
    tracemalloc.start()
    x = quality.content_features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 and np.array_equal(x, np.concatenate([quality.content_features([t]) for t in texts]))


def test_fit_holds_one_copy_of_the_training_rows():
    """A view's training rows are copied once and standardised in place (before: 27 MB for these rows)."""
    import tracemalloc

    rng = np.random.default_rng(3)
    y, fold = (rng.random(3000) < 0.5).astype(float), rng.random(3000) < 0.25
    views = [rng.random((3000, n)).astype(np.float16) for n in (1024, 36)]
    views[0][:, 0] += y.astype(np.float16)
    wide, none = [v.astype(np.float32) for v in views], [(v[:0], y[:0]) for v in views]
    fitted = []
    for x in (wide, views):
        tracemalloc.start()
        fitted.append(quality.fit_views(x, y, fold, none))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20_000_000
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(*(m.views for m in fitted), strict=True))


def test_texts_reach_python_in_small_batches(spark):
    """One split's 2,000 texts come to a worker in batches of at most 512 rows (before: all at once); fewer, if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(2000).selectExpr("id as doc_id", "'a b' as text").coalesce(1)
    labels = spark.createDataFrame([], NO_LABELS)
    rows = lambda: docs.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), docs.schema).count()
    try:
        spark.conf.unset(key)
        assert rows() == 1
        for use in (lambda: quality.fit(docs, labels), lambda: near_dedup.near_groups(docs), lambda: packing.packed_documents(docs)):
            spark.conf.unset(key)
            use()
            assert rows() == 4
        spark.conf.set(key, "100")
        quality.fit(docs, labels)
        assert rows() == 20
    finally:
        spark.conf.unset(key)
