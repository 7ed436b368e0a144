"""Quality by co-training: two views of a document teach each other.

For quality the views are its content (frequencies of hashed byte trigrams) and
its page metadata (source, language, length and layout).  For toxicity, which no
metadata shows, they are the content and the presence of the words that differ
most between the classes.  Each view has a logistic classifier.  In every round
all unlabelled documents are scored, and each classifier hands those it is
surest of, over the whole corpus, to the other one.  In the end the two are
calibrated on labelled documents that neither was trained on, and their
calibrated logits are added.

The labelled documents that are learnt from are a sample of at most ``labelled``,
those with the smallest hash of the id.  The fit runs in one task, on that sample
and the documents handed over; nothing but the weights reaches the driver.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import slices, small_batches, table, utf8
from .hashing import hash_words

TRIGRAMS, SOURCES, LANGS, LAYOUT = 1024, 16, 8, 12
METADATA = LAYOUT + LANGS + SOURCES
#: Bytes of text whose features are computed at once (a longer text is on its own), and texts whose trigrams are counted at once.
CHUNK, COUNTED = 1 << 18, 64


@dataclass(frozen=True)
class CoTraining:
    """Documented bounds and settings.

    ``labelled``: labelled documents to learn from.  ``handed``: documents that a
    view hands over a round, shared out by the classes' shares.  ``words``: size
    of the word view.  ``floor``: share of good held-out documents that the cut
    may reject; a few wrong labels do not move it.
    """

    labelled: int = 4000
    rounds: int = 2
    handed: int = 400
    words: int = 512
    floor: float = 0.01


#: The targets: column of labels, whether 1 is the bad class, and the two views as columns of the features.
QUALITY, CLEAN = 0, 1
VIEWS = ((0, 1), (0, 2))
_APART = bytes(32 if chr(b) in ".,;:!?\"'()" else b for b in range(256))


def _pieces(n: int, size: int = 1 << 20) -> Iterator[slice]:
    """Pieces of an array of bytes that share two bytes, so that every trigram lies in one."""
    for at in range(0, max(n - 2, 0), size):
        yield slice(at, at + size + 2)


def content_features(texts: Sequence[bytes]) -> np.ndarray:
    """Square roots of trigram shares: byte triples hashed into ``TRIGRAMS`` cells."""
    if len(texts) > COUNTED:
        return np.concatenate([content_features(texts[k : k + COUNTED]) for k in range(0, len(texts), COUNTED)])
    counts = np.zeros(len(texts) * TRIGRAMS, np.int64)
    sizes = np.array([len(t) for t in texts])
    joined, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
    for piece in _pieces(len(joined)):
        b = joined[piece].astype(np.uint32)
        place = piece.start + np.arange(len(b) - 2)
        own = np.searchsorted(ends, place, side="right")
        key = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1]) * np.uint32(0x01000193) ^ b[2:]
        cell = own * TRIGRAMS + ((key * np.uint32(0x9E3779B1)) >> np.uint32(22))
        counts += np.bincount(cell[place + 2 < ends[own]], minlength=len(counts))
    return np.sqrt(counts.reshape(-1, TRIGRAMS) / np.maximum(sizes - 2, 1)[:, None]).astype(np.float32)


def metadata_features(texts: Sequence[bytes], langs: Sequence, sources: Sequence, n_chars: Sequence) -> np.ndarray:
    """Length and layout, then hashed language and source; null language or source is a value of its own."""
    k = len(texts)
    sizes = np.array([len(t) for t in texts])
    n = np.maximum(sizes, 1)
    b = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]).astype(float)
    hashes, words = hash_words(texts)
    own = np.repeat(np.arange(k), words)
    order = np.lexsort((hashes, own))
    new = np.diff(hashes[order], prepend=np.uint64(0)) != 0
    first = np.cumsum(words) - words
    new[first[words > 0]] = True
    different = np.bincount(own[new], minlength=k)
    lines = b[:, 10] + 1
    letters = b[:, 65:91].sum(1) + b[:, 97:123].sum(1)
    marks = b[:, 33:48].sum(1) + b[:, 58:65].sum(1) + b[:, 91:97].sum(1) + b[:, 123:127].sum(1)
    x = np.zeros((k, METADATA), np.float32)
    x[:, :LAYOUT] = np.stack(
        [
            np.log1p(n) / 10,
            np.log1p([max(c or 0, 0) for c in n_chars]) / 10,
            np.log1p(lines) / 5,
            np.log1p(n / lines) / 10,
            np.minimum(sizes / np.maximum(words, 1), 20) / 20,
            different / np.maximum(words, 1),
            b[:, 65:91].sum(1) / np.maximum(letters, 1),
            b[:, 48:58].sum(1) / n * 10,
            marks / n * 5,
            b[:, 128:].sum(1) / n * 5,
            b[:, 32] / n * 3,
            b[:, :32].sum(1) / n * 10,
        ],
        axis=1,
    )
    row = np.arange(k)
    x[row, [LAYOUT + zlib.crc32(f"l{v}".encode()) % LANGS for v in langs]] = 1
    x[row, [LAYOUT + LANGS + zlib.crc32(f"s{v}".encode()) % SOURCES for v in sources]] = 1
    return x


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in small letters without marks around them, and the number of them in each text."""
    return hash_words([t.translate(_APART) for t in texts], lower=True)


def word_features(texts: Sequence[bytes], vocabulary: np.ndarray) -> np.ndarray:
    """Which words of the sorted vocabulary a text holds."""
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    if len(vocabulary):
        hashes, counts = word_hashes(texts)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[at] == hashes
        x[np.repeat(np.arange(len(texts)), counts)[known], at[known]] = 1
    return x


def _features(batch: pa.RecordBatch, vocabulary: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first row, last row, views) of a batch that begins with the columns of ``INPUT``."""
    texts = [t or b"" for t in utf8(batch.column(0))]
    langs, sources, n_chars = (batch.column(k).to_pylist() for k in (1, 2, 3))
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to])
            to += 1
        part = texts[at:to]
        yield at, to, (
            content_features(part),
            metadata_features(part, langs[at:to], sources[at:to], n_chars[at:to]),
            word_features(part, vocabulary),
        )
        at = to


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.logit(x) + self.shift, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3, scratch: bool = False) -> Linear:
    """Class-balanced logistic regression by accelerated gradient steps on standardised columns.

    What is summed over the rows is made of a few columns or rows at a time; ``scratch``: ``x`` is overwritten, not copied.
    """
    mean = x.mean(0)
    scale = np.concatenate([x[:, k : k + 64].std(0) for k in range(0, x.shape[1], 64)]) + 1e-3
    z = np.subtract(x, mean, out=x if scratch else None)
    z /= scale
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    squares = np.concatenate([(z[k : k + 256] ** 2).sum(1) for k in range(0, len(z), 256)])
    rate = 4.0 / (float(squares.mean()) + 1)
    w, b = np.zeros(x.shape[1], z.dtype), 0.0
    vw, vb = w, b
    for k in range(steps):
        slope = (weight * (_sigmoid(z @ vw + vb) - y)).astype(z.dtype)
        nw, nb = vw - z.dtype.type(rate) * (z.T @ slope + z.dtype.type(penalty) * vw), vb - rate * float(slope.sum())
        m = k / (k + 3)
        vw, vb = nw + z.dtype.type(m) * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return Linear(w, float(b), mean, scale)


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray, steps: int = 500) -> Linear:
    """Platt scaling: a slope and a shift of the logit."""
    z = model.logit(x)
    spread = z.std() + 1e-9
    z = z / spread
    a, b = 1.0, 0.0
    for _ in range(steps):
        e = _sigmoid(a * z + b) - y
        a, b = a - 0.5 * ((e * z).mean() + 1e-3 * a), b - 0.5 * e.mean()
    return Linear(model.weights, model.bias, model.mean, model.scale, max(a, 0.0) / spread, b)


@dataclass(frozen=True)
class QualityModel:
    """``good``: share of the good class among the labelled rows; ``loss`` and ``catch``: what the cut
    rejects of the good and the bad held-out rows; ``handed``: rows that each view got from the other."""

    views: tuple[Linear, Linear]
    cut: float
    good: float
    loss: float
    catch: float
    handed: tuple[int, int]

    def scores(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views[0].calibrated(first), self.views[1].calibrated(second)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b)


def fit_views(
    views: Sequence[np.ndarray], y: np.ndarray, fold: np.ndarray,
    handed: Sequence[tuple[np.ndarray, np.ndarray]], cap: float | None = 0.5, floor: float = 0.01,
) -> QualityModel | None:
    """Fit, calibrate and cut.  ``fold``: rows kept for calibration; ``handed``: (rows, labels) that each view was given.

    Views may be halves; the training rows of one view at a time are widened.
    Rejected is what scores below ``cap`` (None: the share of the good class,
    where scores of two views that each hold the prior are even), and below
    nearly all good held-out rows.  None when the training rows hold one class only.
    """
    train = ~fold
    if len(set(y[train].tolist())) < 2 or not fold.any():
        return None
    own = []
    for x, (more, label) in zip(views, handed, strict=True):
        rows = np.concatenate([x[train], more], dtype=np.result_type(x, more, np.float32))
        own.append(calibrate(fit_logistic(rows, np.concatenate([y[train], label]), scratch=True), x[fold], y[fold]))
        del rows
    good = float(y.mean())
    both = _sigmoid(own[0].calibrated(views[0][fold]) + own[1].calibrated(views[1][fold]))
    kept, bad = both[y[fold] > 0.5], both[y[fold] < 0.5]
    cap = good if cap is None else cap
    cut = min(cap, float(np.quantile(kept, floor))) if len(kept) else cap
    shares = [float((x < cut).mean()) if len(x) else 0.0 for x in (kept, bad)]
    return QualityModel((own[0], own[1]), cut, good, *shares, tuple(len(label) for _, label in handed))


SCORES = ("content_score", "metadata_score", "quality_score")
INPUT = ("text", "lang", "source", "n_chars")
#: A document in the training set: its labels (null: none) or what it was handed for (target, view, label).
MARKS = "array<struct<target:int,view:int,label:double>>"
TRAINING = f"doc_id long, quality double, clean double, marks {MARKS}, x binary"


def _inputs(docs: DataFrame) -> list[Column]:
    """The columns that the views need; those that the table lacks count as null."""
    types = {"n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in INPUT]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, the inputs, and ``sign``, a hash of them all: equal rows are one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs))
    return rows.withColumn("sign", F.xxhash64("doc_id", *INPUT))


def held_out(doc: int) -> bool:
    return zlib.crc32(f"fold{doc}".encode()) % 4 == 0


def _vocabulary(labelled: DataFrame, size: int) -> np.ndarray:
    """Hashes of the words that differ most between the classes of the rows that are trained on, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            keep = [k for k, doc in enumerate(batch.column(1).to_pylist()) if not held_out(doc)]
            texts = utf8(batch.column(0))
            toxic = np.array(batch.column(2).to_pylist()) < 0.5
            for k in keep:
                words = np.unique(word_hashes([texts[k] or b""])[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array(np.full(len(words), int(toxic[k])), pa.int64())], ["word", "toxic"]
                )

    rows = labelled.where("clean is not null").select("text", "doc_id", "clean").mapInArrow(run, "word long, toxic long")
    total = labelled.where("clean is not null").agg(F.count_if(F.col("clean") < 0.5).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not total.bad or total.bad == total.n:
        return np.empty(0, np.uint64)
    bad, good = float(total.bad), float(total.n - total.bad)
    counted = rows.groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    share = F.col("n") / (bad + good)
    apart = F.abs(F.col("a") / bad - (F.col("n") - F.col("a")) / good) / F.sqrt(share * (1 - share) + 1e-9)
    # At most ``size`` words.
    best = counted.orderBy(F.desc(apart), "word").limit(size).select("word").collect()
    return np.sort(np.array([r.word for r in best], np.int64).view(np.uint64))


def _training_rows(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows (inputs, doc_id, quality, clean, marks) with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            x = [np.concatenate(v).astype(np.float16).tobytes() for _, _, views in _features(batch, vocabulary) for v in zip(*views, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4, 8)), pa.array(x, pa.binary())], ["doc_id", "quality", "clean", "marks", "x"]
            )

    return stage(rows.select(*INPUT, "doc_id", "quality", "clean", F.col("marks").cast(MARKS)).mapInArrow(run, TRAINING), "training")


def _fit_all(training: DataFrame, how: CoTraining) -> list[QualityModel | None]:
    """One task fits both targets on the training rows, whose number is bounded by the settings."""

    def run(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, sort_keys=[("doc_id", "ascending")])
        blobs = t.column("x")
        x = np.empty((t.num_rows, len(blobs[0].as_buffer()) // 2), np.float16)
        for k, at in enumerate(order.to_pylist()):
            x[k] = np.frombuffer(blobs[at].as_buffer(), np.float16)
        t = t.drop_columns("x").take(order)
        del blobs
        views = x[:, :TRIGRAMS], x[:, TRIGRAMS : TRIGRAMS + METADATA], x[:, TRIGRAMS + METADATA :]
        ids, marks = t.column("doc_id").to_pylist(), t.column("marks").to_pylist()
        out = []
        for target, name in ((QUALITY, "quality"), (CLEAN, "clean")):
            own = [views[v] for v in VIEWS[target]]
            y = np.array([np.nan if v is None else float(v >= 0.5) for v in t.column(name).to_pylist()])
            has = np.flatnonzero(~np.isnan(y))
            handed = []
            for view in (0, 1):
                given = [(k, m["label"]) for k, all_ in enumerate(marks) for m in all_ or () if (m["target"], m["view"]) == (target, view)]
                at = np.array([k for k, _ in given], np.int64)
                handed.append((own[view][at], np.array([label for _, label in given], float)))
            fold = np.array([held_out(ids[k]) for k in has], bool)
            out.append(fit_views([v[has] for v in own], y[has], fold, handed, 0.5 if target == QUALITY else None, how.floor))
        return pa.table({"models": pa.array([pickle.dumps(out)], pa.binary())})

    rows = training.withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(run, "models binary").collect()
    return pickle.loads(rows[0].models) if rows else [None, None]


LOGITS = [f"z{t}{v}" for t in (QUALITY, CLEAN) for v in (0, 1)]


def _logits(rows: DataFrame, models: list[QualityModel | None], vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, sign, logits) of every row, written; a target without a model has nulls."""
    shared = rows.sparkSession.sparkContext.broadcast((models, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, vocabulary = shared.value
        for batch in slices(batches, 512):
            z = np.full((len(LOGITS), batch.num_rows), np.nan)
            for at, to, views in _features(batch, vocabulary):
                for target, model in enumerate(models):
                    if model:
                        for v in (0, 1):
                            z[2 * target + v, at:to] = model.views[v].logit(views[VIEWS[target][v]])
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), *map(pa.array, z)], ["doc_id", "sign", *LOGITS])

    fields = ", ".join(f"{z} double" for z in LOGITS)
    return stage(rows.select(*INPUT, "doc_id", "sign").mapInArrow(run, f"doc_id long, sign long, {fields}"), "logits")


def _surest(free: DataFrame, models: list[QualityModel | None], how: CoTraining) -> DataFrame | None:
    """(sign, marks): the documents that each view is surest of, for the other view; at most ``handed`` a view and target."""
    # Documents that look alike to all views count once.  Written, as each class of each view reads it.
    free = stage(free.groupBy(*LOGITS).agg(F.min("sign").alias("sign")), "free")
    picked = None
    for target, model in enumerate(models):
        for v in (0, 1) if model else ():
            z = F.col(f"z{target}{v}")
            top = int(how.handed * model.good)
            for sure, order, n, label in ((z > 0, z.desc(), top, 1.0), (z < 0, z.asc(), how.handed - top, 0.0)):
                rows = free.where(sure & ~F.isnan(z)).orderBy(order, "sign").limit(n)
                mark = F.struct(F.lit(target).alias("target"), F.lit(1 - v).alias("view"), F.lit(label).alias("label"))
                rows = rows.select("sign", mark.alias("mark"))
                picked = rows if picked is None else picked.unionByName(rows)
    return None if picked is None else picked.groupBy("sign").agg(F.collect_list("mark").alias("marks"))


def fit(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> tuple[QualityModel | None, QualityModel | None, np.ndarray]:
    """A model of ``quality``, one of being free of toxicity, and the vocabulary of the word view.

    A model is None without labels of both classes.  Labels of one document that
    disagree are averaged and rounded; null labels and labels without an id are
    passed over.  Of rows that repeat a labelled id, one is learnt from.  Rows
    without an id are unlabelled documents like others.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.avg("quality").alias("quality"), F.avg(1 - F.col("toxic")).alias("clean")).where("quality is not null or clean is not null")
    # At most ``labelled`` rows.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.labelled)
    rows = _signed(docs)
    one = F.min_by(F.struct(*INPUT), "sign").alias("row")
    labelled = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one, F.first("quality").alias("quality"), F.first("clean").alias("clean"))
    labelled = stage(labelled.select("doc_id", "quality", "clean", "row.*"), "labelled")
    vocabulary = _vocabulary(labelled, how.words)
    training = _training_rows(labelled.withColumn("marks", F.lit(None)), vocabulary)
    handed = None
    for round_ in range(how.rounds + 1):
        models = _fit_all(training, how)
        if round_ == how.rounds or not any(models):
            return (*models, vocabulary)
        free = _logits(rows, models, vocabulary).join(known.select("doc_id"), "doc_id", "left_anti")
        if handed is not None:
            free = free.join(F.broadcast(handed), "sign", "left_anti")
        marks = stage(_surest(free, models, how), "marks")
        # One row for each sign, as many as were picked.
        found = rows.join(F.broadcast(marks), "sign").groupBy("sign").agg(F.first(F.struct("doc_id", *INPUT)).alias("row"), F.first("marks").alias("marks"))
        none = F.lit(None).cast("double")
        training = training.unionByName(_training_rows(found.select("row.*", "marks", none.alias("quality"), none.alias("clean")), vocabulary))
        handed = marks.select("sign") if handed is None else handed.unionByName(marks.select("sign"))
    raise AssertionError


def score(docs: DataFrame, model: QualityModel | None, clean: QualityModel | None = None, vocabulary: np.ndarray | None = None) -> DataFrame:
    """All rows and columns, with content_score, metadata_score, quality_score and good.

    Columns of these names are replaced.  Without a model (no labels, or one
    class only) the scores are null and every document is good.  Columns that
    the views need and the table lacks count as null, null texts as empty.  With
    ``clean``, the model of being free of toxicity, good is what neither model
    rejects, and clean_score is added.
    """
    added = [*SCORES, *(["clean_score"] if clean else []), "good"]
    kept = [c for c in docs.columns if c not in added]
    if model is None and clean is None:
        none = {c: F.lit(None).cast("double") for c in SCORES}
        return docs.select(*kept).withColumns({**none, "good": F.lit(True)})
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(*(c.alias(f"__{n}") for c, n in zip(_inputs(docs), INPUT, strict=True)), *kept)
    shape = rows.drop(*(f"__{c}" for c in INPUT)).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    shared = docs.sparkSession.sparkContext.broadcast((model, clean, np.empty(0, np.uint64) if vocabulary is None else vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, clean, vocabulary = shared.value
        for part in slices(batches, 512):
            shown, good = np.full((len(added) - 1, part.num_rows), np.nan), np.ones(part.num_rows, bool)
            for at, to, views in _features(part, vocabulary):
                if model:
                    shown[:3, at:to] = model.scores(views[0], views[1])
                if clean:
                    shown[3, at:to] = clean.scores(views[0], views[2])[2]
            if model:
                good &= shown[2] >= model.cut
            if clean:
                good &= shown[3] >= clean.cut
            arrays = [part.column(k) for k in range(len(INPUT), part.num_columns)]
            arrays += [pa.array(v, pa.float64(), from_pandas=True) for v in shown] + [pa.array(good, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *added])

    return rows.mapInArrow(run, ", ".join([out, *(f"{c} double" for c in added[:-1]), "good boolean"]))


def score_both(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """Good is what neither the quality model nor the toxicity model rejects."""
    return score(docs, *fit(docs, labels, how))


def good_documents(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """The documents that neither classifier rejects, with their own columns."""
    return score_both(docs, labels, how).where("good").select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_both(docs, labels)
    extra = ["clean_score"] if "clean_score" in scored.columns else []
    return scored.select("doc_id", *SCORES, "good", *extra)
