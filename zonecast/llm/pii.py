"""Personal data by weak supervision, with DataFrame functions only.

Base patterns give spans that always stay.  A looser pattern gives candidates.
Four labelers vote +1, 0 or -1 on every span: a strict shape, a gazetteer of cue
words before it, its direct context, and the variety of its characters.
Expectation-maximisation on the counted vote patterns estimates how reliable
each labeler is, and gives each pattern a probability; a logistic classifier is
trained on span features against these.  Candidates that it accepts are added.

Only counts of vote and feature patterns come to the driver: all features are
small categories, so there are at most ``len(KINDS) * 3**4 * 2 * 3 * 3`` rows,
whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import table

#: The base patterns.  Written possessively and anchored at the
#: start of a run, which matches the same spans in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+(?![A-Za-z0-9_-])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64} ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,24}",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(. -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
KINDS = (*BASE, *LOOSE)
CUES = (
    "e-?mail|mail|tel|phone|telefon|t[eé]l[eé]phone|tel[eé]fono|mobile|call|fax|token|secret|password|passwd|api[_ -]?key|key|"
    "ssn|social security|passport|card|karte|carte|tarjeta|ip|address|adresse|contact"
)
ANTI_CUES = "isbn|issn|doi|invoice|order|version|page|figure|table|sha|md5|commit|zip|part no"
#: Characters before a span in which cue words count.
REACH = 24
LABELERS = ("shape", "cue", "context", "variety")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.split(hit, r"\.")
        small = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(parts, lambda p: (F.length(small(p)) <= 3) & (F.coalesce(small(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(hit)
        # Most numbers are too short: their digits are not looked at.
        return (F.length(hit) >= 13) & F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def find(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """All valid matches from left to right as (start, end, hit) in code points, the end exclusive.

    The pieces between the matches come from ``split``; their lengths and the
    matches' add up to the positions.  Only valid matches are gathered, so a text
    with very many numbers takes no longer for each.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("hit"))
        out = F.when(valid(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.cast("int").alias("at"), out.alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


#: Cheap tests that a text can hold a kind at all.
GATES = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.instr(t, "+") > 0,
}


def _features(text: Column, kind: Column, s: Column) -> Column:
    """A span with its votes and small categorical features."""
    before = F.lower(F.substr(text, F.greatest(s["start"] - REACH + 1, F.lit(1)), F.least(s["start"], F.lit(REACH))))
    hit = s["hit"]
    near = F.substr(before, F.greatest(F.length(before) - 3, F.lit(1)), F.lit(4))
    vote = lambda yes, no: F.when(no, -1).when(yes, 1).otherwise(0)
    n_digits, n = F.length(_digits(hit)), F.length(hit)
    different = F.size(F.array_distinct(F.split(hit, "")))
    strict = kind.isin(*BASE) | (kind == "masked_email") | hit.rlike(r"^(?:[0-9a-f]{32,}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})$")
    return F.struct(
        kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        vote(strict, F.lit(False)).alias("shape"),
        vote(before.rlike(rf"(?<![a-z])(?:{CUES})(?![a-z])"), before.rlike(rf"(?<![a-z])(?:{ANTI_CUES})(?![a-z])")).alias("cue"),
        vote(near.rlike(r"[:=]\s?[\"']?$"), near.rlike(r"[a-z0-9_]$")).alias("context"),
        vote(different >= 6, different <= 3).alias("variety"),
        near.rlike(r"[\"'(<\[]$").cast("int").alias("quoted"),
        F.when(n < 12, 0).when(n < 24, 1).otherwise(2).alias("long"),
        F.when(n_digits == n, 2).when(n_digits * 2 >= n, 1).otherwise(0).alias("numeric"),
    )


FEATURES = ("quoted", "long", "numeric")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, loose): arrays of spans with their features; a null text is empty."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    for kind, pattern in BASE.items():
        spans = find(t, pattern, lambda hit, kind=kind: _valid(kind, hit))
        rows = rows.withColumn(kind, F.when(GATES[kind](t), spans).otherwise(none))
    gate = t.rlike(r"[A-Za-z0-9_-]{24}|[0-9]{3}[) .-]|[\[(]at[\])]")
    loose = find(t, "|".join(f"(?:{p})" for p in LOOSE.values()), lambda hit: F.lit(True))
    rows = rows.withColumn("loose", F.when(gate, loose).otherwise(none))

    def valid_spans(kind: str) -> Column:
        return F.transform(kind, lambda s: _features(t, F.lit(kind), s))

    base = F.concat(*map(valid_spans, BASE))
    masked, ident = F.lit(r"[\[(]at[\])]"), F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")

    def loose_kind(s: Column) -> Column:
        h = s["hit"]
        return (
            F.when(F.regexp_like(h, masked), "masked_email").when(F.regexp_like(h, ident), "national_id")
            .when(F.regexp_like(h, F.lit(r"^[A-Za-z0-9_-]{24,}$")), "secret").otherwise("local_phone")
        )

    loose = F.transform("loose", lambda s: _features(t, loose_kind(s), s))
    found = rows.select("doc_id", base.alias("base"), loose.alias("loose"))
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select("doc_id", "base", free.alias("loose"))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the classifier by feature name; ``votes`` holds P(vote | class) of each labeler."""

    weights: dict[str, float]
    votes: dict[str, dict[tuple[int, int], float]]

    def probability(self, span: Column) -> Column:
        """The score as an expression on a span."""
        z = F.lit(self.weights["bias"])
        for k in KINDS:
            z = z + F.when(span["kind"] == k, self.weights[f"kind={k}"]).otherwise(0.0)
        for f in (*LABELERS, *FEATURES):
            for v in sorted({int(n.split("=")[1]) for n in self.weights if n.startswith(f"{f}=")}):
                z = z + F.when(span[f] == v, self.weights[f"{f}={v}"]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


#: Votes that each labeler is credited with before any are counted, by (class, vote).
PRIOR = {(1, 1): 6.0, (1, 0): 3.0, (1, -1): 1.0, (0, 1): 1.0, (0, 0): 6.0, (0, -1): 3.0}


def estimate(patterns: Sequence[tuple[dict, float]], rounds: int = 40) -> tuple[list[float], dict]:
    """EM for a two-class model in which labelers vote independently.

    ``patterns``: (votes and kind, count).  Returns the probability of each
    pattern and P(vote | class).  Spans of the base kinds passed an exact check
    and count as true throughout; the labelers are judged on the candidates.
    """
    prob = [1.0 if p["kind"] in BASE else min(max(0.5 + 0.15 * sum(p[f] for f in LABELERS), 0.02), 0.98) for p, _ in patterns]
    open_ = [i for i, (p, _) in enumerate(patterns) if p["kind"] not in BASE]
    tables: dict = {}
    for _ in range(rounds):
        tables, prior = {}, {}
        for f in LABELERS:
            mass = dict(PRIOR)
            for i in open_:
                p, n = patterns[i]
                mass[1, p[f]] += n * prob[i]
                mass[0, p[f]] += n * (1 - prob[i])
            sums = [sum(mass[y, v] for v in (-1, 0, 1)) for y in (0, 1)]
            tables[f] = {(y, v): m / sums[y] for (y, v), m in mass.items()}
        for k in LOOSE:
            own = [(patterns[i][1], prob[i]) for i in open_ if patterns[i][0]["kind"] == k]
            prior[k] = (5.0 + sum(n * q for n, q in own)) / (10.0 + sum(n for n, _ in own))
        for i in open_:
            p = patterns[i][0]
            z = math.log(prior[p["kind"]] / (1 - prior[p["kind"]]))
            for f in LABELERS:
                ratio = math.log(tables[f][1, p[f]] / tables[f][0, p[f]])
                # A labeler is never worse than chance, so the two classes cannot change places.
                z += max(ratio, 0.0) if p[f] > 0 else min(ratio, 0.0) if p[f] < 0 else ratio
            prob[i] = 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))
    return prob, tables


def train(patterns: Sequence[tuple[dict, float]], rounds: int = 200, rate: float = 0.5) -> SpanModel:
    """Logistic regression on one-hot features against the EM probabilities, weighted by the root of the count."""
    prob, tables = estimate(patterns)
    names = [["bias", f"kind={p['kind']}", *(f"{f}={p[f]}" for f in (*LABELERS, *FEATURES))] for p, _ in patterns]
    weights = dict.fromkeys(["bias", *(f"kind={k}" for k in KINDS), *(n for row in names for n in row)], 0.0)
    mass = [math.sqrt(n) for _, n in patterns]
    total = sum(mass) or 1.0
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for row, q, m in zip(names, prob, mass, strict=True):
            error = q - 1 / (1 + math.exp(-max(min(sum(weights[n] for n in row), 30.0), -30.0)))
            for n in row:
                slope[n] += m * error
        for n in weights:
            weights[n] += rate * (slope[n] / total - 1e-4 * weights[n])
    return SpanModel(weights, tables)


def fit(found: DataFrame) -> SpanModel:
    """Counts of vote and feature patterns over all spans of a written table, then the model."""
    span = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*")
    counted = span.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return train(sorted(((r.asDict(), float(r.n)) for r in counted), key=lambda x: sorted(map(str, x[0].items()))))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base (spans), added (spans with a probability).

    Positions are code points, ends exclusive.  Base spans are ordered by kind
    and start.  An added span overlaps no base span.  Null and empty texts have
    no spans; rows that repeat an id keep a row each; other columns are not read.
    """
    found = stage(candidates(docs, key, text), "spans")
    model = fit(found)
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    added = F.filter("loose", lambda s: model.probability(s) >= threshold)
    added = F.transform(
        F.array_sort(F.transform(added, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("at"), s.alias("s")))),
        lambda x: x["s"],
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), "base", added.alias("added"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
