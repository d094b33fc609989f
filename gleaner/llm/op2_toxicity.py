"""Operator 2: toxic passages by maximum-scoring segments of token log-odds.

Weights.  For words and for their prefixes, counts of labelled toxic and other documents
give a rate with a Dirichlet prior on the two classes: the prior of a word is the rate of
its longest counted prefix, and so on down to the rate of all documents.  A token's weight
is its log-odds against that of all documents, so an inflected form unseen in training
still has the weight of its stem.

Search.  Token scores are the weights less a drift, so that ordinary text scores negative.
One linear pass finds all maximal segments (those that no extension or cut improves).

Significance.  On ordinary documents the largest segment score S of n tokens follows an
extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)).  lambda solves
E[exp(lambda s)] = 1 over their token scores, K is fitted on their largest scores.  Every
segment whose expected number is at most ``MOST_EXPECTED`` is reported.  A document's
segments are put together by sum statistics: for the r best ones, normalized to
x = lambda S - ln(K n), the sum T has P(T >= t) = exp(-t) t^(r-1) / (r! (r-1)!); the r with
the smallest value, doubled for every further segment, counts.  The document's score is a
logistic curve over its logarithm.

Fitting uses about ``TRAIN_ROWS`` labelled rows, those whose hash is below a bound that
follows from the number of labelled rows that are not held out; equal rows are one.  Four
fifths give the weights, the rest the curve.  Scores see the text only.

Defined results.  Null or empty text, or text without words: no segment, the lowest score.
Rows with a null label or doc_id do not train.  Repeated rows train and are returned each.
Without both labels every score is the labelled share of label 1, or 0.  Extra columns are
ignored.

Ties: of segments with one score all are reported; which of them is called best does not
matter.

Scale.  Scoring is one pass without a shuffle.  Features are weighed where they lie, grouped
by their shortest prefix, and only those whose rate leaves that of their prefix reach the
driver and the tasks; none is cut off by number.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

TRAIN_ROWS, LEAST_DOCS = 20_000, 3
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
PRIOR, DRIFT, CLIP = 2.0, 0.7, (-1.0, 6.0)
EVIDENCE = 4.5
MOST_EXPECTED = 0.05
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and its prefixes, shortest first; a prefix ends with an asterisk."""
    return [word[:k] + "*" for k in PREFIXES if k < len(word)] + [word]


class Model:
    """Weights of words, the extreme-value law and the curve."""

    def __init__(self, weights: dict[str, float], root: float = 0.0):
        self.weights, self.known = weights, {}
        self.rate, self.k, self.a, self.b, self.root = 1.0, 0.1, 0.0, 0.0, root

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            w = 0.0
            for f in features(word):
                w = self.weights.get(f, w)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = w = min(max(w, CLIP[0]), CLIP[1]) - DRIFT
        return w

    def scores(self, words: list[str]) -> list[float]:
        known = self.known
        return [known[w] if w in known else self.weight(w) for w in words]

    def expected(self, score: float, n: int) -> float:
        """Expected number of segments of at least this score in n ordinary tokens."""
        return self.k * n * math.exp(-self.rate * score)

    def feature(self, found: list[float], n: int) -> float:
        """Minus the decimal logarithm of the chance of segments with these scores, by sum statistics; -2 without any."""
        if not found or not n:
            return -2.0
        base = math.log(self.k * n)
        total = logs = 0.0
        best = -1e9
        for r, s in enumerate(sorted(found, reverse=True), 1):
            x = self.rate * s - base
            if r > 1 and x <= 0:
                break
            total += x
            if r > 1:
                logs += math.log(r) + math.log(r - 1) if r > 2 else math.log(r)
            ln = -total + ((r - 1) * math.log(total) if r > 1 else 0.0) - logs + (r - 1) * math.log(2)
            best = max(best, -ln)
        return min(60.0, max(-2.0, best / math.log(10)))

    def score(self, found: list[float], n: int) -> float:
        return 1 / (1 + math.exp(-(self.a * self.feature(found, n) + self.b)))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, in linear time."""
    # each candidate: start, end, sum before it, sum through it
    found: list[list] = []
    total = 0.0
    back: list[int] = []  # for every candidate, the nearest earlier one with a smaller sum before it
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = back[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                back.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], back[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in found]


def held_out():
    """Rows whose labels are never used: crc32 of the id as text, mod 4, is 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic, fold of about ``most`` labelled rows that are not held out, by a hash of the row."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).select("doc_id", "toxic").distinct()
    n = docs.select("doc_id").join(known, "doc_id").count()  # narrow rows
    bound = int(min(1.0, most / max(n, 1)) * (1 << 31))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).filter(F.pmod("h", F.lit(1 << 31)) < bound)
    return rows.join(known, "doc_id").dropDuplicates(["h", "toxic"]).select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold"))


def counted(rows: DataFrame) -> DataFrame:
    """feature, n0, n1: documents of either label that have it."""

    def run(batches):
        for batch in batches:
            both = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[bool(toxic)].update({f for w in set(tokens(text)) for f in features(w)})
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[0][f] for f in names], pa.int64()), pa.array([both[1][f] for f in names], pa.int64())], names=["feature", "n0", "n1"])

    return rows.select("text", "toxic").mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _evidence(hits: int, n: int, rate: float) -> float:
    """Log-likelihood ratio of the observed rate against ``rate``."""
    seen = hits / n
    return sum(k * math.log(x / y) for k, x, y in ((hits, seen, rate), (n - hits, 1 - seen, 1 - rate)) if k)


def weigh(counts: list[tuple[str, int, int]], base: float) -> dict[str, float]:
    """Log-odds against ``base`` of the features of one prefix group, shorter ones first; those that add nothing to their prefix are left out."""
    root = math.log(base / (1 - base))
    rate: dict[str, float] = {}
    out: dict[str, float] = {}

    def parent(f: str) -> float:
        stem = f[:-1] if f.endswith("*") else f
        for k in reversed(PREFIXES):
            if k < len(stem) and (p := stem[:k] + "*") in rate:
                return rate[p]
        return base

    for f, a, b in counts:
        up = parent(f)
        # most features are the company that toxic words keep: a rate leaves its prefix's only on clear evidence
        r = (b + PRIOR * up) / (a + b + PRIOR)
        if _evidence(b, a + b, up) < EVIDENCE:
            r = up
        rate[f] = r
        if r != up:
            out[f] = math.log(r / (1 - r)) - root
    return out


def weighed(counts: DataFrame, n0: int, n1: int) -> DataFrame:
    """feature, weight of the features that differ from their prefix; ``counts`` has feature, n0, n1."""
    base = n1 / (n0 + n1)
    shortest = min(PREFIXES)
    stem = F.when(F.endswith("feature", F.lit("*")), F.length("feature") - 1).otherwise(F.length("feature"))
    rows = counts.filter(F.col("n0") + F.col("n1") >= LEAST_DOCS).select(F.substring("feature", 1, shortest).alias("g"), stem.alias("size"), "feature", "n0", "n1")

    def run(batches):
        at, held = None, []
        out: dict[str, float] = {}
        for batch in batches:
            for g, f, a, b in zip(*[batch.column(k).to_pylist() for k in ("g", "feature", "n0", "n1")], strict=True):
                if g != at:
                    out |= weigh(held, base)
                    at, held = g, []
                held.append((f, a, b))
        out |= weigh(held, base)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.float64())], names=["feature", "weight"])

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(parts, "g").sortWithinPartitions("g", "size", "feature").mapInArrow(run, "feature string, weight double")


def _maxima(rows: DataFrame, model: Model) -> list[tuple[list[float], int, int]]:
    """Scores of the segments, tokens and label of every training row of the curve; their number is bounded by the sample."""

    def run(batches):
        for batch in batches:
            found, n = [], []
            for text in batch.column(0).to_pylist():
                s = model.scores(tokens(text))
                n.append(len(s))
                found.append([x[2] for x in segments(s)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array(n, pa.int64()), batch.column(1).cast(pa.int64())], names=["found", "n", "toxic"])

    return [tuple(r) for r in rows.select("text", "toxic").mapInArrow(run, "found array<double>, n long, toxic long").collect()]


def _law(model: Model, histogram: dict[float, int]) -> None:
    """lambda from the scores of ordinary tokens."""
    total = sum(histogram.values()) or 1
    s = np.array(list(histogram), float)
    p = np.array([histogram[x] for x in histogram], float) / total
    if not len(s) or (s > 0).sum() == 0 or (s * p).sum() >= 0:
        model.rate = 1.0
        return
    lo, hi = 1e-6, 1.0
    with np.errstate(over="ignore"):
        while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    model.rate = hi


def fit(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows."""
    rows = store.table(training_rows(docs, labels, most), "op2-train")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        model = Model({})
        model.b = 40.0 if n.get(1) else -40.0
        return model
    learn = rows.filter("fold <> 0")
    m = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not m.get(0) or not m.get(1):
        learn, m = rows, n
    model = Model({r["feature"]: r["weight"] for r in weighed(counted(learn), m[0], m[1]).collect()})

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(round(x, 2) for x in model.scores(tokens(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    curve = rows.filter("fold = 0")
    if curve.filter("toxic = 1").isEmpty() or curve.filter("toxic = 0").isEmpty():
        curve = rows
    _law(model, {r["s"]: r["n"] for r in curve.filter("toxic = 0").select("text").mapInArrow(run, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()})
    maxima = _maxima(curve, model)
    plain = [(max(s, default=0.0), k) for s, k, y in maxima if not y and k]
    # K by matching the mean of exp(-lambda S) / n, its maximum-likelihood estimate
    model.k = min(1.0, max(1e-4, len(plain) / max(sum(k * math.exp(-model.rate * s) for s, k in plain), 1e-9))) if plain else 0.1
    x = np.array([model.feature(s, k) for s, k, _ in maxima])
    y = np.array([v for *_, v in maxima], float)
    loss = lambda a, b: np.logaddexp(0, -(2 * y - 1) * (a * x + b)).sum() + 0.05 * a * a
    a, b = 0.1, 0.0
    for _ in range(200):  # Newton's steps, halved while they do not help
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum()])
        step = np.linalg.solve(np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]]), g)
        t, now = 1.0, loss(a, b)
        while t > 1e-6 and loss(a - t * step[0], b - t * step[1]) > now:
            t /= 2
        a, b = a - t * step[0], b - t * step[1]
        if np.abs(t * step).max() < 1e-9:
            break
    model.a, model.b = max(float(a), 0.01), float(b)
    return model


SPANS = "array<struct<start:int,end:int,score:double,expected:double>>"


def detect(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, score, n_tokens and the significant segments (token positions) of every row."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample that differ from their prefix
    schema = docs.select(*keep).schema.add("score", "double").add("n_tokens", "long")
    for f in store.schema(f"segments {SPANS}"):
        schema = schema.add(f.name, f.dataType)

    def run(batches):
        m = shared.value
        for batch in batches:
            score, n, found = [], [], []
            for text in batch.column("__text").to_pylist():
                s = m.scores(tokens(text))
                parts = segments(s)
                score.append(m.score([x[2] for x in parts], len(s)))
                n.append(len(s))
                found.append([{"start": a, "end": b, "score": v, "expected": e} for a, b, v in parts if (e := m.expected(v, len(s))) <= MOST_EXPECTED])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(found, kind)], names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    found = detect(docs, fit(docs, store.read(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))
