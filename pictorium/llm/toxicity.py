"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Tokens are words (lower case, without marks at their ends) and, for words that are not in the
   lexicon, their first letters. Log-odds of toxic against clean texts that hold a token use
   informative Dirichlet priors: a letter group's prior is the share of all texts, a word's
   prior is its group's estimate. What lies within Z standard errors of the prior stays there.
2. Scores less a drift are negative for ordinary words, so a linear scan (Ruzzo and Tompa) gives
   every maximal segment of a text: the toxic passages.
3. The best score of a clean text of n words follows an extreme-value law, K n exp(-lambda s).
   Lambda solves E[exp(lambda s)] = 1 over the words of clean texts and K is fitted on them; these
   and the curve below come from the half of the training texts that the log-odds have not seen.
   A segment's expected number by chance makes it significant or not.
4. A text's evidence is what its significant segments add up to above chance; a logistic curve,
   fitted on training texts, turns it into a probability. Each text weighs what its class has
   labels for each one taken, so that the curve is that of all labels whatever the sample's mix.

The model is fitted on at most ``max_docs`` labelled documents (taken by hash) and holds at most
``max_lexicon`` tokens; everything else sees all documents and whole texts.

Defined results: a null or empty text has no segments and gets the curve's value without
evidence; rows that repeat are scored alike; with no labels of one kind every score is the same
prior; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

MAX_DOCS = 20_000
MAX_LEXICON = 200_000
GROUP_LETTERS = 5
PRIOR = 2.0
Z = 2.0
DRIFT = 0.5
SIGNIFICANT = 0.05
EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in linear time.

    Only positive scores can begin or end a segment, so the scan visits those alone and takes
    what lies between from running sums.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum to the end, last stack place with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in stack]


@dataclass
class Model:
    """Token scores and calibration; what is broadcast."""

    words: dict[str, float] = field(default_factory=dict)
    groups: dict[str, float] = field(default_factory=dict)
    other: float = -DRIFT
    lam: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = -2.0

    def scores(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        known, groups, other = self.words, self.groups, self.other
        out = []
        for w in words:
            s = known.get(w)
            if s is None:
                w = EDGES.sub("", w)
                s = known.get(w)
                if s is None:
                    s = groups.get(w[:GROUP_LETTERS], other)
            out.append(s)
        return np.array(out, np.float64)

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Segments with their expected numbers by chance, significant ones only."""
        return self.significant(segments(scores), len(scores))

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        expected = [(s, e, x, self.k * n * math.exp(-self.lam * x)) for s, e, x in found]
        return [f for f in expected if f[3] < SIGNIFICANT]

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        return math.log1p(sum(-math.log(max(f[3], 1e-300)) for f in found))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * evidence + self.b))))


def token_counts(train: DataFrame, letters: int | None = None) -> DataFrame:
    """``token, toxic, clean``: texts of either label that hold the token (its first ``letters`` letters)."""
    bare = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", ""))
    tokens = F.array_distinct(F.transform(bare, lambda w: F.substring(w, 1, letters)) if letters else bare)
    each = train.select("toxic", F.explode(tokens).alias("token")).where("token <> ''")
    return each.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, prior: float) -> float:
    """Log-odds with a Dirichlet prior of PRIOR texts whose log-odds are ``prior``, moved towards it by Z standard errors."""
    share = n_toxic * math.exp(prior) / (n_toxic * math.exp(prior) + n_clean)
    t, c = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    away = math.log(t / n_toxic) - math.log(c / n_clean) - prior
    return prior + math.copysign(max(0.0, abs(away) - Z * math.sqrt(1 / t + 1 / c)), away)


def fit(train: DataFrame, max_lexicon: int = MAX_LEXICON) -> Model:
    """``train``: durable ``text, toxic, half, weight``. Texts stay on the executors; counts, the lexicon and a few numbers a text come back."""
    model = Model()
    kinds = {(r["half"], r["toxic"]): r for r in train.groupBy("half", "toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}  # four rows
    if len(kinds) < 4:
        n, weight = (sum(r[c] for r in kinds.values()) for c in ("n", "w"))
        toxic = n * sum(r["w"] for r in kinds.values() if r["toxic"]) / max(1.0, weight)
        model.a, model.b = 0.0, math.log((toxic + 0.5) / (n - toxic + 4.5))
        return model
    n_toxic, n_clean = kinds[0, 1]["n"], kinds[0, 0]["n"]
    seen = train.where("half = 0")
    top = [F.desc(F.col("toxic") + F.col("clean")), "token"]
    for r in token_counts(seen, GROUP_LETTERS).orderBy(*top).limit(max_lexicon).toLocalIterator():  # max_lexicon rows at most
        model.groups[r["token"]] = log_odds(r["toxic"], r["clean"], n_toxic, n_clean, 0.0) - DRIFT
    for r in token_counts(seen).orderBy(*top).limit(max_lexicon).toLocalIterator():
        group = model.groups.get(r["token"][:GROUP_LETTERS], -DRIFT)
        s = log_odds(r["toxic"], r["clean"], n_toxic, n_clean, group + DRIFT) - DRIFT
        if s != group:  # the others are answered by their group
            model.words[r["token"]] = s
    calibrate(model, train.where("half = 1"))
    return model


SCORED = "toxic int, weight double, n long, best double, found array<double>, values array<double>, counts array<long>"


def calibrate(model: Model, rows: DataFrame) -> None:
    """Lambda and K from clean texts, then the logistic curve from all, by their weights; ``rows``: ``text, toxic, weight``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            out, clean = [], [np.zeros(0)]
            for text, toxic, weight in zip(*(b[c].to_pylist() for c in ("text", "toxic", "weight")), strict=True):
                s = shared.value.scores(text)
                found = [x for *_, x in segments(s)]
                out.append((toxic, weight, len(s), max(found, default=0.0), found, None, None))
                if not toxic:
                    clean.append(s)
            values, counts = np.unique(np.concatenate(clean), return_counts=True)
            out.append((None, None, None, None, None, values.tolist(), counts.tolist()))
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCORED.split(", ")])

    table = durable(rows.select("text", "toxic", "weight").mapInArrow(scored, SCORED), "scored")
    each = table.where("values is not null").select(F.explode(F.arrays_zip("values", "counts")).alias("z")).groupBy("z.values").agg(F.sum("z.counts").alias("n"))
    histogram = np.array([(r["values"], r["n"]) for r in each.collect()] or [(-DRIFT, 1)])  # scores of the lexicon, each once
    best = [(r["best"], r["n"]) for r in table.where("toxic = 0 and n > 0").select("best", "n").collect()]  # two numbers a training text
    model.lam = _lambda(*histogram.T)
    # maximum likelihood of K, given lambda, for P(best <= s) = exp(-K n exp(-lambda s))
    model.k = max(1e-6, len(best) / max(1e-9, sum(n * math.exp(-model.lam * s) for s, n in best)))
    fitted = Model(lam=model.lam, k=model.k)

    def evidence(batches):
        import pyarrow as pa

        for b in batches:
            x = [fitted.evidence(fitted.significant([(0, 0, s) for s in found], n)) for found, n in zip(b["found"].to_pylist(), b["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["toxic"], b["weight"], pa.array(x, pa.float64())], names=["toxic", "weight", "evidence"])

    told = table.where("toxic is not null").select("toxic", "weight", "n", "found").mapInArrow(evidence, "toxic int, weight double, evidence double").collect()  # three numbers a training text
    model.a, model.b = _curve(np.array([r["evidence"] for r in told]), np.array([r["toxic"] for r in told], float), np.array([r["weight"] for r in told]))


def _lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """Where the mean of exp(lambda * value) is 1."""
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        grows = float((counts * np.exp(np.minimum(mid * values, 600))).sum() / counts.sum()) > 1
        lo, hi = (lo, mid) if grows else (mid, hi)
    return lo


def _curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of ``y`` over ``x``, slightly drawn to 0."""
    weights = weights * len(weights) / weights.sum()
    w = np.zeros(2)
    design = np.stack((x, np.ones(len(x))), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (weights * p * (1 - p))[:, None]) + np.diag([1e-2, 1e-3])
        w = w + np.linalg.solve(h, design.T @ (weights * (y - p)) - np.array([1e-2, 1e-3]) * w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_passages, best, passages`` of every row; passages: array of ``start, end`` (words) and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            m = shared.value
            found = [m.passages(m.scores(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([m.probability(m.evidence(f)) for f in found], pa.float64()),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.array([[{"start": s, "end": e, "score": x} for s, e, x, _ in f] for f in found], kind),
                ],
                names=["doc_id", "score", "n_passages", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_passages int, passages array<struct<start:int,end:int,score:double>>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """At most ``max_docs`` labelled rows that are not held out, half of them of either class where there are enough, by hash.

    ``weight``: the labels of the row's class for each one taken.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    most = max_docs // 2
    n = {r["toxic"]: r["n"] for r in y.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    half = [y.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, n.get(t, 0) / max(most, 1)))) for t in (0, 1)]
    chosen = half[0].unionByName(half[1])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half"))  # max_docs rows at most


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, at: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages`` of every row."""
    model = fit(durable(training_rows(docs, labels, max_docs), "training"))
    s = score(docs, model)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "n_passages")
