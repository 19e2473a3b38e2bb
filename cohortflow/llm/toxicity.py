"""Operator 5: toxicity by maximum-scoring segments.

Method: every word has a log-odds of the toxic against the clean class, from
document counts smoothed by an informative Dirichlet prior (the counts of both
classes together); a word that is too rare takes the most certain log-odds
among its beginnings. Words score their log-odds where it is significant, less
a drift, so a text without toxic words drifts down. One linear scan finds all
maximal scoring segments (Ruzzo and Tompa). A segment's score turns into an
excess over what chance reaches in a text of that length, by the extreme value
law of such scores (Karlin and Altschul: ``lambda`` from the score
distribution of clean words, ``K`` fitted to the best segments of clean
texts). The excesses of all significant segments make the document's score
through a logistic calibration.

Labels: ``fit`` learns from at most ``max_labels`` labelled ids (a stated
bound; taken by a hash of the id), log-odds from three quarters of them, the
calibration from the rest. An id gives one row: of its labels the greater, of
its texts the least. ``score`` reads nothing but texts.

Plan: labels of the sample are broadcast (bounded), features are counted
map-side and then by key; only features that are significant come to the
driver, at most ``max_features``. Scoring is one map over the texts.

Defined results: a null or empty text has no words, so it gets the score of a
text without segments; repeated rows each get theirs; other columns are
ignored; without labels of both classes all scores are the share of label 1.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, stage, words

by_value(__name__)

MAX_LABELS = 20_000
MAX_FEATURES = 100_000
BEGINNINGS = (4, 5, 6, 7, 8)
PRIOR = 10.0              # weight of the prior per class, in documents
BASE = 1.0                # added to every feature's count, so that a count of zero is no certainty
MIN_Z = 3.0               # at least; among many features the bar is what chance reaches in a tenth of them
MIN_DOCS = 5
DRIFT = 0.5
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"
#: Words whose scores a task keeps; beyond that it begins anew.
CACHE_WORDS = 500_000


def features(word: str) -> list[str]:
    """A word itself, and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def clean_word(raw: str) -> str:
    return raw.strip(EDGES)


class Scores(dict):
    """Score per word as it stands in the text, worked out once per word."""

    def __init__(self, weights: dict[str, tuple[float, float]], drift: float):
        super().__init__()
        self.weights, self.drift = weights, drift

    def __missing__(self, raw: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        got = [self.weights[f] for f in features(clean_word(raw)) if f in self.weights]
        s = max(got, key=lambda w: abs(w[1]))[0] if got else 0.0
        self[raw] = s = s - self.drift
        return s


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, word after the last), in linear time."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # per candidate: sum before it, sum at its end, first, last, and the nearest earlier candidate that begins lower (-1: none);
    # only positive words can begin one. The walk along these links never meets again what it has passed.
    left, right, first, last, lower = [], [], [], [], []
    for i in up.tolist():
        lo, hi, a, j = total[i], total[i + 1], i, len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= hi:
                break
            lo, a, keep = left[j], first[j], j
            j = lower[j]
            del left[keep:], right[keep:], first[keep:], last[keep:], lower[keep:]
        left.append(lo), right.append(hi), first.append(a), last.append(i + 1), lower.append(j)
    return [(h - w, a, b) for w, h, a, b in zip(left, right, first, last)]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)   # feature: log-odds, certainty
    drift: float = DRIFT
    scale: float = 1.0                 # lambda
    k: float = 1.0                     # K
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float = 0.0                 # of label 1, the score where nothing can be learned

    def passages(self, text: str | None, scores: Scores) -> tuple[list[tuple[int, int, float]], int]:
        """All significant segments (first word, word after the last, excess) in order, and the number of words."""
        w = (text or "").lower().split()
        if not w:
            return [], 0
        found = segments(np.fromiter(map(scores.__getitem__, w), np.float64, len(w)))
        chance = math.log(max(self.k * len(w), 1e-9))
        return [(a, b, self.scale * s - chance) for s, a, b in found if self.scale * s > chance], len(w)

    def evidence(self, text: str | None, scores: Scores) -> tuple[float, float, int]:
        """Excess of the best segment, of all significant ones together, and the number of words."""
        found, n = self.passages(text, scores)
        excess = [x for _, _, x in found]
        return max(excess, default=0.0), sum(excess, 0.0), n

    def probability(self, best: np.ndarray, every: np.ndarray) -> np.ndarray:
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(best) + c * np.log1p(every), -30, 30)))


def count_features(sample: DataFrame) -> DataFrame:
    """f, n0, n1: documents of either class that hold a feature (from rows y, t)."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            f = list(counts)
            yield pa.RecordBatch.from_pydict({"f": pa.array([x for x, _ in f], pa.string()), "y": pa.array([y for _, y in f], pa.int32()),
                                              "n": pa.array([counts[x] for x in f], pa.int64())})

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = {clean_word(w) for w in (t.as_py() or "").lower().split()}
                counts.update((f, y) for f in {f for w in words for f in features(w)})
                if len(counts) > 200_000:
                    yield from out()
                    counts.clear()
        yield from out()

    part = sample.select(F.col("y").cast("int").alias("y"), "t").mapInArrow(run, "f string, y int, n bigint")
    return part.groupBy("f").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])


def log_odds(counts: DataFrame, docs0: int, docs1: int, prior: float = PRIOR, min_docs: int = MIN_DOCS,
             min_z: float = MIN_Z, max_features: int = MAX_FEATURES) -> dict[str, tuple[float, float]]:
    """Significant features: log-odds of class 1 and its certainty (z)."""
    p = f"((n0 + n1) / {float(docs0 + docs1)})"
    odds = lambda n, d: f"ln((n{n} + {prior} * {p} + {BASE}) / ({d} + {prior} - n{n} - {prior} * {p} + {BASE}))"
    counts = stage(counts.where(F.expr(f"n0 + n1 >= {min_docs}")), "toxicity-features")
    min_z = max(min_z, math.sqrt(2 * math.log(max(1, counts.count() / 10))))
    c = (counts
         .withColumn("d", F.expr(f"{odds(1, docs1)} - {odds(0, docs0)}"))
         .withColumn("z", F.expr(f"d / sqrt(1 / (n1 + {prior} * {p} + {BASE}) + 1 / (n0 + {prior} * {p} + {BASE}))"))
         .where(F.expr(f"abs(z) >= {min_z}")).orderBy(F.abs("z").desc(), "f").limit(max_features))   # a parameter of the model
    return {r["f"]: (r["d"], r["z"]) for r in c.collect()}


def _lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * value)) = 1."""
    if not (values > 0).any():
        return 1.0
    lo, hi = 1e-6, 1e-6
    f = lambda x: float((share * np.exp(np.clip(x * values, None, 600))).sum()) - 1
    while f(hi) < 0:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple:
    """Newton steps with a little ridge."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _learnable(id_col) -> F.Column:
    return F.crc32(id_col.cast("string")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labels: int = MAX_LABELS, max_features: int = MAX_FEATURES) -> Model:
    """Learn from labelled rows outside the held-out quarter."""
    # one label an id: the greater, where an id has both
    lab = (labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("y"))
           .where(F.col("l_id").isNotNull() & F.col("y").isin(0, 1) & _learnable(F.col("l_id")))
           .groupBy("l_id").agg(F.max("y").alias("y")))
    lab = lab.orderBy(F.xxhash64("l_id", F.lit(5)), "l_id").limit(max_labels)      # the stated bound of the sample
    # one text an id: the least, where an id repeats, combined map-side; so the sample has at most max_labels rows
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
            .join(F.broadcast(lab), F.col("id") == F.col("l_id"))                  # bounded by max_labels
            .groupBy("id").agg(F.max("y").alias("y"), F.min("t").alias("t")))
    # copies of one text would make all its words look telling: near copies mostly share their least run of words
    w = words(F.lower("t"))
    least = F.expr("""CASE WHEN size(w) >= 5 THEN array_min(transform(sequence(0, size(w) - 5),
                      i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))) ELSE xxhash64(t) END""")
    rows = stage(rows.withColumn("w", w).withColumn("least", least).drop("w")
                 .groupBy("least").agg(F.min_by(F.struct("id", "y", "t"), "id").alias("r")).select("r.*"), "toxicity-sample")
    learn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(4)) != 0
    by_class = {r["y"]: (r["n"], r["m"]) for r in rows.groupBy("y").agg(F.sum(learn.cast("int")).alias("n"), F.count("*").alias("m")).collect()}
    (n0, m0), (n1, m1) = by_class.get(0, (0, 0)), by_class.get(1, (0, 0))
    model = Model(share=m1 / (m0 + m1) if m0 + m1 else 0.0)
    if not (n0 and n1 and m0 > n0 and m1 > n1):
        return model
    model.weights = log_odds(count_features(rows.where(learn)), n0, n1, max_features=max_features)
    weights, drift = model.weights, model.drift

    def scan(batches):        # per held-back row: class, words, best segment, and how often each score came
        scores = Scores(weights, drift)
        for b in batches:
            out = [[], [], [], [], []]
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = (t.as_py() or "").lower().split()
                s = np.fromiter(map(scores.__getitem__, w), np.float64, len(w))
                v, c = np.unique(np.round(s, 1), return_counts=True)
                found = sorted((x for x, _, _ in segments(s)), reverse=True)
                for o, x in zip(out, (y, len(w), found, v.tolist(), c.tolist())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(
                pa.array(o, pa.list_(k)) for o, k in zip(out[2:], (pa.float64(), pa.float64(), pa.int64())))],
                ["y", "n", "found", "v", "c"])

    held = (rows.where(~learn).select(F.col("y").cast("int").alias("y"), "t")
            .mapInArrow(scan, "y int, n bigint, found array<double>, v array<double>, c array<bigint>"))
    back = held.collect()      # at most max_labels rows of numbers
    seen: Counter = Counter()
    for r in back:
        if r["y"] == 0:
            seen.update(dict(zip(r["v"], r["c"])))
    values = np.array(sorted(seen)) if seen else np.array([-drift])
    count = np.array([seen[v] for v in values.tolist()], float) if seen else np.ones(1)
    model.scale = min(1.0, _lambda(values, count / count.sum()))
    # K by maximum likelihood, from the best segment of every clean text
    low = sum(r["n"] * math.exp(-model.scale * (r["found"][0] if r["found"] else 0.0)) for r in back if r["y"] == 0)
    model.k = max(sum(r["y"] == 0 for r in back) / max(low, 1e-9), 1e-9)
    x, y = [], []
    for r in back:
        chance = math.log(max(model.k * max(r["n"], 1), 1e-9))
        excess = [max(0.0, model.scale * s - chance) for s in r["found"]]
        x.append((math.log1p(max(excess, default=0.0)), math.log1p(sum(excess))))
        y.append(r["y"])
    model.coefficients = _logistic(np.array(x), np.array(y, float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, best (excess of the best segment), segments (the significant ones) of every row.

    Words of a segment are counted from 0 over the text's words between white space; ``end`` is exclusive.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))       # at most max_features words
    segment = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))

    def run(batches):
        m = Model(**sent.value)
        scores = Scores(m.weights, m.drift)
        for b in batches:
            found = [m.passages(t.as_py(), scores)[0] for t in b.column(1)]
            e = np.array([(max((x for _, _, x in f), default=0.0), sum(x for _, _, x in f)) for f in found], float).reshape(-1, 2)
            p = m.probability(e[:, 0], e[:, 1]) if m.weights else np.full(len(e), m.share)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array(e[:, 0]),
                 pa.array([[{"first": a, "end": z, "excess": x} for a, z, x in f] for f in found], segment)],
                ["doc_id", "score", "best", "segments"])

    return src.mapInArrow(run, f"doc_id {kind}, score double, best double, segments array<struct<first:int,end:int,excess:double>>")


def keep_below(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below ``threshold``: one map, nothing is joined."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text_col)

    def run(batches):
        m = Model(**sent.value)
        scores = Scores(m.weights, m.drift)
        for b in batches:
            e = np.array([m.evidence(t.as_py(), scores)[:2] for t in b.column(at)], float).reshape(-1, 2)
            p = m.probability(e[:, 0], e[:, 1]) if m.weights else np.full(len(e), m.share)
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, segments of every row, by a model learned from the labelled ones."""
    s = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return s.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")
