"""Text quality by positive-unlabelled learning.

Trusted positives are rows labelled 1. All text, whatever its label, stands for
the unlabelled mixture of good and bad, whose class prior is estimated, too; so
the mixture stays whole however many rows are labelled. A logistic scorer over binned
surface features minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

The prior is the best bin's: a first scorer tells positives from unlabelled, and
the least ratio of unlabelled to positive shares above a score, with a margin
for chance, bounds the share of positives among the unlabelled.

The fit uses at most ``POSITIVES`` labelled and ``UNLABELLED`` unlabelled ids,
chosen by hash, with one text each; every text is scored whole.

Defined cases: a null text is an empty one and is scored; without any positive
or unlabelled row all scores are 0.5; an id with several labels takes the lowest;
null ids carry no label; repeated rows are scored each; extra columns are kept
unless named like an added one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import col, held_back, map_arrow, texts_of

POSITIVES = 10_000
UNLABELLED = 20_000
BINS = 12
ROUNDS = 400
THRESHOLD = 0.3
_TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,200}>|https?://|www\.")
_SIGNS = b"!?.,;:%#*$&|<>{}[]()=/\\_-+@~^\"'`"
_GROUPS = [
    bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b"\t\r\x0b\x0c", bytes(range(128, 256)),
    bytes(x for x in range(32) if x not in b"\t\n\r\x0b\x0c") + b"\x7f", *(bytes([x]) for x in _SIGNS),
]
_SUMS = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _SUMS[list(_g), _i] = 1


def features(text: str) -> list[float]:
    """Shares of characters and words, repetition and line shape of a whole text."""
    raw = text.encode("utf-8", "replace")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _SUMS / max(len(raw), 1)
    words = text.split()
    n = len(words)
    low = [w.lower() for w in words]
    counts = Counter(low)
    bare = [w.strip("!?.,;:%#*$&|\"'()") for w in low]
    common = counts.most_common(1)[0][1] if counts else 0
    pairs = len(set(zip(low, low[1:])))
    triples = len(set(zip(low, low[1:], low[2:])))
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    size = np.fromiter(map(len, words), np.float64, n)
    m = max(n, 1)
    return [
        *shares, np.log1p(len(text)), np.log1p(n), size.mean() if n else 0.0, size.std() if n else 0.0, size.max() if n else 0.0,
        len(counts) / m, len(counts) / np.sqrt(m), len(set(bare)) / m, common / m, sum(a == b for a, b in zip(low, low[1:])) / m,
        pairs / max(n - 1, 1), triples / max(n - 2, 1), sum(w.isupper() for w in words) / m, sum(w[0].isupper() for w in words) / m,
        sum(not w[-1].isalnum() for w in words) / m, sum(a != b for a, b in zip(low, bare)) / m, (size <= 3).mean() if n else 0.0,
        np.log1p(len(lines)), np.mean(sizes), max(sizes), len(set(lines)) / len(lines), sum(x.endswith((".", "!", "?")) for x in lines) / len(lines),
        sum(s < 20 for s in sizes) / len(lines), len(_TAG.findall(text)) / m,
    ]


def with_features(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = np.array([features(t) for t in texts_of(batch, text)], np.float64).reshape(batch.num_rows, -1)
        ends = np.arange(0, found.size + 1, max(found.shape[1], 1), dtype=np.int32)[: batch.num_rows + 1]
        return {"features": pa.ListArray.from_arrays(ends, found.ravel())}

    return map_arrow(rows, run, [("features", "array<double>")], keep)


# ---- fit ------------------------------------------------------------------

def _design(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One column per bin that is not a feature's first, 1 from the bin's edge on: weights are steps."""
    return np.hstack([(x[:, [j]] >= e[None, :]) for j, e in enumerate(edges)] + [np.ones((len(x), 1))]).astype(np.float32)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and the direction to descend: the whole risk's, or out of a negative part below zero."""
    gp, gu = _sigmoid(p @ w), _sigmoid(u @ w)
    loss = lambda s: -np.log(np.clip(s, 1e-12, 1))
    negative = loss(1 - gu).mean() - prior * loss(1 - gp).mean()
    d_negative = u.T @ gu / len(u) - prior * (p.T @ gp) / len(p)
    if negative < 0:
        return prior * loss(gp).mean(), -d_negative
    return prior * loss(gp).mean() + negative, prior * (p.T @ (gp - 1)) / len(p) + d_negative


def _descend(grad, size: int, rounds: int = ROUNDS, rate: float = 0.03, decay: float = 1e-3) -> np.ndarray:
    w, m, v = np.zeros(size, np.float32), np.zeros(size), np.zeros(size)
    for i in range(1, rounds + 1):
        g = grad(w) + decay * np.concatenate([w[:-1], [0]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best bin estimate of the share of positives among the unlabelled; both halves of the rows are used in turn."""
    found = []
    for k in (0, 1):
        fit_p, fit_u, p_, u_ = p[k::2], u[k::2], p[1 - k :: 2], u[1 - k :: 2]
        if not len(fit_p) or not len(fit_u) or not len(p_) or not len(u_):
            continue

        def grad(w, a=fit_p, b=fit_u):
            return a.T @ (_sigmoid(a @ w) - 1) / len(a) + b.T @ _sigmoid(b @ w) / len(b)

        w = _descend(grad, p.shape[1], 150)
        sp, su = np.sort(p_ @ w), np.sort(u_ @ w)
        cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
        above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
        above_u = 1 - np.searchsorted(su, cuts) / len(su)
        chance = np.sqrt(np.log(40) / 2 / len(su)) + np.sqrt(np.log(40) / 2 / len(sp))
        best = np.argmin((above_u + chance) / np.maximum(above_p, 1e-9))
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.98)) if found else 0.5


@dataclass
class Scorer:
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return _sigmoid(_design(x, self.edges) @ self.weights).astype(np.float64)


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    if not len(positive) or not len(unlabelled):
        return Scorer([], np.empty(0), 0.5)
    both = np.vstack([positive, unlabelled])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in both.T]
    tails = [np.quantile(c, [0.005, 0.02, 0.98, 0.995]) for c in both.T]
    edges = [np.unique(np.concatenate([e, t])) for e, t in zip(edges, tails)]
    edges = [e[e > c.min()] for e, c in zip(edges, both.T)]
    p, u = _design(positive, edges), _design(unlabelled, edges)
    prior = class_prior(p, u)
    return Scorer(edges, _descend(lambda w: risk_gradient(p, u, w, prior)[1], p.shape[1]), prior)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_name: str = "doc_id", label: str = "quality") -> Scorer:
    """A scorer of the rows ``docs`` (training rows only) with the labels of their ids."""
    known = labels.select(col(id_name).alias("_id"), col(label).alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    ids = docs.select(col(id_name).alias("_id")).filter("_id IS NOT NULL").distinct()
    by_hash = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    good = by_hash(ids.join(known.filter("_y = 1"), "_id", "left_semi"), POSITIVES).withColumn("_p", F.lit(True))
    open_ = by_hash(ids, UNLABELLED).withColumn("_p", F.lit(False))
    chosen = F.broadcast(good.unionByName(open_))  # at most POSITIVES + UNLABELLED ids
    rows = docs.select(col(id_name).alias("_id"), col(text).cast("string").alias("_t")).join(chosen, "_id")
    rows = rows.groupBy("_id", "_p").agg(F.min("_t").alias("_t"))  # one row per id, however often it repeats
    found = with_features(rows, "_t", ["_id", "_p"]).toArrow()
    x = np.array(found.column("features").combine_chunks().values.to_numpy()).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 1))
    order = np.argsort(found.column("_id").to_numpy(), kind="stable")
    x, p = x[order], found.column("_p").to_numpy()[order].astype(bool)
    return fit(x[p], x[~p])


def score(docs: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted; of the old columns those in ``keep`` (all by default)."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = np.array([features(t) for t in texts_of(batch, text)], np.float64).reshape(batch.num_rows, -1)
        s = model.value.scores(found)
        return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_arrow(docs, run, [("score", "double"), ("predicted", "int")], keep)


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for all ``docs``; ids whose hash leaves no remainder teach nothing."""
    part = held_back("doc_id", parts)
    scorer = train(docs.filter(part != 0), labels.filter(part != 0))
    return score(docs.withColumn("held_out", part == 0), scorer, keep=["doc_id", "held_out"])
