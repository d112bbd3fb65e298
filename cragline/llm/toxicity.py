"""Toxicity severity by cumulative-link ordinal regression on sparse hashed word features.

P(grade <= k) = sigmoid(t_k - w.x) with ordered thresholds t_1 < t_2 < ... and one weight vector shared by all of
them; the score is the expected grade. Features are the distinct lower-cased words of a text, hashed; each is scaled
by how far its smoothed share differs between the lowest grade and the others, so that rare words weigh little. The model is fitted on a bounded sample of labelled rows (`sample`), chosen by a hash of the id.

Defined results: a text without words has the severity that the thresholds alone give; without labels every
severity is 0; with one grade only, that grade. Null grades are no labels; of several labels of an id the highest
counts; repeated rows are scored each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, flat, pieces, span_hash, spans

BITS = 18
SAMPLE = 20_000


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the distinct hashed words of each text."""
    raw, offs = flat(text)
    raw = LOWER[raw]
    s, e, d = spans(raw, offs, ALNUM)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    col = (span_hash(raw, s, e) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((d << BITS) | col)
    return key >> BITS, key & ((1 << BITS) - 1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _loss(x, row, col, val, grade, k, decay):
    """Mean negative log-likelihood with an L2 penalty, and its gradient; x: weights, first threshold, log gaps."""
    n, w, raw = len(grade), x[:-k], x[-k:]
    t = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
    score = np.bincount(row, weights=w[col] * val, minlength=n)
    edge = np.concatenate([np.zeros((n, 1)), _sigmoid(t[None] - score[:, None]), np.ones((n, 1))], axis=1)
    slope = edge * (1 - edge)
    at = np.arange(n)
    p = np.maximum(edge[at, grade + 1] - edge[at, grade], 1e-12)
    d_score = (slope[at, grade + 1] - slope[at, grade]) / p / n
    d_t = np.zeros(k + 2)
    np.add.at(d_t, grade + 1, -slope[at, grade + 1] / p / n)
    np.add.at(d_t, grade, slope[at, grade] / p / n)
    d_t = np.cumsum(d_t[1:-1][::-1])[::-1] * np.r_[1, np.exp(raw[1:])]
    g = np.bincount(col, weights=d_score[row] * val, minlength=len(w)) + decay * w
    return -np.log(p).mean() + decay / 2 * (w @ w), np.r_[g, d_t]


def scales(row, col, grade, smooth: float = 10.0) -> np.ndarray:
    """|log ratio| of each column's smoothed share in texts above the lowest grade and in the others."""
    high = grade > 0
    share = high.mean()
    a = np.bincount(col[high[row]], minlength=1 << BITS)
    b = np.bincount(col[~high[row]], minlength=1 << BITS)
    return np.abs(np.log((a + smooth * share) / (high.sum() + smooth)) - np.log((b + smooth * (1 - share)) / ((~high).sum() + smooth)))


def fit_arrays(row, col, grade, n_grades: int, rounds: int = 80, decay: float = 1e-4):
    """Weights of present columns and ordered thresholds by L-BFGS on the penalised likelihood."""
    k = n_grades - 1
    scale = scales(row, col, grade)
    val = scale[col]
    share = np.clip(np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    x = np.r_[np.zeros(1 << BITS), t[0], np.log(np.maximum(np.diff(t), 1e-2))]
    f, g = _loss(x, row, col, val, grade, k, decay)
    past: list[tuple] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - r * (y @ q))
        step, slope = 1.0, -(g @ q)
        while True:
            new = x - step * q
            f2, g2 = _loss(new, row, col, val, grade, k, decay)
            if f2 <= f + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        done = abs(f - f2) < 1e-7
        x, f, g = new, f2, g2
        if done:
            break
    return (x[:-k] * scale).astype(np.float32), np.cumsum(np.r_[x[-k], np.exp(x[len(x) - k + 1 :])])


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = SAMPLE) -> dict:
    """A model from labels (doc_id, grade) of docs; at most `sample` labelled rows, by a hash of their ids."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` pairs of numbers

    def run(batches):
        for b in pieces(batches, "text"):
            row, col = features(b.column("text"))
            offs = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.ListArray.from_arrays(pa.array(offs), pa.array(col.astype(np.int32)))], names=["doc_id", "grade", "cols"])

    t = rows.mapInArrow(run, "doc_id long, grade int, cols array<int>").toArrow().sort_by("doc_id")
    if not t.num_rows:
        return {"grades": [0], "w": None, "t": None}
    grades, g = np.unique(t["grade"].to_numpy(), return_inverse=True)
    if len(grades) == 1:
        return {"grades": grades.tolist(), "w": None, "t": None}
    lists = t["cols"].combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    row, col = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy().astype(np.int64)
    w, th = fit_arrays(row, col, g, len(grades))
    return {"grades": grades.tolist(), "w": w, "t": th}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), toxic (P(above the lowest grade) >= 0.5), p_toxic."""
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = ship.value
        grades = np.array(m["grades"], np.float64)
        for b in pieces(batches, "text"):
            n = b.num_rows
            if m["w"] is None:
                p = np.ones((n, 1))
            else:
                row, col = features(b.column("text"))
                s = np.bincount(row, weights=m["w"][col], minlength=n)
                edge = np.concatenate([np.zeros((n, 1)), _sigmoid(m["t"][None] - s[:, None]), np.ones((n, 1))], axis=1)
                p = np.diff(edge, axis=1)
            above = 1 - p[:, 0] if len(grades) > 1 else np.zeros(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p @ grades), pa.array(grades[p.argmax(1)].astype(np.int32)), pa.array(above >= 0.5), pa.array(above)], names=["doc_id", "severity", "grade", "toxic", "p_toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean, p_toxic double")
