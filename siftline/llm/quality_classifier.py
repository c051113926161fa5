"""Operator 10, quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe the line and its two neighbours; two states and a
transition table make the chain. Labels are known by document only, so in training every line takes
its document's label, once, and then, in bad documents, lines that the first model finds good are
set free (their state is summed over, not held). The marginals of the forward-backward pass, weighted
by line length, average to a document's share of good text, which a logistic curve fitted on the
training documents turns into the score.

The training sample is bounded: ``MAX_TRAIN_DOCS`` labelled documents, chosen by a hash of the id. The
chain learns from ``MAX_TRAIN_RUNS`` runs of ``RUN_LINES`` lines of them, chosen by a hash over all places
of the whole texts; only their features reach the driver. The curve is fitted on good shares of the whole
texts, which tasks work out. All documents are scored, over all their lines.

Defined results: a null or blank text has no lines and takes the score of a document of which half is
good; without labels, or with labels of one kind only, every score is the labels' mean (0.5 without
any). Several labels of a document count by their mean, several texts of one by that of the least hash; labels without quality don't count. Rows are
scored one by one, so repeated rows give repeated results, and a null doc_id is passed on (it counts
as held out if the crc32 of the empty text says so).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_batches, per_text, remainder_column, stored
from .quality_rules import LOWER, UPPER, count

MAX_TRAIN_DOCS = 3000
RUN_LINES = 64
MAX_TRAIN_RUNS = 5000
HELD_OUT_MODULUS, HELD_OUT = 3, 1
STEPS = 80
OWN_FEATURES = 10
WIDTH = 3 * OWN_FEATURES + 1
SYMBOLS = b"#*$%&<>@~^_=+\\/{}"
DIGITS = b"0123456789"


#: So many lines' features at a time are held as Python numbers.
BLOCK_LINES = 2048


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line that has a word, its neighbours' included; the lines' lengths in bytes)."""
    blocks, own, sizes = [], [], []
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        upper, lower = count(line, UPPER), count(line, LOWER)
        own.append(
            (
                math.log1p(n) / 5,
                min(1.0, 4 * count(line, SYMBOLS) / size),
                upper / (upper + lower + 1),
                min(1.0, 4 * line.count(b"|") / n),
                min(1.0, line.count(b"!") / n),
                1 - len(set(words)) / n,
                sum(map(eq, words, words[1:])) / n,
                float(words[-1].endswith((b".", b"!", b"?"))),
                min(1.0, size / n / 20),
                count(line, DIGITS) / size,
            )
        )
        sizes.append(size)
        if len(own) == BLOCK_LINES:
            blocks.append(np.asarray(own, np.float32))
            own.clear()
    if own:
        blocks.append(np.asarray(own, np.float32))
    if not blocks:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    x = np.concatenate(blocks)
    out = np.zeros((len(x), WIDTH), np.float32)
    out[:, :OWN_FEATURES] = x
    out[1:, OWN_FEATURES : 2 * OWN_FEATURES] = x[:-1]
    out[:-1, 2 * OWN_FEATURES : 3 * OWN_FEATURES] = x[1:]
    out[:, -1] = 1
    return out, np.asarray(sizes, np.float64)


@dataclass
class LineModel:
    """weights: of state 1 against state 0; change[a][b]: score of state b after state a; curve: logistic curve of the
    good share; constant: the score of every document where there was nothing to learn."""

    weights: np.ndarray
    change: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def good_share(self, x: np.ndarray, sizes: np.ndarray) -> float:
        """Length-weighted mean of the lines' marginals of state 1."""
        if not len(x):
            return 0.5
        return float(marginals((x @ self.weights).tolist(), np.exp(self.change).tolist()) @ sizes / sizes.sum())

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.good_share(*line_features(text)) + b))))


def marginals(unary: list[float], change: list[list[float]]) -> np.ndarray:
    """P(state 1) of each line; messages are scaled to sum to one."""
    (c00, c01), (c10, c11) = change
    up = [1 / (1 + math.exp(-max(-30.0, min(30.0, u)))) for u in unary]
    n = len(up)
    ahead = [0.0] * n
    p = 0.5
    for i, u in enumerate(up):
        b1 = (p * c11 + (1 - p) * c01) * u if i else u
        b0 = (p * c10 + (1 - p) * c00) * (1 - u) if i else 1 - u
        ahead[i] = p = b1 / (b0 + b1)
    out = np.empty(n)
    r1 = r0 = 1.0
    for i in range(n - 1, -1, -1):
        g1, g0 = ahead[i] * r1, (1 - ahead[i]) * r0
        out[i] = g1 / (g1 + g0)
        s1, s0 = up[i] * r1, (1 - up[i]) * r0
        r1, r0 = c10 * s0 + c11 * s1, c00 * s0 + c01 * s1
        total = r1 + r0
        r1, r0 = r1 / total, r0 / total
    return out


def expected(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(state) [steps, chains, 2], summed P(pair of states) [2, 2]) of chains sorted by length, longest first.

    scores: [steps, chains, 2]; -inf forbids a state.
    """
    steps, chains, _ = scores.shape
    psi, w = np.exp(scores - np.maximum(scores.max(2, keepdims=True), -50)), np.exp(change)
    alive = [int((lengths > t).sum()) for t in range(steps)]
    a = np.zeros_like(psi)
    a[0] = psi[0] / psi[0].sum(1, keepdims=True)
    for t in range(1, steps):
        n = alive[t]
        x = (a[t - 1, :n] @ w) * psi[t, :n]
        a[t, :n] = x / x.sum(1, keepdims=True)
    back, state, pairs = np.ones((chains, 2)), np.zeros_like(psi), np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        g = a[t, :n] * back[:n]
        state[t, :n] = g / g.sum(1, keepdims=True)
        if t:
            m = psi[t, :n] * back[:n]
            joint = a[t - 1, :n, :, None] * w * m[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back[:n] = m @ w.T
            back[:n] /= back[:n].sum(1, keepdims=True)
    return state, pairs


def train(documents: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> LineModel:
    """Fit the chain. documents: the features of runs of lines; labels: 0 or 1 each, of both kinds."""
    order = sorted((k for k in range(len(labels)) if len(documents[k])), key=lambda k: -len(documents[k]))
    xs, y = [documents[k] for k in order], labels[order].astype(int)
    lengths = np.array([len(x) for x in xs])
    t_of, c_of = np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(xs)), lengths)
    x = np.concatenate(xs).astype(np.float64)
    held = np.full(len(x), True)
    model = LineModel(np.zeros(WIDTH), np.zeros((2, 2)), (1.0, 0.0))
    for free in (False, True):
        if free:  # lines of bad documents that look good are no longer held to be bad
            held = ~((y[c_of] == 0) & (x @ model.weights > 0))
        theta = np.concatenate([model.weights, model.change.ravel()])
        m = v = np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, change = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
            scores = np.zeros((lengths[0], len(xs), 2))
            scores[t_of, c_of, 1] = x @ w
            all_state, all_pairs = expected(scores, lengths, change)
            scores[t_of[held], c_of[held], 1 - y[c_of[held]]] = -60.0
            own_state, own_pairs = expected(scores, lengths, change)
            gap = (own_state - all_state)[t_of, c_of, 1]
            g = np.concatenate([x.T @ gap, (own_pairs - all_pairs).ravel()]) / len(x) - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model = LineModel(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), (1.0, 0.0))
    return model


def curve(share: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the good shares of documents; both kinds of documents weigh the same."""
    mean = float(labels.mean())
    a, b = 4.0, -2.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
        weight = np.where(labels == 1, 0.5 / mean, 0.5 / (1 - mean))
        d = weight * (labels - p)
        h = weight * p * (1 - p) + 1e-6
        hess = np.array([[(h * share * share).mean() + 1e-3, (h * share).mean()], [(h * share).mean(), h.mean() + 1e-3]])
        step = np.linalg.solve(hess, [(d * share).mean() - 1e-3 * a, d.mean()])
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def training_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, text) of the bounded sample of labelled documents, one row an id: of several texts that of the least hash."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .filter(remainder_column(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAIN_DOCS)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select("doc_id", text.alias("text")).join(F.broadcast(known), "doc_id")
    one = chosen.groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("doc_id", "good", F.col("least.text").alias("text"))


def training_runs(chosen: DataFrame) -> list[tuple[np.ndarray, int]]:
    """(features, label) of ``MAX_TRAIN_RUNS`` runs of ``RUN_LINES`` lines at most, chosen by a hash."""
    schema = "doc_id string, good int, place int, x binary"

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc_id, good, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            x, _ = line_features(text)
            out += [(doc_id, good, at, x[at : at + RUN_LINES].tobytes()) for at in range(0, len(x), RUN_LINES)]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "good", "place", "x"])

    runs = in_batches(chosen.select(F.col("doc_id").cast("string").alias("doc_id"), "good", "text"), rows, schema)
    found = runs.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(MAX_TRAIN_RUNS).collect()
    return [(np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH), r["good"]) for r in found]


def fitted(docs: DataFrame, labels: DataFrame) -> LineModel:
    """The model of the labelled documents. The chain learns from runs of lines, the curve from whole texts."""
    chosen = stored(training_documents(docs, labels), "training-documents")
    kinds = {r["good"]: r["n"] for r in chosen.groupBy("good").agg(F.count("*").alias("n")).collect()}
    nothing = LineModel(np.zeros(WIDTH), np.zeros((2, 2)), (0.0, 0.0))
    if len(kinds) < 2:
        return replace(nothing, constant=float(next(iter(kinds), 0.5)))
    runs = training_runs(chosen)
    y = np.array([good for _, good in runs], float)
    model = train([x for x, _ in runs], y) if 0 < y.sum() < len(y) else nothing

    def rows(texts):
        for text in as_bytes(texts):
            yield (model.good_share(*line_features(text)),)

    shares = sorted((r["doc_id"], r["share"], r["good"]) for r in per_text(chosen, [("share", "double")], rows, ("doc_id", "good")).collect())
    return replace(model, curve=curve(np.array([x for _, x, _ in shares]), np.array([x for *_, x in shares], float)))


def quality_classifier(docs: DataFrame, labels: DataFrame, carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of each document, whether it is held out, its score and the predicted label."""
    model = fitted(docs, labels)

    def rows(texts):
        for text in as_bytes(texts):
            score = model.score(text)
            yield (score, int(score >= 0.5))

    held_out = (remainder_column(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT).alias("held_out")
    scored = per_text(docs, [("score", "double"), ("predicted", "integer")], rows, carry)
    return scored.select("*", held_out)
