"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Features are counts over the whole text: transitions between character classes (upper, lower, digit, blank, line end and
kinds of punctuation), word-length histogram, shares of distinct words and of words that repeat in a row, of upper case and of marks, and lengths. A logistic model minimises
pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)): a step that takes the second part below zero is
halved (after Kiryo et al. 2017, who go against its gradient). With the logistic loss the sum is convex, so Newton's method finds the
minimiser in few rounds. Positives are training rows labelled good; unlabelled are all training rows of the web
text. The class prior pi is estimated from a first classifier of positives against unlabelled rows: the lower end of
the unlabelled rows' odds ratio over the positives (Elkan and Noto 2008, with a quantile for robustness).

Fitting and scoring read every row: features are written once, each round sums risk, gradient and second derivatives in the tasks and by
a shuffle, and the driver gets these sums. Scores are calibrated so that 0.7 is the threshold at which the model says good: rows below sit on the negative side.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quire.llm.common import discard, held_out, materialise, order_bits, quantiles, slices, table, worker_tables

THRESHOLD = 0.7
#: Newton's rounds and halvings of a step at most; it ends where a step would lower the risk by less than TOLERANCE.
ROUNDS, HALVINGS, TOLERANCE = 20, 8, 1e-6
#: Weight of half the squared weights: DECAY at least, and as many rows' worth as PRIOR_ROWS, so that small tables don't overfit.
DECAY, PRIOR_ROWS = 1e-4, 10
#: Doubles in a row of partial sums.
CHUNK = 4096
SLICE = 1_000_000
_K = 16
LONGEST = 12
N_FEATURES = _K * _K + LONGEST + 6


@functools.cache
def _classes() -> np.ndarray:
    """Byte -> class: 0 blank, 1 line end, 2 upper, 3 lower, 4 digit, 5 byte of a non-ASCII character, 6.. punctuation by kind."""
    out = np.full(256, 15, np.uint8)
    out[[32, 9]] = 0
    out[[10, 13]] = 1
    out[65:91], out[97:123], out[48:58], out[128:] = 2, 3, 4, 5
    for i, group in enumerate((".", ",", "!?", "|", "#$%&*@^~", "\"'`", "()[]{}<>", "-_=+/\\", ":;")):
        for c in group:
            out[ord(c)] = 6 + i
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    own = worker_tables("quality")
    if len(own.get("up", ())) < n:
        for name, r in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 2**64))):
            p = np.full(max(n, SLICE + 1), np.uint64(r))
            p[0] = 1
            own[name] = np.multiply.accumulate(p)
    return own["up"][:n], own["down"][:n]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of N_FEATURES from the UTF-8 bytes of consecutive texts (text i is data[offsets[i]:offsets[i + 1]])."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    sizes = np.diff(offsets)
    data = data[offsets[0] : offsets[-1]]
    if not data.size:
        return out
    offsets = offsets - offsets[0]
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    c = _classes()[data]
    pair = c[:-1] * np.uint8(_K) + c[1:]
    same = doc[:-1] == doc[1:]
    trans = np.bincount(doc[:-1][same].astype(np.int64) * (_K * _K) + pair[same], minlength=n * _K * _K).reshape(n, -1)
    out[:, : _K * _K] = trans / np.maximum(trans.sum(1, keepdims=True), 1)
    # words: runs of classes above 1
    word = c > 1
    edge = word.copy()
    edge[1:] &= ~word[:-1] | ~same
    start = np.flatnonzero(edge)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | ~same
    length = np.minimum(np.flatnonzero(stop) - start, LONGEST - 1)
    words = np.bincount(doc[start].astype(np.int64) * LONGEST + length, minlength=n * LONGEST).reshape(n, -1)
    total = np.maximum(words.sum(1), 1)
    out[:, _K * _K : _K * _K + LONGEST] = words / total[:, None]
    # repeated words: a word's hash is the difference of a running polynomial sum's ends, shifted to the word's start
    with np.errstate(over="ignore"):
        up, down = _powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        h = (run[np.flatnonzero(stop) + 1] - run[start]) * down[start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = h >> np.uint64(32) | doc[start].astype(np.uint64) << np.uint64(32)
    distinct = np.bincount((np.unique(key) >> np.uint64(32)).astype(np.int64), minlength=n)
    base = _K * _K + LONGEST
    out[:, base] = distinct / total
    out[:, base + 1] = np.log1p(words.sum(1)) / 10
    out[:, base + 2] = np.log1p(sizes) / 10
    upper, lower = np.bincount(doc[c == 2], minlength=n), np.bincount(doc[c == 3], minlength=n)
    out[:, base + 3] = upper / np.maximum(upper + lower, 1)
    out[:, base + 4] = np.bincount(doc[c >= 8], minlength=n) / np.maximum(sizes, 1)
    twice = (key[1:] == key[:-1]) if len(key) > 1 else np.zeros(0, bool)
    out[:, base + 5] = np.bincount(doc[start[1:]][twice], minlength=n) / total
    return out


def batch_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, features) over slices of a string column; nulls are empty."""
    worker_tables("quality")
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    lengths = list(map(len, texts))
    for a, b in slices(lengths, SLICE):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        yield a, b, features(data, np.concatenate([[0], np.cumsum(lengths[a:b])]).astype(np.int64))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float
    prior: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0..1, and THRESHOLD where the raw score is at the cut."""
        z = self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _standard(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features of a batch of _features, and a column of ones."""
    x = np.ones((batch.num_rows, N_FEATURES + 1), np.float32)
    x[:, :-1] = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    x[:, :-1] -= mean.astype(np.float32)
    x[:, :-1] /= scale.astype(np.float32)
    return np.clip(x, -6, 6, out=x)


def _features(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(good, x): whether a row's doc_id is in good(doc_id), and its features; of all rows with a text."""
    schema = StructType([docs.schema["doc_id"], StructField("x", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in batch_features(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    own = docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, schema)  # texts stay where they are; features travel
    return own.join(good.select("doc_id", F.lit(True).alias("good")), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "x")


def _total(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of partial(batch), vectors of one length, over all batches of rows, in an order that reruns share."""
    schema = "chunk int, task int, part binary"

    def emit(totals: dict[int, np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "task", "part"])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("quality")
        total = sum(partial(batch) for batch in batches if batch.num_rows)
        if not np.isscalar(total):
            yield from emit({i // CHUNK: total[i : i + CHUNK] for i in range(0, len(total), CHUNK)}, TaskContext.get().partitionId())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, 0) + np.frombuffer(part)
        yield from emit(totals, 0)

    parts = rows.mapInArrow(here, schema).repartition(8, "chunk").sortWithinPartitions("chunk", "task")
    got = sorted((r["chunk"], bytes(r["part"])) for r in parts.mapInArrow(summed, schema).collect())  # one vector
    return np.frombuffer(b"".join(part for _, part in got))


@dataclass
class Sums:
    """Of all rows: how many, of these good, means and deviations of features."""

    n: int
    n_good: int
    mean: np.ndarray
    scale: np.ndarray


def moments(rows: DataFrame) -> Sums | None:
    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
        good = batch.column("good").to_numpy(zero_copy_only=False)
        return np.concatenate([[len(x), good.sum()], x.sum(0), (x * x).sum(0)])

    got = _total(rows, partial)
    if not len(got) or not got[1]:
        return None
    n, mean = got[0], got[2 : 2 + N_FEATURES] / got[0]
    scale = np.sqrt(np.maximum(got[2 + N_FEATURES :] / n - mean * mean, 0))
    return Sums(int(n), int(got[1]), mean, np.where(scale > 1e-6, scale, 1.0))


def minimise(rows: DataFrame, of: Sums, prior: float | None) -> np.ndarray:
    """Weights, the bias last, that minimise over all rows the non-negative PU risk; without a prior, the risk of a classifier of good rows
    against all, the two sides weighing alike. Half the squared weights times a decay are added."""
    d = N_FEATURES + 1
    upper = np.triu_indices(d)
    # log(1 + e^-z) is log(1 + e^z) - z: every loss is a weight of log(1 + e^z), and good rows add a multiple of z
    every, extra, linear = 1 / of.n, 0.0 if prior else 1 / of.n_good, -(prior or 1.0) / of.n_good
    decay = np.append(np.full(N_FEATURES, max(DECAY, PRIOR_ROWS / of.n)), 0.0)
    mean, scale = of.mean, of.scale

    def losses(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, ...]:
        x, good = _standard(batch, mean, scale), batch.column("good").to_numpy(zero_copy_only=False).astype(np.float64)
        z = (x @ w.astype(np.float32)).astype(np.float64)
        return x, good, z, np.logaddexp(0, z)

    def bends(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and second derivatives of the risk."""

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x, good, z, _ = losses(batch, w)
            s, weight = _sigmoid(z), every + extra * good
            slope, bend = (weight * s + linear * good).astype(np.float32), (weight * s * (1 - s)).astype(np.float32)
            return np.concatenate([x.T @ slope, (x.T @ (x * bend[:, None]))[upper]]).astype(np.float64)

        got, h = _total(rows, partial), np.zeros((d, d))
        h[upper] = got[d:]
        return got[:d] + decay * w, h + np.triu(h, 1).T + np.diag(decay + 1e-9)

    def risks(ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The risk at each column of ws, and its part that may not be negative."""

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            _, good, z, plus = losses(batch, ws)
            return np.concatenate([(every + extra * good) @ plus + linear * (good @ z), plus.sum(0), good @ plus])

        risk, plus, of_good = _total(rows, partial).reshape(3, -1)
        return risk + decay @ (ws * ws) / 2, plus / of.n - (prior or 0.0) * of_good / of.n_good

    w = np.zeros(d)
    for _ in range(ROUNDS):
        gradient, h = bends(w)
        step = np.linalg.solve(h, gradient)
        if gradient @ step / 2 < TOLERANCE:
            break
        ts = np.append(0.5 ** np.arange(HALVINGS), 0.0)
        risk, part = risks(w[:, None] - step[:, None] * ts)
        best = int(np.argmin(np.where(part >= 0, risk, np.inf)))
        if not risk[best] < risk[-1] - TOLERANCE:  # else at the border of the risk's part below zero
            break
        w = w - step * ts[best]
    return w


def class_prior(rows: DataFrame, of: Sums) -> float:
    """Share of positives in all rows: their density over the positives' is at least pi everywhere positives live, and equals it where negatives are absent."""
    w, mean, scale = minimise(rows, of, None), of.mean, of.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("quality")
        for batch in batches:
            z = (_standard(batch, mean, scale) @ w.astype(np.float32)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("good").cast(pa.int64()), pa.array(order_bits(z))], ["good", "z"])

    raw = materialise(rows.mapInArrow(run, "good long, z long"), "raw")
    cuts = quantiles(raw.where("good = 1"), "good", "z", np.linspace(0.05, 0.6, 23).tolist())[1]  # upper tails of the positives: there the unlabelled hold positives only
    over = [F.col("z") >= int(c) for c in order_bits(np.array(cuts))]
    got = raw.agg(*(F.sum(F.when(c, k).otherwise(0)) for c in over for k in (F.lit(1), F.col("good")))).first()
    discard(raw)
    best = min([1.0, *(got[i] / of.n / max(got[i + 1] / of.n_good, 1e-9) for i in range(0, len(got), 2))])
    return float(np.clip(best, 0.05, 0.99))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): both already without held-out rows. Every row with a text counts."""
    rows = materialise(_features(docs, labels.where("quality = 1").select("doc_id").distinct()), "features")
    of = moments(rows)
    if of is None:
        n = N_FEATURES
        return Model(np.zeros(n), np.ones(n), np.zeros(n), 1.0, 0.5, 0.0)
    prior = class_prior(rows, of)
    w = minimise(rows, of, prior)
    discard(rows)
    return Model(of.mean, of.scale, w[:-1], w[-1], prior, 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus quality_score; null texts count as empty. A clashing quality_score is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("quality_score")
    schema = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for a, b, x in batch_features(batch.column("text")):
                s[a:b] = model.score(x)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(s)], schema=arrow)

    return docs.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~fold), labels.where(~fold))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", fold.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
