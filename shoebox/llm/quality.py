"""Quality classifier by positive-unlabelled learning.

A linear model on features of the whole text (shares of bytes, transitions between character
classes, repetition of words and lines) minimises the non-negative unbiased risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the logistic loss and a ridge: trusted positives are all training
rows labelled 1, the unlabelled are all training documents, and the class prior ``pi`` is estimated from all
training labels (the share of positives, with one of each added). Negative labels are not otherwise used.

Features of every document are computed once and written. The risk is minimised by Newton steps: each is
one pass over the written features, whose sums (losses, gradient, second derivatives: a fixed number)
are added in a tree of tasks, so nothing is sampled and only sums reach the driver. With the
logistic loss the unclipped risk is convex, and a step that would take the estimated negative risk below zero, or
the risk up, is shortened: the minimum is looked for where the estimate is non-negative, so the clip at zero
never hides a negative one.

Rows with crc32(id) mod 3 = 1 are held out and never read in training. Scoring reads the weights, a fixed number.

Defined cases: a null or empty text has the features of an empty text and a score like any other; a
null id is not held out; repeated rows count each and get equal scores; an id with several labels is a positive if one of them is 1;
without positives the model is constant at the prior; only the id and text columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shoebox.llm.common import chunks, documents, free, id_remainder, map_texts, table, words_of
from shoebox.plans.ship import ship
from shoebox.plans.tables import Scratch

MODULUS, HELD_OUT = 3, 1
#: Ridge, Newton steps at most, relative gain that ends them, shorter steps that are tried.
RIDGE, STEPS, GAIN, TRIES = 1e-2, 40, 1e-3, 6

#: Character classes of bytes: space, newline, lower, upper, digit, other ASCII in four, not ASCII.
CLASS = np.full(256, 8, np.uint8)
for _b in range(128):
    _c = chr(_b)
    CLASS[_b] = 1 if _c == "\n" else 0 if _c.isspace() else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 if _c in ".,;:'\"-()" else 6 if _c in "!?" else 7
N_CLASS = 9
WIDTH = 96 + 2 * N_CLASS * N_CLASS + 12


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text."""
    data = (text or "").encode()
    x = np.frombuffer(data, np.uint8)
    n = max(1, len(x))
    counts = np.bincount(x, minlength=256)
    printable = np.sqrt(counts[32:128] / n)
    kinds = CLASS[x].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * N_CLASS + kinds[1:], minlength=N_CLASS * N_CLASS) / n if len(x) > 1 else np.zeros(N_CLASS * N_CLASS)
    words = words_of(text)
    m = max(1, len(words))
    w = [len(a) for a in words]
    lines = data.split(b"\n")
    doubles = sum(map(bytes.__eq__, words, words[1:]))
    shape = np.array(
        [
            1.0, math.log1p(len(x)) / 10, len(set(words)) / m, doubles / m, len(set(zip(words, words[1:]))) / m, sum(w) / m / 10,
            (max(w) if w else 0) / 100, len(set(lines)) / len(lines), math.log1p(len(lines)) / 5, m / max(1, len(lines)) / 100,
            len(zlib.compress(data[:], 1)) / n, max(counts[33:]) / n,
        ]
    )
    return np.concatenate([printable, np.sqrt(pairs), (pairs > 0.01).astype(float), np.minimum(shape, 3)])


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features as 32-bit floats."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def apply(batch, texts):
            x = [features(t).astype(np.float32).tobytes() for t in texts]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

        return apply

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id {kind}, x binary")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)


def tree_sum(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum of ``part(matrix)``, ``size`` numbers, over all batches of ``rows`` (x): by task, then over about
    the square root as many tasks, then here."""

    def first(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = rows.select("x").mapInArrow(first, "sums binary")
    few = max(1, math.isqrt(sums.rdd.getNumPartitions()))
    got = sums.repartition(few).mapInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in got), np.zeros(size))


def standard(mean: np.ndarray, scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0, dtype=float), np.square(x, dtype=float).sum(axis=0)])


def unlabelled_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss as negatives at ``w``, its gradient and second derivatives."""
    t = z @ w
    s = sigmoid(t)
    return np.concatenate([[np.logaddexp(0, t).sum()], z.T @ s, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])


def positive_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss as positives and as negatives at ``w``, and the sum of the rows."""
    t = z @ w
    return np.concatenate([[np.logaddexp(0, -t).sum(), np.logaddexp(0, t).sum()], z.sum(axis=0)])


def fit(positive, unlabelled, prior: float) -> dict:
    """Weights that minimise the non-negative risk. ``positive`` and ``unlabelled`` sum a function of
    matrices over all rows of their kind: (function, size) -> sums."""
    n_u, n_p = (float(rows(lambda x: np.array([float(len(x))]), 1)[0]) for rows in (unlabelled, positive))
    if not n_p or not n_u:
        return {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "w": np.zeros(WIDTH), "b": math.log(prior / (1 - prior))}
    m = unlabelled(moments, 1 + 2 * WIDTH)
    mean = m[1 : 1 + WIDTH] / n_u
    scale = np.sqrt(np.maximum(0, m[1 + WIDTH :] / n_u - mean**2)) + 1e-3
    d = WIDTH + 1
    ridge = np.full(d, RIDGE)
    ridge[-1] = 0

    def at(w):
        """Risk, estimated negative risk, gradient, second derivatives."""
        u = unlabelled(lambda x: unlabelled_sums(standard(mean, scale, x), w), 1 + d + d * d) / n_u
        p = positive(lambda x: positive_sums(standard(mean, scale, x), w), 2 + d) / n_p
        negative = u[0] - prior * p[1]
        return prior * p[0] + max(0.0, negative) + ridge @ (w * w) / 2, negative, u[1 : 1 + d] - prior * p[2:] + ridge * w, u[1 + d :].reshape(d, d) + np.diag(ridge + 1e-9)

    w = np.zeros(d)
    w[-1] = math.log(prior / (1 - prior))
    risk, negative, gradient, second = at(w)
    for _ in range(STEPS):
        step = np.linalg.solve(second, gradient)
        for _ in range(TRIES):
            new = at(w - step)
            if new[1] >= 0 and new[0] <= risk:
                break
            step = step * (0.5 if new[1] >= 0 else max(0.05, 0.8 * negative / (negative - new[1])))
        else:
            break
        w, gain = w - step, risk - new[0]
        risk, negative, gradient, second = new
        if gain <= GAIN * risk:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": w[-1]}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return sigmoid(standard(model["mean"], model["scale"], x) @ np.append(model["w"], model["b"]))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from all training rows of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(feature_rows(docs))
    model = train_on(rows, labels, scratch)
    scratch.drop(rows)
    return model


def train_on(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> dict:
    """The model from the training rows of written features (doc_id, x)."""
    held = id_remainder("doc_id", MODULUS) == HELD_OUT
    known = labels.select("doc_id", "quality").where("quality is not null").where(~held)
    n, good = known.agg(F.count("*"), F.coalesce(F.sum(F.col("quality").cast("long")), F.lit(0))).first()
    positive = scratch.write(rows.join(known.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"))
    unlabelled = rows.where(F.coalesce(~held, F.lit(True)))
    model = fit(lambda f, size: tree_sum(positive, f, size), lambda f, size: tree_sum(unlabelled, f, size), (good + 1) / (n + 2))
    scratch.drop(positive)
    return model


def score_rows(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of written features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(shared.value, matrix(batch)), pa.float64())], ["doc_id", "score"])

    ship(rows.sparkSession)
    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document."""
    return score_rows(feature_rows(docs), model)


def keep_good(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part, texts in chunks(batches):
            yield part.filter(pa.array(score(m, np.array([features(t) for t in texts], np.float32)) >= least))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def keep_trained(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score under the model of its training rows is ``least`` or more. Features
    are computed once and written beside the rows."""
    scratch, (name,) = Scratch(docs.sparkSession, "quality"), free(docs, "x")

    def describe(batches):
        for part, texts in chunks(batches):
            x = pa.array([features(t).astype(np.float32).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, x], [*part.schema.names, name])

    rows = scratch.write(docs.mapInArrow(describe, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])))
    shared = docs.sparkSession.sparkContext.broadcast(train_on(rows.select("doc_id", F.col(name).alias("x")), labels, scratch))

    def choose(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.RecordBatch.from_arrays([batch.column(name)], ["x"]))
                yield batch.drop_columns([name]).filter(pa.array(score(shared.value, x) >= least))

    return rows.mapInArrow(choose, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    rows = scratch.write(feature_rows(documents(spark, sf_dir)))
    out = score_rows(rows, train_on(rows, table(spark, sf_dir, "labels"), scratch))
    held = F.coalesce(id_remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
