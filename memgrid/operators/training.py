"""Training of the graph layer and the query projection by contrastive pairs; each epoch is one distributed pass."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import exists
from ..sources.stage import saved

#: Partial sums that one task adds up, and that come to the driver at most: each is as large as the model.
FAN = 16


@dataclass(frozen=True)
class Settings:
    epochs: int = 20
    rate: float = 0.01
    margin: float = 0.5
    #: The gradient's norm at most.
    clip: float = 1.0
    #: Adam's means and what keeps its division safe.
    beta1: float = 0.9
    beta2: float = 0.999
    safe: float = 1e-8
    #: After so many epochs without a better validation loss the rate is multiplied by `factor`, and training ends.
    plateau: int = 3
    factor: float = 0.5
    patience: int = 8
    #: A loss is better if it is less by this.
    better: float = 1e-6


@dataclass
class State:
    """All that training goes on from: the model's and the optimiser's numbers, and what was seen so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    rate: float
    epoch: int = 0
    best: float = math.inf
    best_epoch: int = 0
    bad: int = 0
    waited: int = 0
    train_losses: list[float] = field(default_factory=list)
    valid_losses: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)


def shapes(inner: int, outer: int) -> list[tuple[str, tuple[int, ...]]]:
    """The parts of a model for vectors of `inner` numbers and embeddings of `outer`."""
    return [("query", (outer, inner)), ("root", (outer, inner)), ("side", (outer, inner)), ("bias", (outer,))]


def parts(weights: np.ndarray, inner: int, outer: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(inner, outer):
        size = math.prod(shape)
        out[name], at = weights[at : at + size].reshape(shape), at + size
    return out


def started(inner: int, outer: int, rate: float, seed: int = 1) -> State:
    size = sum(math.prod(s) for _, s in shapes(inner, outer))
    weights = np.random.default_rng(seed).normal(0, 1 / math.sqrt(inner), size)
    return State(weights, np.zeros(size), np.zeros(size), rate)


def loss_and_gradient(weights: np.ndarray, q: np.ndarray, v: np.ndarray, m: np.ndarray, label: np.ndarray, outer: int, margin: float) -> tuple[float, np.ndarray]:
    """Sums over pairs of a query vector q and a node with vector v and neighbours' mean m: of the contrastive loss of the cosine of their
    embeddings (1 - cos for pairs that belong together, else what cos has over the margin), and of its gradient."""
    w = parts(weights, q.shape[1], outer)
    a, h = q @ w["query"].T, v @ w["root"].T + m @ w["side"].T + w["bias"]
    na, nh = np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12), np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    ua, uh = a / na, h / nh
    cos = (ua * uh).sum(1)
    yes = label == 1
    loss = np.where(yes, 1 - cos, np.maximum(cos - margin, 0))
    slope = np.where(yes, -1.0, (cos > margin).astype(float))[:, None]
    da, dh = slope * (uh - cos[:, None] * ua) / na, slope * (ua - cos[:, None] * uh) / nh
    return float(loss.sum()), np.concatenate([(da.T @ q).ravel(), (dh.T @ v).ravel(), (dh.T @ m).ravel(), dh.sum(0)])


def totals(pairs: DataFrame, weights: np.ndarray, outer: int, margin: float) -> tuple[int, float, np.ndarray]:
    """Pairs, loss and gradient, summed in each partition and then by trees of FAN, so the driver gets FAN rows of the model's size at most."""
    kind = "n long, loss double, gradient binary"
    row = lambda n, loss, g: pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([g.tobytes()])], ["n", "loss", "gradient"])
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(len(sent.value))
        for b in batches:
            if b.num_rows:
                q, v, m = (np.array(b.column(c).to_pylist(), float) for c in ("q", "v", "m"))
                some, slope = loss_and_gradient(sent.value, q, v, m, b.column("label").to_numpy(zero_copy_only=False), outer, margin)
                n, loss, gradient = n + b.num_rows, loss + some, gradient + slope
        yield row(n, loss, gradient)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, None
        for b in batches:
            for k, some, slope in zip(*(b.column(c).to_pylist() for c in ("n", "loss", "gradient")), strict=True):
                slope = np.frombuffer(slope)
                n, loss, gradient = n + k, loss + some, slope if gradient is None else gradient + slope
        if gradient is not None:
            yield row(n, loss, gradient)

    sums, left = pairs.select("q", "v", "m", "label").mapInArrow(own, kind), pairs.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        sums = sums.repartition(left).mapInArrow(summed, kind)
    rows = sums.collect()
    return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), sum((np.frombuffer(bytes(r["gradient"])) for r in rows), np.zeros(len(weights)))


def stepped(state: State, gradient: np.ndarray, settings: Settings) -> None:
    """One step of Adam with the clipped gradient."""
    gradient = gradient * min(1.0, settings.clip / max(float(np.linalg.norm(gradient)), 1e-12))
    n = state.epoch + 1
    state.first = settings.beta1 * state.first + (1 - settings.beta1) * gradient
    state.second = settings.beta2 * state.second + (1 - settings.beta2) * gradient * gradient
    state.weights = state.weights - state.rate * (state.first / (1 - settings.beta1**n)) / (np.sqrt(state.second / (1 - settings.beta2**n)) + settings.safe)


def noted(state: State, train: float, valid: float, settings: Settings) -> None:
    """What an epoch changes besides the weights: losses, the best one, and the rate once it is stuck."""
    state.train_losses.append(train)
    state.valid_losses.append(valid)
    state.rates.append(state.rate)
    state.epoch += 1
    if valid < state.best - settings.better:
        state.best, state.best_epoch, state.bad, state.waited = valid, state.epoch, 0, 0
    else:
        state.bad, state.waited = state.bad + 1, state.waited + 1
        if state.waited > settings.plateau:
            state.rate, state.waited = state.rate * settings.factor, 0


def kept(spark: SparkSession, state: State, folder: str) -> None:
    """Writes a state into the folder as one row, by its epoch."""
    row = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in asdict(state).items()}
    row = {k: bytearray(v) if isinstance(v, bytes) else v for k, v in row.items()}
    spark.createDataFrame([tuple(row[c] for c in STATE)], ", ".join(f"{c} {k}" for c, k in STATE.items())).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epochs/epoch={state.epoch}")


STATE = {
    "weights": "binary", "first": "binary", "second": "binary", "rate": "double", "best": "double", "best_epoch": "int", "bad": "int", "waited": "int",
    "train_losses": "array<double>", "valid_losses": "array<double>", "rates": "array<double>",
}


def resumed(spark: SparkSession, folder: str, epoch: int | None = None) -> State | None:
    """The last state in the folder, or that of an epoch; None without one."""
    if not exists(spark, f"{folder}/epochs"):
        return None
    rows = spark.read.schema(", ".join(f"{c} {k}" for c, k in STATE.items()) + ", epoch int").parquet(f"{folder}/epochs")
    rows = rows.where(F.col("epoch") == epoch) if epoch else rows
    found = rows.orderBy(F.desc("epoch")).limit(1).collect()
    if not found:
        return None
    row = found[0].asDict()
    return State(**{k: np.frombuffer(bytes(v)).copy() if isinstance(v, (bytes, bytearray)) else v for k, v in row.items()})


def trained(train: DataFrame, valid: DataFrame, inner: int, outer: int, settings: Settings, folder: str, seed: int = 1) -> State:
    """Trains on pairs (q, v, m, label) and gives the last state; each epoch's is kept in the folder, and a later call goes on from the last.

    Losses are those before the epoch's step for training pairs, and after it for validation pairs. Training ends after `epochs`, or when
    `patience` epochs brought nothing better. The best epoch's state is resumed(spark, folder, state.best_epoch).
    """
    spark = train.sparkSession
    train, valid = saved(train.select("q", "v", "m", "label")), saved(valid.select("q", "v", "m", "label"))
    state = resumed(spark, folder) or started(inner, outer, settings.rate, seed)
    while state.epoch < settings.epochs and state.bad < settings.patience:
        n, loss, gradient = totals(train, state.weights, outer, settings.margin)
        stepped(state, gradient / max(n, 1), settings)
        k, held, _ = totals(valid, state.weights, outer, settings.margin)
        noted(state, loss / max(n, 1), held / max(k, 1), settings)
        kept(spark, state, folder)
    return state


def pairs_of(labels: DataFrame, features: DataFrame, means: DataFrame) -> DataFrame:
    """(id, q, v, m, label) of labels (id, other, label): the vector of id, and vector and neighbours' mean of other; features (id, v), means (id, v)."""
    q = features.select("id", F.col("v").alias("q"))
    v = features.select(F.col("id").alias("other"), "v")
    m = means.select(F.col("id").alias("other"), F.col("v").alias("m"))
    rows = labels.join(q, "id").join(v, "other").join(m, "other", "left")
    return rows.select("id", "q", "v", F.coalesce("m", F.transform("v", lambda _: F.lit(0.0))).alias("m"), "label")
