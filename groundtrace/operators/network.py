"""Neural classifier trained by synchronous mini-batch Adam, with a sweep over its epochs.

Layers with ReLU and dropout end in two outputs under softmax and cross-entropy. The rows stay where they are: they
are written once, as z-scores, in the order of their mini-batch. A step is one job that sends the weights to the tasks
of one mini-batch and gets the sums of their gradients back. Which mini-batch a row is in, and what dropout hides from it,
follow from hashes of its key; an epoch takes the mini-batches in a new order.

The sums are the same for any partitioning. Outputs of layers and what is propagated back are rounded to ``GRID``
before they are multiplied, so every product is a whole number of small units whose double sums are exact in any
order. The driver holds the weights and their moments, nothing that grows with the rows.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.operators.forest import ForestModel, filled, target_of, vector_statistics
from groundtrace.operators.metrics import best_by_f1, binary_metrics, standardised
from groundtrace.session import stored, tasks_of

GRID = 2.0 ** -14   # of layer outputs and of what is propagated back
LARGEST = 2.0 ** 5  # layer outputs are held below this where they meet a gradient
ROWS = 1 << 12      # rows of one product: 2^(19 + 19 + 12) units fit a double
PADDED = 64         # rows of one forward product, so that a row's sums do not depend on its neighbours


@dataclass(frozen=True)
class NetworkSettings:
    hidden: tuple[int, ...] = (128, 64)
    dropout: float = 0.3
    epochs: int = 50
    batch: int = 32  # rows of a mini-batch, on average
    rate: float = 0.001
    seed: int = 42
    every: int = 5   # epochs between the snapshots of a sweep


Weights = list[tuple[np.ndarray, np.ndarray]]


def initial_weights(layers: Sequence[int], seed: int) -> Weights:
    """Uniform within one over the root of the inputs."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) / a ** 0.5, rng.uniform(-1, 1, b) / a ** 0.5) for a, b in zip(layers, layers[1:])]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def dropout_mask(keys: np.ndarray, units: int, salt: int, share: float) -> np.ndarray:
    """Per row and unit 0 with probability ``share``, else 1 / (1 - share)."""
    if not share:
        return np.ones((len(keys), units))
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64)[:, None] + (np.arange(units, dtype=np.uint64) + np.uint64(salt * units + 1)) * np.uint64(0x9E3779B97F4A7C15)
    kept = (_mixed(mixed) >> np.uint64(11)) * 2.0 ** -53 >= share
    return kept / (1 - share)


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in blocks of ``PADDED`` rows."""
    short = -len(x) % PADDED
    full = np.vstack([x, np.zeros((short, x.shape[1]))]) if short else x
    return np.vstack([full[i:i + PADDED] @ w for i in range(0, len(full), PADDED)])[:len(x)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(x: np.ndarray, weights: Weights) -> np.ndarray:
    """Probabilities of the two classes, without dropout."""
    for w, b in weights[:-1]:
        x = np.maximum(_product(x, w) + b, 0)
    return _softmax(_product(x, weights[-1][0]) + weights[-1][1])


def gradient_sums(x: np.ndarray, y: np.ndarray, weights: Weights, masks: list[np.ndarray], grid: float = GRID) -> tuple[float, Weights]:
    """Sums over the rows of the loss and of its gradients; exact sums of values rounded to the grid."""

    def rounded(a: np.ndarray) -> np.ndarray:
        return np.clip(np.round(a / grid) * grid, -LARGEST, LARGEST) if grid else a

    outputs, a = [rounded(x)], x
    for (w, b), mask in zip(weights[:-1], masks):
        a = np.maximum(_product(a, w) + b, 0) * mask
        outputs.append(rounded(a))
    p = _softmax(_product(a, weights[-1][0]) + weights[-1][1])
    loss = rounded(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-14))).sum()
    back = p.copy()
    back[np.arange(len(y)), y] -= 1
    sums: Weights = []
    for k in range(len(weights) - 1, -1, -1):
        delta = rounded(back)
        sums.append((outputs[k].T @ delta, delta.sum(axis=0)))
        if k:
            back = _product(back, weights[k][0].T) * (outputs[k] > 0) * masks[k - 1]
    return float(loss), sums[::-1]


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([part.ravel() for pair in weights for part in pair])


def _shaped(flat: np.ndarray, layers: Sequence[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


@dataclass(frozen=True)
class Network:
    """A trained network with the z-score statistics of its training rows."""

    names: tuple[str, ...]
    statistics: dict[str, tuple[float, float]]
    weights: Weights

    @property
    def layers(self) -> list[int]:
        return [len(self.names), *[len(b) for _, b in self.weights]]


def z_scores_of(names: Sequence[str], statistics: dict[str, tuple[float, float]]) -> Column:
    return F.array(*[standardised(n, *statistics[n]) for n in names])


def _prepared(table: DataFrame, names, key: str, settings: NetworkSettings) -> tuple[DataFrame, int, dict]:
    """Training rows (x, y, k, part) written in the order of their mini-batch, their batches and the statistics.

    A mini-batch that is enough for several tasks gets a folder of its own, with a file for each of them.
    """
    rows = stored(table.select(F.col(key).cast("string").alias("_key"), *filled(names), target_of().cast("int").alias("_y")))
    statistics = vector_statistics(VectorAssembler(inputCols=list(names), outputCol="features").transform(rows), names)
    count = rows.count()
    batches = max(1, -(-count // settings.batch))
    tasks = tasks_of(rows.sparkSession, -(-count // batches))
    hashed = F.xxhash64("_key", F.lit(settings.seed))
    placed = rows.select(z_scores_of(names, statistics).alias("x"), F.col("_y").alias("y"), hashed.alias("k"),
                         F.pmod(F.xxhash64("_key", F.lit(settings.seed), F.lit("batch")), F.lit(batches)).cast("int").alias("part"))
    if tasks > 1:
        return stored(placed.repartitionByRange(batches * tasks, "part", "k").sortWithinPartitions("part", "k"), ("part",)), batches, statistics
    return stored(placed.repartitionByRange("part", "k").sortWithinPartitions("part", "k")), batches, statistics


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _step(rows: DataFrame, weights: Weights, layers: Sequence[int], settings: NetworkSettings, step: int, wide: bool
          ) -> tuple[int, float, np.ndarray]:
    """(rows, loss, gradient sums) of one mini-batch; a task adds up its rows, with ``wide`` a few add up the tasks'."""

    def add(batches):
        count, loss, total = 0, 0.0, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = part.column("k").to_numpy().view(np.uint64)
                masks = [dropout_mask(keys, n, step * len(layers) + i, settings.dropout) for i, n in enumerate(layers[1:-1])]
                own, sums = gradient_sums(_matrix(part.column("x"), layers[0]), part.column("y").to_numpy(), weights, masks)
                units = np.round(_flat(sums) / GRID ** 2).astype(np.int64)
                count, loss, total = count + part.num_rows, loss + own, units if total is None else total + units
        if count:
            yield pa.record_batch([pa.array([count], pa.int64()), pa.array([loss]), pa.array([total.tolist()], pa.list_(pa.int64()))],
                                  names=["n", "loss", "units"])

    def merge(batches):
        count, loss, total = 0, 0.0, None
        for batch in batches:
            for n, own, units in zip(*[c.to_pylist() for c in batch.columns]):
                units = np.array(units, np.int64)
                count, loss, total = count + n, loss + own, units if total is None else total + units
        if count:
            yield pa.record_batch([pa.array([count], pa.int64()), pa.array([loss]), pa.array([total.tolist()], pa.list_(pa.int64()))],
                                  names=["n", "loss", "units"])

    shape = "n long, loss double, units array<long>"
    found = rows.mapInArrow(add, shape)
    if wide:
        found = found.repartition(16).mapInArrow(merge, shape)
    got = found.collect()
    if not got:
        return 0, 0.0, np.zeros(0)
    total = np.sum([np.array(r["units"], np.int64) for r in got], axis=0)
    return sum(r["n"] for r in got), sum(r["loss"] for r in got), total * GRID ** 2


@dataclass(frozen=True)
class Snapshot:
    epoch: int
    loss: float
    network: Network


def fit_adam(table: DataFrame, names: Sequence[str], settings: NetworkSettings = NetworkSettings(), key: str = "event_key") -> list[Snapshot]:
    """Train on a labelled feature table; the network after every ``settings.every`` epochs and after the last."""
    rows, batches, statistics = _prepared(table, names, key, settings)
    layers = [len(names), *settings.hidden, 2]
    flat = _flat(initial_weights(layers, settings.seed))
    first, second, steps, snapshots = np.zeros_like(flat), np.zeros_like(flat), 0, []
    rng, wide = np.random.default_rng(settings.seed), rows.rdd.getNumPartitions() > 64
    for epoch in range(1, settings.epochs + 1):
        losses = seen = 0
        for part in rng.permutation(batches):
            n, loss, sums = _step(rows.filter(F.col("part") == int(part)), _shaped(flat, layers), layers, settings, steps, wide)
            if not n:
                continue
            steps += 1
            gradient = sums / n
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
            flat = flat - settings.rate * (first / (1 - 0.9 ** steps)) / (np.sqrt(second / (1 - 0.999 ** steps)) + 1e-8)
            losses, seen = losses + loss, seen + n
        if epoch % settings.every == 0 or epoch == settings.epochs:
            network = Network(tuple(names), statistics, _shaped(flat, layers))
            snapshots.append(Snapshot(epoch, losses / max(seen, 1), network))
    return snapshots


def _probability(networks: list[Network]):
    """Arrow function from z-scores to the probability of "malicious" under each network."""
    width, weights = len(networks[0].names), [n.weights for n in networks]

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        rows = _matrix(x, width)
        p = np.stack([forward(rows, w)[:, 1] for w in weights], axis=1) if len(rows) else np.zeros((0, len(weights)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(weights), pa.int32()), pa.array(p.ravel()))

    return score


def sweep(snapshots: list[Snapshot], test: DataFrame, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Metrics of every snapshot on the test rows, as (model_id, epoch, loss, counts, rates): one pass scores them all."""
    network = snapshots[0].network
    ready = test.select(*keep, *filled(network.names)).select(*keep, z_scores_of(network.names, network.statistics).alias("_x"))
    scored = ready.select(*keep, _probability([s.network for s in snapshots])("_x").alias("_p"))
    listed = scored.select(*keep, F.posexplode("_p").alias("_i", "_q")).withColumn(
        "prediction", F.when(F.col("_q") > 0.5, v.MALICIOUS).otherwise(v.BENIGN))
    known = test.sparkSession.createDataFrame([(i, s.epoch, float(s.loss)) for i, s in enumerate(snapshots)], "_i int, epoch int, loss double")
    metrics = binary_metrics(listed, by=("_i",)).join(known, "_i")
    return metrics.withColumn("model_id", F.format_string("epoch %06d", "epoch")).drop("_i")


def restore_best(snapshots: list[Snapshot], swept: DataFrame) -> Network:
    """The network whose F1 is best; of equal ones the earliest."""
    best = best_by_f1(swept).first()["model_id"]
    return next(s.network for s in snapshots if f"epoch {s.epoch:06d}" == best)


# ---- stages that a PipelineModel saves and loads ----------------------------------------------------

class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A map-only stage whose settings are its parameters."""

    def _with(self, values: dict):
        self._set(**{k: x for k, x in values.items() if x is not None})
        return self


class FillMissing(_Stage):
    """The features as doubles, missing values as 0; other columns stay."""

    names = Param(Params._dummy(), "names", "features", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, names=None):
        super().__init__()
        self._with(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.names)
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *filled(names))


class NetworkProbability(_Stage):
    """Adds the probability of "malicious" under a network, from the features and its z-score statistics."""

    names = Param(Params._dummy(), "names", "features", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "training deviations", TypeConverters.toListFloat)
    layers = Param(Params._dummy(), "layers", "units per layer", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weights and offsets, layer by layer", TypeConverters.toListFloat)
    output = Param(Params._dummy(), "output", "column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, names=None, means=None, deviations=None, layers=None, weights=None, output=None):
        super().__init__()
        self._with(self._input_kwargs)

    def network(self) -> Network:
        names = self.getOrDefault(self.names)
        numbers = zip(names, zip(self.getOrDefault(self.means), self.getOrDefault(self.deviations)))
        return Network(tuple(names), dict(numbers), _shaped(np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.layers)))

    def _transform(self, df: DataFrame) -> DataFrame:
        network = self.network()
        p = _probability([network])(z_scores_of(network.names, network.statistics))
        return df.withColumn(self.getOrDefault(self.output), F.get(p, F.lit(0)))


class ForestProbability(_Stage):
    """Adds the probability of "malicious" out of a forest's vector and drops what else the forest added."""

    output = Param(Params._dummy(), "output", "column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, output=None):
        super().__init__()
        self._with(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.element_at(vector_to_array("probability"), 2)
        return df.withColumn(self.getOrDefault(self.output), p).drop("features", "rawPrediction", "probability", "prediction")


class Verdict(_Stage):
    """Mean of the named probabilities as ``p_malicious``, with prediction and confidence."""

    inputs = Param(Params._dummy(), "inputs", "probability columns", TypeConverters.toListString)
    classes = Param(Params._dummy(), "classes", "names of the two classes", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputs=None, classes=None):
        super().__init__()
        self._setDefault(classes=[v.BENIGN, v.MALICIOUS])
        self._with(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        inputs, (no, yes) = self.getOrDefault(self.inputs), self.getOrDefault(self.classes)
        mean = sum((F.col(c) for c in inputs[1:]), F.col(inputs[0])) / len(inputs)
        voted = df.withColumn("p_malicious", mean)
        return voted.withColumn("prediction", F.when(F.col("p_malicious") > 0.5, yes).otherwise(no)).withColumn(
            "confidence", F.greatest("p_malicious", 1 - F.col("p_malicious")))


def _network_stage(network: Network) -> NetworkProbability:
    numbers = [network.statistics[n] for n in network.names]
    return NetworkProbability(names=list(network.names), means=[m for m, _ in numbers], deviations=[d for _, d in numbers],
                              layers=network.layers, weights=_flat(network.weights).tolist(), output="p_network")


def as_pipeline(forest: ForestModel | None = None, network: Network | None = None, classes: tuple[str, str] = (v.BENIGN, v.MALICIOUS)
                ) -> PipelineModel:
    """One saveable model: a forest, a network, or the mean of both (M9), from feature columns to a verdict.

    ``save`` and ``PipelineModel.load`` of the result keep features, statistics, weights and trees (S10).
    """
    names = list(dict.fromkeys([*(forest.names if forest else ()), *(network.names if network else ())]))
    stages, inputs = [FillMissing(names=names)], []
    if forest:
        stages += [*forest.pipeline.stages, ForestProbability(output="p_forest")]
        inputs.append("p_forest")
    if network:
        stages.append(_network_stage(network))
        inputs.append("p_network")
    return PipelineModel([*stages, Verdict(inputs=inputs, classes=list(classes))])

