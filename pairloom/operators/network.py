"""Feed-forward networks: inference in Arrow batches, training by distributed gradients.

A model is a few thousand weights and lives on the driver; rows stay distributed.  Each
epoch is one pass that returns a gradient of the model's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import STEPWISE, STEPWISE_SYMMETRIC

#: Activations in the order of their codes in network files.
NAMES = ("linear", "threshold", "threshold_symmetric", "sigmoid", "sigmoid_stepwise", "sigmoid_symmetric", "sigmoid_symmetric_stepwise", "gaussian", "gaussian_symmetric", "gaussian_stepwise", "elliot", "elliot_symmetric", "linear_piece", "linear_piece_symmetric", "sin_symmetric", "cos_symmetric", "sin", "cos")
SYMMETRIC = ("linear_piece_symmetric", "threshold_symmetric", "sigmoid_symmetric", "sigmoid_symmetric_stepwise", "elliot_symmetric", "gaussian_symmetric", "sin_symmetric", "cos_symmetric")
_SUM, _WEIGHT = 150.0, 1500.0
#: Examples that go through the layers at once, so that their sums stay in the cache.
_ROWS = 1024


def activate(name: str, x: np.ndarray) -> np.ndarray:
    steps = lambda points, low, high: np.where(x < points[0][0], low, np.where(x >= points[-1][0], high, np.interp(x, *zip(*points))))
    return {
        "linear": lambda: x,
        "threshold": lambda: np.where(x < 0, 0.0, 1.0),
        "threshold_symmetric": lambda: np.where(x < 0, -1.0, 1.0),
        "sigmoid": lambda: 1 / (1 + np.exp(-2 * x)),
        "sigmoid_stepwise": lambda: steps(STEPWISE, 0.0, 1.0),
        "sigmoid_symmetric": lambda: np.tanh(x),
        "sigmoid_symmetric_stepwise": lambda: steps(STEPWISE_SYMMETRIC, -1.0, 1.0),
        "gaussian": lambda: np.exp(-x * x),
        "gaussian_symmetric": lambda: 2 * np.exp(-x * x) - 1,
        "gaussian_stepwise": lambda: x * 0,
        "elliot": lambda: x / 2 / (1 + np.abs(x)) + 0.5,
        "elliot_symmetric": lambda: x / (1 + np.abs(x)),
        "linear_piece": lambda: np.clip(x, 0, 1),
        "linear_piece_symmetric": lambda: np.clip(x, -1, 1),
        "sin_symmetric": lambda: np.sin(x),
        "cos_symmetric": lambda: np.cos(x),
        "sin": lambda: np.sin(x) / 2 + 0.5,
        "cos": lambda: np.cos(x) / 2 + 0.5,
    }[name]()


def slope(name: str, y: np.ndarray, s: float, x: np.ndarray) -> np.ndarray:
    """The factor of the error, from the output y, the steepness s and the sum x, which has the
    steepness in it already: as trained models have it, sines use it twice and bounded
    outputs are held off their ends, so that no neuron stops learning."""
    plain, symmetric, far = np.clip(y, 0.01, 0.99), np.clip(y, -0.98, 0.98), 1 + np.abs(x)
    known = {
        "linear": lambda: np.full_like(y, s),
        "sigmoid": lambda: 2 * s * plain * (1 - plain),
        "sigmoid_symmetric": lambda: s * (1 - symmetric * symmetric),
        "gaussian": lambda: -2 * x * y * s * s,
        "gaussian_symmetric": lambda: -2 * x * (y + 1) * s * s,
        "elliot": lambda: s / (2 * far * far),
        "elliot_symmetric": lambda: s / (far * far),
        "sin_symmetric": lambda: s * np.cos(s * x),
        "cos_symmetric": lambda: -s * np.sin(s * x),
        "sin": lambda: s * np.cos(s * x) / 2,
        "cos": lambda: -s * np.sin(s * x) / 2,
    }
    name = {"linear_piece": "linear", "linear_piece_symmetric": "linear", "sigmoid_stepwise": "sigmoid", "sigmoid_symmetric_stepwise": "sigmoid_symmetric"}.get(name, name)
    if name not in known:
        raise ValueError(f"{name} can't be trained")
    return known[name]()


@dataclass(frozen=True)
class Layer:
    """weights[to, from], the last column for the bias; mask is 0 where there is no connection."""

    weights: np.ndarray
    activation: str = "sigmoid_symmetric"
    steepness: float = 0.5
    mask: np.ndarray | None = None


@dataclass(frozen=True)
class Network:
    layers: tuple[Layer, ...]
    #: Shortcut networks: every layer sees all earlier outputs, not only the last.
    shortcut: bool = False

    @property
    def sizes(self) -> list[int]:
        first = self.layers[0].weights.shape[1] - 1
        return [first, *(x.weights.shape[0] for x in self.layers)]

    @property
    def n_connections(self) -> int:
        return sum(int(x.mask.sum()) if x.mask is not None else x.weights.size for x in self.layers)

    def edges(self) -> list[tuple[int, int, int, float]]:
        """(layer, from, to, weight); from counts the layer's inputs, the bias last."""
        return [(k, j, i, float(x.weights[i, j])) for k, x in enumerate(self.layers) for i in range(x.weights.shape[0]) for j in range(x.weights.shape[1]) if x.mask is None or x.mask[i, j]]

    def dump(self) -> list[str]:
        """The parameters and every connection as lines of text."""
        head = [f"layers={len(self.sizes)} sizes={' '.join(map(str, self.sizes))} shortcut={self.shortcut} connections={self.n_connections}"]
        head += [f"layer {k}: {x.activation}, steepness {x.steepness}" for k, x in enumerate(self.layers, 1)]
        return head + [f"layer {k + 1}: {j} -> {i} weight {w:.6f}" for k, j, i, w in self.edges()]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.weights.ravel() for x in self.layers])

    def with_flat(self, w: np.ndarray) -> "Network":
        out, at = [], 0
        for x in self.layers:
            own = w[at : at + x.weights.size].reshape(x.weights.shape)
            out.append(replace(x, weights=own if x.mask is None else own * x.mask))
            at += x.weights.size
        return replace(self, layers=tuple(out))

    def with_weight(self, layer: int, source: int, to: int, weight: float) -> "Network":
        w = self.layers[layer].weights.copy()
        w[to, source] = weight
        return replace(self, layers=tuple(replace(x, weights=w) if k == layer else x for k, x in enumerate(self.layers)))

    def with_activation(self, activation: str, steepness: float = 0.5, layers: list[int] | None = None) -> "Network":
        if activation not in NAMES:
            raise ValueError(f"no activation {activation}")
        return replace(self, layers=tuple(replace(x, activation=activation, steepness=steepness) if layers is None or k in layers else x for k, x in enumerate(self.layers)))

    def run(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each layer (inputs with bias, sums, outputs), a row an example."""
        out, seen = [], x
        for layer in self.layers:
            a = np.concatenate([seen, np.ones((len(x), 1))], axis=1)
            limit = _SUM / layer.steepness
            sums = np.clip(a @ layer.weights.T * layer.steepness, -limit, limit)
            y = activate(layer.activation, sums)
            out.append((a, sums, y))
            seen = np.concatenate([seen, y], axis=1) if self.shortcut else y
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """The last layer's outputs, a row a unit, from x, a column an example.  Terms are added
        in the order of the weights, the bias last; a sum that isn't a number is the limit."""
        seen = x
        for layer in self.layers:
            w, limit = layer.weights, _SUM / layer.steepness
            total = np.zeros((len(w), x.shape[1]))
            for j, values in enumerate(seen):
                total += w[:, j : j + 1] * values
            sums = (total + w[:, -1:]) * layer.steepness
            sums = np.where(np.isnan(sums), limit, np.clip(sums, -limit, limit))
            y = 2 * activate("sigmoid", sums) - 1 if layer.activation == "sigmoid_symmetric" else activate(layer.activation, sums)
            seen = np.concatenate([seen, y]) if self.shortcut else y
        return seen[len(seen) - len(self.layers[-1].weights) :]

    def _batch(self, features: pa.Array) -> pa.Array:
        width, last = self.sizes[0], len(self.layers[-1].weights)
        fits = pc.fill_null(pc.equal(pc.list_value_length(features), width), False)
        x = pc.fill_null(features.filter(fits).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
        # rows of another width, without values or with values that aren't numbers have one output
        known = ~np.isnan(x).any(axis=1)
        at = np.full(len(features), known.sum())
        at[np.flatnonzero(fits.to_numpy(zero_copy_only=False))[known]] = np.arange(known.sum())
        x = np.concatenate([x[known], np.full((1, width), np.nan)]).T
        with np.errstate(all="ignore"):
            y = np.concatenate([self.outputs(np.ascontiguousarray(x[:, i : i + _ROWS])) for i in range(0, x.shape[1], _ROWS)], axis=1)
        none = pc.is_null(features) if self.shortcut else pa.array(np.zeros(len(features), bool))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1) * last, pa.int32()), pa.array(y.T[at].ravel()), mask=none)

    def forward(self, features: Column) -> Column:
        """The outputs as an array column, in Arrow batches: a row is a few array operations'
        share, however often an expression names the result."""

        @F.arrow_udf("array<double>")
        def of(rows: pa.Array) -> pa.Array:
            return self._batch(rows)

        return of(features.cast("array<double>"))


def create(sizes: list[int], seed: int = 0, activation: str = "sigmoid_symmetric", steepness: float = 0.5, rate: float = 1.0, shortcut: bool = False, low: float = -0.1, high: float = 0.1) -> Network:
    """A network of the given layer sizes with weights in [low, high): fully connected,
    sparse (a share `rate` of the connections, at least one a neuron, the bias always) or shortcut."""
    if len(sizes) < 2:
        raise ValueError("a network has two layers at least")
    r, layers = np.random.default_rng(seed), []
    for k, n in enumerate(sizes[1:], 1):
        width = (sum(sizes[:k]) if shortcut else sizes[k - 1]) + 1
        weights, mask = r.uniform(low, high, (n, width)), None
        if rate < 1 and not shortcut:
            mask = (r.random((n, width)) < rate).astype(float)
            mask[:, -1] = 1
            mask[np.arange(n), r.integers(0, width - 1, n)] = 1
            weights *= mask
        layers.append(Layer(weights, activation, steepness, mask))
    return Network(tuple(layers), shortcut)


def spread_weights(net: Network, low: float, high: float, seed: int = 0) -> Network:
    """Initial weights from the range of the inputs: with f = (0.7 hidden) ^ (1 / inputs) /
    range, weights lie in [0, f) and biases in [-f, f)."""
    r, hidden = np.random.default_rng(seed), sum(net.sizes[1:-1])
    factor = (0.7 * hidden) ** (1 / net.sizes[0]) / (high - low)
    layers = []
    for x in net.layers:
        w = r.uniform(0, factor, x.weights.shape)
        w[:, -1] = r.uniform(-factor, factor, len(w))
        layers.append(replace(x, weights=w if x.mask is None else w * x.mask))
    return replace(net, layers=tuple(layers))


def randomised(net: Network, low: float, high: float, seed: int = 0) -> Network:
    """All weights anew, in [low, high)."""
    return net.with_flat(np.random.default_rng(seed).uniform(low, high, len(net.flat())))


@dataclass(frozen=True)
class Training:
    """Defaults of a training run."""

    algorithm: str = "rprop"
    epochs: int = 10_000
    error: float = 0.01
    rate: float = 0.7
    momentum: float = 0.0
    tanh_error: bool = True
    bit_fail: float = 0.35
    #: Stop by the number of outputs that fail rather than by the mean squared error.
    stop_by_bits: bool = False
    hidden: int = 100
    layers: int = 3
    #: Rows that incremental training, which runs on the driver, takes; more are an error.
    sequential_rows: int = 1_000_000
    report: Callable[[int, float, int], bool] | None = None
    history: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.algorithm not in ("incremental", "batch", "rprop", "quickprop") or self.epochs < 0 or self.layers < 2 or self.hidden < 1:
            raise ValueError("no such training")


def gradient(net: Network, x: np.ndarray, target: np.ndarray, t: Training) -> tuple[np.ndarray, float, int]:
    """(slope of every weight, sum of squared differences, failing outputs)."""
    passed = net.run(x)
    last = net.layers[-1]
    diff = target - passed[-1][2]
    if last.activation in SYMMETRIC:
        diff = diff / 2
    squared, bits = float((diff * diff).sum()), int((np.abs(diff) >= t.bit_fail).sum())
    if t.tanh_error:
        safe = np.clip(diff, -0.9999999, 0.9999999)
        diff = np.where(diff < -0.9999999, -17.0, np.where(diff > 0.9999999, 17.0, np.log((1 + safe) / (1 - safe))))
    ahead = [np.zeros_like(y) for _, _, y in passed]
    ahead[-1] = diff
    slopes: list[np.ndarray] = []
    for k in range(len(net.layers) - 1, -1, -1):
        layer, (a, sums, y) = net.layers[k], passed[k]
        error = ahead[k] * slope(layer.activation, y, layer.steepness, sums)
        own = error.T @ a
        slopes.append((own if layer.mask is None else own * layer.mask).ravel())
        back = error @ layer.weights[:, :-1]
        if net.shortcut:
            at = net.sizes[0]
            for j in range(k):
                ahead[j] = ahead[j] + back[:, at : at + net.sizes[j + 1]]
                at += net.sizes[j + 1]
        elif k:
            ahead[k - 1] = back
    return np.concatenate(slopes[::-1]), squared, bits


class Updater:
    """The weight change of one epoch from the summed slopes."""

    def __init__(self, n: int, t: Training) -> None:
        self.t, self.step, self.before = t, np.full(n, 0.1), np.zeros(n)
        self.moved = np.zeros(n)

    def __call__(self, w: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
        t = self.t
        if t.algorithm == "rprop":
            same = self.before * g
            step = np.maximum(self.step, 1e-4)
            self.step = np.where(same >= 0, np.minimum(step * 1.2, 50.0), np.maximum(step * 0.5, 0.0))
            self.before = np.where(same >= 0, g, 0.0)
            return np.clip(w + np.where(self.before < 0, -self.step, self.step), -_WEIGHT, _WEIGHT)
        if t.algorithm == "quickprop":
            rate, mu, g = t.rate / rows, 1.75, g - 0.0001 * w
            shrink, was = mu / (1 + mu), self.moved
            between = self.before - g
            leap = was * g / np.where(between == 0, 1, between)
            up = np.where(g > 0, rate * g, 0) + np.where(g > shrink * self.before, mu * was, leap)
            down = np.where(g < 0, rate * g, 0) + np.where(g < shrink * self.before, mu * was, leap)
            self.moved = np.where(was > 0.001, up, np.where(was < -0.001, down, rate * g))
            self.before = g
            return np.clip(w + self.moved, -_WEIGHT, _WEIGHT)
        self.moved = t.rate * g / (1 if t.algorithm == "incremental" else rows) + t.momentum * self.moved
        return w + self.moved


def matrix(batch: pa.RecordBatch, i: int) -> np.ndarray:
    column = batch.column(i)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _partial(batches: Iterator[pa.RecordBatch], net: Network, t: Training) -> Iterator[pa.RecordBatch]:
    total, squared, bits, rows = np.zeros(len(net.flat())), 0.0, 0, 0
    for batch in batches:
        if batch.num_rows:
            g, s, b = gradient(net, matrix(batch, 0), matrix(batch, 1), t)
            total, squared, bits, rows = total + g, squared + s, bits + b, rows + batch.num_rows
    if rows:
        values = np.concatenate([total, [squared, bits, rows]])
        yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "v"])


def epoch(net: Network, data: DataFrame, t: Training) -> tuple[np.ndarray, float, int, int]:
    """(slopes, mean squared error, failing outputs, rows) over all rows of data (features,
    target).  Each task sends one gradient; they are summed by position."""
    sums = data.select("features", "target").mapInArrow(lambda b: _partial(b, net, t), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    found = {r.at: r.v for r in sums.collect()}  # one number a weight
    if not found:
        raise ValueError("no rows to train on")
    n = len(net.flat())
    values = np.array([found[i] for i in range(n + 3)])
    rows = int(values[n + 2])
    return values[:n], values[n] / (rows * net.sizes[-1]), int(values[n + 1]), rows


def train(net: Network, data: DataFrame, t: Training = Training()) -> Network:
    """net trained on data (features array, target array) until the error or the number of
    epochs is reached, or report returns False.  The errors are appended to t.history.
    Incremental training is sequential by nature: it takes the rows in order, on the driver,
    and so is for small tables only."""
    if t.algorithm == "incremental":
        rows = data.select("features", "target").limit(t.sequential_rows + 1).toPandas()
        if len(rows) > t.sequential_rows:
            raise ValueError(f"incremental training takes {t.sequential_rows} rows at most; use batch, rprop or quickprop")
        x, y = np.array(rows.features.tolist(), float), np.array(rows.target.tolist(), float)
    else:
        data = data.select("features", "target").persist()
    update = Updater(len(net.flat()), t)
    try:
        for at in range(t.epochs):
            if t.algorithm == "incremental":
                error = bits = 0
                for i in range(len(x)):
                    g, s, b = gradient(net, x[i : i + 1], y[i : i + 1], t)
                    net = net.with_flat(update(net.flat(), g, 1))
                    error, bits = error + s / (len(x) * y.shape[1]), bits + b
            else:
                g, error, bits, n = epoch(net, data, t)
            t.history.append(error)
            done = bits <= t.error if t.stop_by_bits else error <= t.error
            if done or t.report and t.report(at, error, bits) is False:
                break
            if t.algorithm != "incremental":
                net = net.with_flat(update(net.flat(), g, n))
    finally:
        data.unpersist()
    return net


def scored(data: DataFrame, net: Network, bit_fail: float = 0.35) -> DataFrame:
    """One row: mse and bit_fail of a network on data."""
    half = 2.0 if net.layers[-1].activation in SYMMETRIC else 1.0
    pairs = data.select(F.explode(F.arrays_zip(net.forward(F.col("features")).alias("y"), F.col("target").alias("t"))).alias("p"))
    d = (F.col("p.t") - F.col("p.y")) / half
    return pairs.agg(F.round(F.avg(d * d), 6).alias("mse"), F.count_if(F.abs(d) >= bit_fail).alias("bit_fail"))


def rescaled(data: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """An array column moved to [low, high] by its smallest and largest entry over the whole
    matrix; null where all entries are equal."""
    span = data.agg(F.min(F.array_min(column)).alias("a"), F.max(F.array_max(column)).alias("b"))
    moved = F.transform(column, lambda v: F.when(F.col("b") > F.col("a"), F.greatest(F.lit(low), F.least(F.lit(high), (v - F.col("a")) / (F.col("b") - F.col("a")) * (high - low) + low))))
    return data.join(F.broadcast(span)).withColumn(column, moved).drop("a", "b")  # span is one row


def moments(data: DataFrame, column: str) -> DataFrame:
    """feature, mean, deviation (population) for each position of an array column."""
    return data.select(F.posexplode(column).alias("feature", "v")).groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def scaling(data: DataFrame, column: str) -> list[tuple[float, float]]:
    """(mean, deviation) of each position of an array column, to be kept with a network."""
    return [(r["mean"], r["deviation"]) for r in moments(data, column).orderBy("feature").collect()]  # as many rows as features


def scaled(column: Column, kept: list[tuple[float, float]], low: float = -1.0, high: float = 1.0) -> Column:
    """standardised() by kept parameters; null where a feature didn't vary."""
    stats = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in kept])
    return F.zip_with(column, stats, lambda v, s: F.when(s["d"] > 0, ((v - s["m"]) / s["d"] + 1) * (high - low) / 2 + low))


def unscaled(column: Column, kept: list[tuple[float, float]], low: float = -1.0, high: float = 1.0) -> Column:
    """The inverse of scaled()."""
    stats = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in kept])
    return F.zip_with(column, stats, lambda v, s: ((v - low) * 2 / (high - low) - 1) * s["d"] + s["m"])


def standardised(data: DataFrame, column: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """An array column with (v - mean) / deviation of its own feature, moved from [-1, 1] to
    [low, high]; null where a feature doesn't vary."""
    m = moments(data, column).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "mean", "deviation"))), lambda x: F.struct(x["mean"].alias("m"), x["deviation"].alias("d"))).alias("stats"))
    z = F.zip_with(F.col(column), F.col("stats"), lambda v, s: F.when(s["d"] > 0, ((v - s["m"]) / s["d"] + 1) * (high - low) / 2 + low))
    return data.join(F.broadcast(m)).withColumn(column, z).drop("stats")  # one row, as wide as the features
