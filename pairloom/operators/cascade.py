"""Cascade-correlation training: a network that grows by one neuron at a time.

The outputs are trained alone, then candidates of several activations and steepnesses learn
to explain the error that is left; the best one stays, with its inputs fixed, and feeds
all later neurons.  Rows stay distributed: each epoch is one pass that returns sums of the
size of the outputs' weights or of all candidates together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import SYMMETRIC, Layer, Network, Training, Updater, activate, epoch, matrix, slope


@dataclass(frozen=True)
class Cascade:
    """The defaults of a cascade."""

    neurons: int = 30
    error: float = 0.01
    functions: tuple[str, ...] = ("sigmoid", "sigmoid_symmetric", "gaussian", "gaussian_symmetric", "elliot", "elliot_symmetric")
    steepnesses: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    groups: int = 2
    output_epochs: int = 150
    candidate_epochs: int = 150
    #: Training of a part ends after so many epochs without a change by this share.
    stagnation: int = 12
    change: float = 0.01
    #: A candidate's outgoing weights are taken in at this share of what they were trained to.
    multiplier: float = 0.4
    seed: int = 0
    history: list[float] = field(default_factory=list)


class _Stagnation:
    def __init__(self, c: Cascade) -> None:
        self.c, self.best, self.since = c, None, 0

    def __call__(self, value: float) -> bool:
        """Whether the value has stopped changing."""
        if self.best is None or abs(value - self.best) > self.c.change * abs(self.best):
            self.best, self.since = value, 0
        else:
            self.since += 1
        return self.since >= self.c.stagnation


def _train_outputs(net: Network, data: DataFrame, c: Cascade) -> tuple[Network, float]:
    """The last layer trained alone."""
    t, own = Training(tanh_error=False), net.layers[-1].weights.size
    update, still = Updater(own, t), _Stagnation(c)
    for _ in range(c.output_epochs):
        g, error, _, rows = epoch(net, data, t)
        if error <= c.error or still(error):
            break
        w = net.flat()
        w[-own:] = update(w[-own:], g[-own:], rows)
        net = net.with_flat(w)
    return net, epoch(net, data, t)[1]


def residuals(net: Network, x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what a new neuron sees, with the bias; errors of the outputs)."""
    a, _, y = net.run(x)[-1]
    return a, (target - y) / (2 if net.layers[-1].activation in SYMMETRIC else 1)


@dataclass
class Candidates:
    """inputs (candidate, weight), outputs (candidate, output), and each one's kind."""

    inputs: np.ndarray
    outputs: np.ndarray
    kinds: list[tuple[str, float]]

    def sums(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Slopes of all input and output weights and each candidate's squared rest of the errors
        e, where a is what it sees."""
        d_in, d_out, rest = np.zeros_like(self.inputs), np.zeros_like(self.outputs), np.zeros(len(self.kinds))
        for i, (name, s) in enumerate(self.kinds):
            x = np.clip(a @ self.inputs[i] * s, -150 / s, 150 / s)
            v = activate(name, x)
            d = e - v[:, None] * self.outputs[i]
            d_out[i] = v @ d
            d_in[i] = ((d @ self.outputs[i]) * slope(name, v, s, x)) @ a
            rest[i] = (d * d).sum()
        return np.concatenate([d_in.ravel(), d_out.ravel(), rest])


def _pass(batches: Iterator[pa.RecordBatch], net: Network, of: Candidates) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        if batch.num_rows:
            total = total + of.sums(*residuals(net, matrix(batch, 0), matrix(batch, 1)))
    if not isinstance(total, int):
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])


def _best_candidate(net: Network, data: DataFrame, c: Cascade, seed: int) -> tuple[Layer, np.ndarray]:
    """The candidate that leaves the least of the errors, the first of equal ones, as a layer, and
    its outgoing weights."""
    r, width, outputs = np.random.default_rng(seed), net.layers[-1].weights.shape[1], net.sizes[-1]
    kinds = [(f, s) for _ in range(c.groups) for f in c.functions for s in c.steepnesses]
    of = Candidates(r.uniform(-0.5, 0.5, (len(kinds), width)), r.uniform(-0.5, 0.5, (len(kinds), outputs)), kinds)
    n = of.inputs.size
    update, still = Updater(n + of.outputs.size, Training()), _Stagnation(c)
    least, kept = np.full(len(kinds), np.inf), replace(of)
    for at in range(c.candidate_epochs):
        sums = data.select("features", "target").mapInArrow(lambda b: _pass(b, net, of), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        found = np.array([x.v for x in sums.orderBy("at").collect()])  # one number a candidate's weight
        rest = found[n + of.outputs.size :]
        better = rest < least
        least = np.minimum(rest, least)
        kept = Candidates(np.where(better[:, None], of.inputs, kept.inputs), np.where(better[:, None], of.outputs, kept.outputs), kinds)
        if still(float(least.min())):
            break
        w = update(np.concatenate([of.inputs.ravel(), of.outputs.ravel()]), found[: n + of.outputs.size], 1)
        of = Candidates(w[:n].reshape(of.inputs.shape), w[n:].reshape(of.outputs.shape), kinds)
    best = int(np.argmin(least))
    return Layer(kept.inputs[best][None, :], *kinds[best]), kept.outputs[best] * c.multiplier


def installed(net: Network, neuron: Layer, out: np.ndarray) -> Network:
    """net with a neuron before its outputs, which sees all that they saw."""
    last = net.layers[-1]
    w = np.concatenate([last.weights[:, :-1], out[:, None], last.weights[:, -1:]], axis=1)
    return Network((*net.layers[:-1], neuron, replace(last, weights=w)), shortcut=True)


def grow(inputs: int, outputs: int, data: DataFrame, c: Cascade = Cascade(), report: Callable[[int, float], bool] | None = None) -> Network:
    """A shortcut network trained on data (features array, target array) from no hidden neuron
    on, until the error or the number of neurons is reached, or report returns False.  The
    error after each output training is appended to c.history."""
    data = data.select("features", "target").persist()
    r = np.random.default_rng(c.seed)
    net = Network((Layer(r.uniform(-0.1, 0.1, (outputs, inputs + 1))),), shortcut=True)
    try:
        for at in range(c.neurons + 1):
            net, error = _train_outputs(net, data, c)
            c.history.append(error)
            if error <= c.error or at == c.neurons or report and report(at, error) is False:
                break
            net = installed(net, *_best_candidate(net, data, c, c.seed + at + 1))
    finally:
        data.unpersist()
    return net
