"""Mapping-quality features, phred scaling and activation functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = 10
#: The breakpoints of the stepwise sigmoids, (x, y), with the values beyond them.
STEPWISE = ((-2.64665246009826660156, 0.00499999988824129104614), (-1.47221946716308593750, 0.0500000007450580596924), (-0.549306154251098632812, 0.25), (0.549306154251098632812, 0.75), (1.47221934795379638672, 0.949999988079071044922), (2.64665293693542480469, 0.995000004768371582031))
STEPWISE_SYMMETRIC = ((-2.64665293693542480469, -0.990000009536743164062), (-1.47221934795379638672, -0.899999976158142089844), (-0.549306154251098632812, -0.5), (0.549306154251098632812, 0.5), (1.47221934795379638672, 0.899999976158142089844), (2.64665293693542480469, 0.990000009536743164062))


def features(sw: Column, next_sw: Column, longest: Column, length: Column, entropy: Column, n_mapped: Column, n_hash: Column, logs: bool = True) -> list[Column]:
    """The five features of a mate; logs=False leaves the counts as they are."""
    count = (lambda c: F.log10(c + 1)) if logs else (lambda c: c.cast("double"))
    return [(sw - next_sw) / (length * MATCH), longest / length, entropy.cast("double"), count(n_mapped), count(n_hash)]


def fragment_feature(expected: Column | int, fragment: Column) -> Column:
    return F.log10(F.abs(F.lit(expected) - F.abs(fragment)) + 1)


def phred(output: Column, strict: bool = False) -> Column:
    """-10 log10 of the error probability 1 - (1 + output) / 2, rounded.  As the format has
    it, an error probability of 1 gives 255 and one of 0 gives 0; strict swaps them."""
    error = 1 - (1 + output) / 2
    value = F.floor(-10 * F.log10(error) + 0.5)
    sure, hopeless = (255, 0) if strict else (0, 255)
    return F.when(error >= 1, hopeless).when(error <= 0, sure).when(value > 255, 255 if strict else 0).otherwise(value).cast("long")


def _stepwise(x: Column, points: tuple, low: float, high: float) -> Column:
    out = F.when(x < points[0][0], low)
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        out = out.when(x < x2, (x - x1) * (y2 - y1) / (x2 - x1) + y1)
    return out.otherwise(high)


def activations(x: Column) -> dict[str, Column]:
    """Every activation function's value at x, by name, in their fixed order."""
    sigmoid, gauss = 1 / (1 + F.exp(-2 * x)), F.exp(-x * x)
    return {
        "linear": x,
        "threshold": F.when(x < 0, 0.0).otherwise(1.0),
        "threshold_symmetric": F.when(x < 0, -1.0).otherwise(1.0),
        "sigmoid": sigmoid,
        "sigmoid_stepwise": _stepwise(x, STEPWISE, 0.0, 1.0),
        "sigmoid_symmetric": 2 * sigmoid - 1,
        "sigmoid_symmetric_stepwise": _stepwise(x, STEPWISE_SYMMETRIC, -1.0, 1.0),
        "gaussian": gauss,
        "gaussian_symmetric": 2 * gauss - 1,
        "gaussian_stepwise": x * 0,
        "elliot": x / 2 / (1 + F.abs(x)) + 0.5,
        "elliot_symmetric": x / (1 + F.abs(x)),
        "linear_piece": F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)),
        "linear_piece_symmetric": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)),
        "sin_symmetric": F.sin(x),
        "cos_symmetric": F.cos(x),
        "sin": F.sin(x) / 2 + 0.5,
        "cos": F.cos(x) / 2 + 0.5,
    }


def derivatives(y: Column, steepness: Column | float, x: Column) -> dict[str, Column]:
    """The derivative by activation name from the output y, the steepness and the sum x;
    thresholds and the stepwise gaussian can't be trained."""
    s = F.lit(steepness) if isinstance(steepness, (int, float)) else steepness
    clip = lambda a, b: F.greatest(F.lit(a), F.least(F.lit(b), y))
    plain, symmetric, far = clip(0.01, 0.99), clip(-0.98, 0.98), 1 + F.abs(x)
    return {
        "linear": s,
        "sigmoid": 2 * s * plain * (1 - plain),
        "sigmoid_symmetric": s * (1 - symmetric * symmetric),
        "gaussian": -2 * x * y * s * s,
        "gaussian_symmetric": -2 * x * (y + 1) * s * s,
        "elliot": s / (2 * far * far),
        "elliot_symmetric": s / (far * far),
        "sin_symmetric": s * F.cos(s * x),
        "cos_symmetric": -s * F.sin(s * x),
        "sin": s * F.cos(s * x) / 2,
        "cos": -s * F.sin(s * x) / 2,
    }
