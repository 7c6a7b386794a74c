"""Text sources and sinks: tagged records, training sets, network files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.network import NAMES, Layer, Network

#: The fields of a record, in the order of the format.
FIELDS = ("name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "rg", "nm", "md", "za", "zn", "xc")
#: First lines of network files, float and fixed-point.
FLOAT_FILE, FIXED_FILE = "FANN_FLO_2.1", "FANN_FIX_2.0"
_NUMBERS = ("flag", "pos", "mapq", "pnext", "tlen")


def records(spark: SparkSession, path: str) -> DataFrame:
    """A text file of records, its fields by position, with the line as it was; header lines
    are left out, missing fields null."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    parts = F.split("value", r"\s+")
    value = lambda i, n: F.get(parts, F.lit(i)).try_cast("long") if n in _NUMBERS else F.get(parts, F.lit(i))
    return lines.select(*[value(i, n).alias(n) for i, n in enumerate(FIELDS)], F.col("value").alias("line"))


def tagged_lines(df: DataFrame) -> DataFrame:
    """The lines of records with a truth tag from columns chr and true_pos."""
    return df.select(F.concat(F.col("line"), F.lit(" XC:Z:"), F.coalesce("chr", F.lit("")), F.lit(";"), F.coalesce("true_pos", F.lit(0)).cast("string")).alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of one text file.  Lines are numbered within their partitions,
    and one count a partition places these."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value")
    lines = lines.select(F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"), "value")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = lines.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.join(F.broadcast(base), "part").select((F.col("base") + F.col("at")).alias("line"), "value")


def training_set(spark: SparkSession, path: str) -> DataFrame:
    """row_id, features, target from a text file: a head line with three counts, then inputs
    and outputs on alternating lines."""
    lines = numbered_lines(spark, path).where("line > 0 and trim(value) <> ''")
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.cast("double"))
    rows = lines.select(F.floor((F.col("line") - 1) / 2).alias("row_id"), (F.col("line") % 2 == 1).alias("inputs"), numbers.alias("v"))
    return rows.groupBy("row_id").agg(F.max(F.when(F.col("inputs"), F.col("v"))).alias("features"), F.max(F.when(~F.col("inputs"), F.col("v"))).alias("target"))


def training_lines(data: DataFrame, decimals: int | None = None) -> DataFrame:
    """The lines of such a file in order, by row_id; with decimals, as fixed-point integers."""
    scale = (lambda v: F.round(v * (1 << decimals)).cast("long").cast("string")) if decimals is not None else (lambda v: v.cast("string"))
    text = lambda c: F.array_join(F.transform(c, scale), " ")
    head = data.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("i"), F.max(F.size("target")).alias("o")).select(F.lit(-1).cast("long").alias("row_id"), F.lit(0).alias("part"), F.concat_ws(" ", "n", "i", "o").alias("value"))
    body = data.select("row_id", F.posexplode(F.array(text("features"), text("target"))).alias("part", "value"))
    return head.unionByName(body).orderBy("row_id", "part").select("value")


def generated(spark: SparkSession, rows: int, make) -> DataFrame:
    """A training set of which make(row_id column) gives features and target."""
    features, target = make(F.col("id"))
    return spark.range(rows).select(F.col("id").alias("row_id"), features.alias("features"), target.alias("target"))


def decimal_point(net: Network, bits: int = 32) -> int:
    """Binary places that a fixed-point copy of the network can have."""
    largest = max(float(np.abs(x.weights).max()) for x in net.layers)
    most = int(np.floor(np.log2(max(largest, 1e-9)))) + 1 if largest > 0 else 0
    return (bits - 2 - max(most, 0)) // 2


def network_text(net: Network, fixed: bool = False) -> str:
    """A network as text: sizes with biases, neurons as (inputs, activation, steepness),
    connections as (neuron, weight)."""
    places = decimal_point(net)
    number = (lambda v: str(round(v * (1 << places)))) if fixed else (lambda v: f"{v:.20e}")
    # a shortcut network has one bias, after its inputs
    sizes = [n + (1 if not net.shortcut or not k else 0) for k, n in enumerate(net.sizes)]
    neurons, links, first = [(0, 0, 0.0)] * sizes[0], [], 0
    for k, x in enumerate(net.layers):
        inputs, width = net.sizes[0], x.weights.shape[1]
        sources = [*range(inputs), *range(inputs + 1, width), inputs] if net.shortcut else list(range(first, first + sizes[k]))
        for i in range(x.weights.shape[0]):
            kept = [j for j in range(width) if x.mask is None or x.mask[i, j]]
            neurons.append((len(kept), NAMES.index(x.activation), x.steepness))
            links += [(sources[j], x.weights[i, j]) for j in kept]
        neurons += [(0, 0, 0.0)] * (not net.shortcut)
        first += sizes[k]
    return "\n".join(
        [
            FIXED_FILE if fixed else FLOAT_FILE,
            *[f"decimal_point={places}"] * fixed,
            f"num_layers={len(sizes)}",
            f"network_type={int(net.shortcut)}",
            f"layer_sizes={' '.join(map(str, sizes))} ",
            "neurons (num_inputs, activation_function, activation_steepness)=" + "".join(f"({a}, {b}, {number(c)}) " for a, b, c in neurons),
            "connections (connected_to_neuron, weight)=" + "".join(f"({a}, {number(w)}) " for a, w in links),
            "",
        ]
    )


def _built(sizes: list[int], neurons: list[tuple[int, int, float]], links: list[tuple[int, float]], shortcut: bool) -> Network:
    """A network from layer sizes with biases, (inputs, activation, steepness) of each neuron
    and (neuron, weight) of each connection."""
    layers, at, link, first = [], sizes[0], 0, 0
    for k in range(1, len(sizes)):
        n = sizes[k] - (not shortcut)
        width, inputs = (sum(sizes[:k]) if shortcut else sizes[k - 1]), sizes[0] - 1
        column = (lambda s: s if s < inputs else width - 1 if s == inputs else s - 1) if shortcut else (lambda s: s - first)  # noqa: B023
        weights, mask = np.zeros((n, width)), np.zeros((n, width))
        for i in range(n):
            for source, w in links[link : link + neurons[at + i][0]]:
                weights[i, column(source)], mask[i, column(source)] = w, 1
            link += neurons[at + i][0]
        _, code, steepness = neurons[at]
        layers.append(Layer(weights, NAMES[code], steepness or 0.5, None if mask.all() else mask))
        at, first = at + sizes[k], first + sizes[k - 1]
    return Network(tuple(layers), shortcut)


def _legacy(text: str, fixed: bool) -> Network:
    """The older form: numbers in a row, one activation for the hidden layers and one for the
    output."""
    head, *rest = text.split("\n", 1)[1].split("(")
    numbers = head.split()
    scale = 1 << int(numbers.pop(0)) if fixed else 1
    layers, kind, hidden, last = (int(numbers[i]) for i in (0, 3, 4, 5))
    steep = [float(x) / scale for x in numbers[6:8]]
    sizes, counts = list(map(int, numbers[8 : 8 + layers])), list(map(int, numbers[8 + layers :]))
    output = sum(sizes[:-1])
    neurons = [(n, last, steep[1]) if i >= output else (n, hidden, steep[0]) for i, n in enumerate(counts)]
    links = [(int(a), float(w) / scale) for a, w in (x.split(")", 1)[0].split() for x in rest)]
    return _built(sizes, neurons, links, kind == 1)


def network_of(text: str) -> Network:
    """A layered or shortcut network from such text, float or fixed-point, or from text of the
    older form; unknown entries are ignored."""
    version = text.split("\n", 1)[0].strip()
    if not re.match(r"FANN_(FLO|FIX)_", version):
        raise ValueError(f"not a network file: {version[:40]}")
    if version.endswith("_1.1"):
        return _legacy(text, "FIX" in version)
    entries = dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
    scale = 1 << int(entries["decimal_point"]) if "FIX" in version else 1
    part = lambda head: re.findall(r"\(([^)]*)\)", next(v for k, v in entries.items() if k.startswith(head)))
    neurons = [(int(a), int(b), float(c) / scale) for a, b, c in (x.split(",") for x in part("neurons"))]
    links = [(int(a), float(b) / scale) for a, b in (x.split(",") for x in part("connections"))]
    return _built(list(map(int, entries["layer_sizes"].split())), neurons, links, entries.get("network_type", "0").strip() == "1")


def load_network(spark: SparkSession, path: str) -> Network:
    """A network file from any store that Spark reads."""
    return network_of(spark.read.text(path, wholetext=True).first()[0])


def report_lines(report: DataFrame) -> DataFrame:
    """The statistics report as tab-separated lines, section by section."""
    return report.orderBy("section", "bin").select(F.concat_ws("\t", "section", "bin", "label", "n", "cum").alias("value"))
