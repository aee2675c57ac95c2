"""Feed-forward nets: scored as matrix products on Arrow batches, trained with gradients that tasks compute and Spark adds up."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FORMAT = "spanmill-net-1"
#: Gradients are added up as multiples of this, so their sum doesn't depend on the order of tasks.
UNIT = 2.0**-30


class NetError(ValueError):
    """A net or training data whose parts don't fit."""


@dataclass(frozen=True)
class Net:
    """Linear layers ``(inputs x outputs, biases)`` with ReLU between them; a sigmoid for each output."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    @property
    def inputs(self) -> int:
        return self.layers[0][0].shape[0]

    @property
    def outputs(self) -> int:
        return self.layers[-1][0].shape[1]

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """The input, what each hidden layer makes of it, and the logits."""
        out = [x]
        for k, (weights, bias) in enumerate(self.layers):
            z = out[-1] @ weights + bias
            out.append(z if k == len(self.layers) - 1 else np.maximum(z, 0))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores, one row for each row of ``x``; another width raises."""
        if x.ndim != 2 or x.shape[1] != self.inputs:
            raise NetError(f"rows of width {x.shape[-1]}, the net takes {self.inputs}")
        return sigmoid(self.activations(x)[-1])

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in self.layers for part in layer])

    def like(self, flat: np.ndarray) -> Net:
        """A net of the same shape with these parameters."""
        at, layers = 0, []
        for weights, bias in self.layers:
            w, b = flat[at : at + weights.size].reshape(weights.shape), flat[at + weights.size : at + weights.size + bias.size]
            at += weights.size + bias.size
            layers.append((w, b))
        return Net(tuple(layers))

    def to_json(self, digits: int | None = None) -> str:
        shown = (lambda a: np.round(a, digits).tolist()) if digits is not None else (lambda a: a.tolist())
        return json.dumps({"format": FORMAT, "layers": [{"weights": shown(w), "bias": shown(b)} for w, b in self.layers]})

    @staticmethod
    def from_json(text: str) -> Net:
        """The inverse; another format, no layers, ragged or unconnected ones and non-finite numbers raise."""
        raw = json.loads(text)
        if not isinstance(raw, dict) or raw.get("format") != FORMAT or not raw.get("layers"):
            raise NetError("not a net, or one without layers")
        try:
            layers = tuple((np.array(x["weights"], np.float64), np.array(x["bias"], np.float64)) for x in raw["layers"])
        except (KeyError, TypeError, ValueError) as e:
            raise NetError(f"a layer can't be read: {e}") from None
        return checked(layers)


def checked(layers) -> Net:
    width = None
    for weights, bias in layers:
        if weights.ndim != 2 or bias.ndim != 1 or weights.shape[1] != len(bias) or not weights.size or width not in (None, weights.shape[0]):
            raise NetError("layers don't fit each other")
        if not (np.isfinite(weights).all() and np.isfinite(bias).all()):
            raise NetError("parameters that aren't finite")
        width = weights.shape[1]
    return Net(tuple(layers))


def fresh(sizes: list[int], seed: int = 0) -> Net:
    """A net of random weights by He's rule and zero biases; ``sizes`` are its widths from input to output."""
    if len(sizes) < 2 or min(sizes) < 1:
        raise NetError("a net needs positive widths")
    rng = np.random.default_rng(seed)
    return checked([(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


def scores(features: Column, net: Net) -> Column:
    """The net's scores of an array column, as an array; a matrix product for each Arrow batch. A null array has null scores, another width raises."""

    def run(column: pa.Array) -> pa.Array:
        return _listed(column, column.flatten().to_numpy(zero_copy_only=False), net)

    return F.arrow_udf(run, "array<double>")(features.cast("array<double>"))


def with_scores(rows: DataFrame, features: str, net: Net, out: str = "scores") -> DataFrame:
    """``rows`` with a column of arrays of feature arrays replaced by one of arrays of score arrays, under the name ``out``."""
    kept = [f for f in rows.schema.fields if f.name != features]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            inner = column.flatten()
            found = _listed(inner, inner.flatten().to_numpy(zero_copy_only=False), net)
            ends = np.append(0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))).astype(np.int32)
            nested = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(np.asarray(column.is_null()), False)), found)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], nested], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[F.col(f"`{n}`") for n in names], F.col(features).cast("array<array<double>>").alias("__x")).mapInArrow(run, f"{schema}, `{out}` array<array<double>>")


def _listed(lists: pa.Array, values: np.ndarray, net: Net) -> pa.Array:
    """Scores of each list as a list; ``values`` are the lists' own."""
    null = np.asarray(lists.is_null())
    widths = np.asarray(lists.value_lengths().fill_null(net.inputs))
    if (widths != net.inputs).any():
        raise NetError(f"rows of width {sorted(set(widths.tolist()) - {net.inputs})}, the net takes {net.inputs}")
    found = net.predict(values.astype(np.float64).reshape(-1, net.inputs))
    ends = np.append(0, np.cumsum(np.where(null, 0, net.outputs))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), pa.array(found.ravel()))


def gradient(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over rows of the gradient and the loss: cross entropy of each output, positives weighing ``positive``, NaN targets nothing."""
    acts = net.activations(x)
    p = sigmoid(acts[-1])
    known = ~np.isnan(y)
    t = np.where(known, y, 0)
    each = weight[:, None] * known * np.where(t > 0, positive, 1.0)
    loss = -(each * (t * np.log(np.maximum(p, 1e-300)) + (1 - t) * np.log(np.maximum(1 - p, 1e-300)))).sum()
    delta, parts = each * (p - t), []
    for k in range(len(net.layers) - 1, -1, -1):
        parts.append((acts[k].T @ delta, delta.sum(axis=0)))
        if k:
            delta = (delta @ net.layers[k][0].T) * (acts[k] > 0)
    return np.concatenate([part.ravel() for layer in reversed(parts) for part in layer]), float(loss)


def _summed(rows: DataFrame, net: Net, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and loss over all rows ``(features, targets, weight)``: one row of sums for each task, added up in integers."""
    outputs, width = net.outputs, net.inputs

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros(net.flat().size), 0.0
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, width)
            y = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, outputs)
            g, more = gradient(net, x, y, np.asarray(batch.column(2), np.float64), positive)
            total, loss = total + g, loss + more
        sums = np.rint(np.append(total, loss) / UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["at", "units"])

    parts = rows.mapInArrow(scan, "at int, units long").groupBy("at").agg(F.sum("units").alias("units"))
    out = np.zeros(net.flat().size + 1)
    for at, units in parts.collect():  # a row for each parameter
        out[at] = units * UNIT
    return out[:-1], float(out[-1])


@dataclass(frozen=True)
class Fitted:
    net: Net
    losses: tuple[float, ...]
    rows: int


def fit(
    rows: DataFrame, hidden: tuple[int, ...] = (16,), features: str = "features", targets: str = "targets", weight: str | None = None,
    epochs: int = 80, rate: float = 0.03, positive: list[float] | None = None, seed: int = 0,
) -> Fitted:
    """A net with ReLU layers of ``hidden`` widths and one output for each target, by Adam on full gradients.

    ``features`` and ``targets`` are arrays of one width each; a target is 0, 1
    or null (no example). In each epoch tasks add up the gradients of their
    rows on Arrow batches and Spark adds up the tasks, in whole units, so
    reruns over the same rows and partitions agree; the net, some thousand
    numbers, goes out with the next epoch.

    The first epoch also checks the data, without a scan of its own: rows of
    other widths or with null or non-finite features, targets other than 0 and
    1, weights that are null, negative or not finite, and a target that has one
    class only raise ``NetError`` before anything is learnt; so does an empty table.
    """
    if epochs < 1 or any(h < 1 for h in hidden):
        raise NetError("positive widths and epochs are needed")
    head = rows.select(F.size(features).alias("x"), F.size(targets).alias("y")).where("x > 0 and y > 0").first()
    if head is None:
        raise NetError("no rows with features and targets")
    width, outputs = head
    positives = np.array(positive if positive is not None else [1.0] * outputs, float)
    if len(positives) != outputs:
        raise NetError(f"{len(positives)} weights of positives for {outputs} targets")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    plain = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"), w.alias("w"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce((F.size("x") == width) & (F.size("y") == outputs) & F.forall("x", finite) & F.forall("y", lambda t: t.isNull() | t.isin(0.0, 1.0)) & finite(F.col("w")) & (F.col("w") >= 0), F.lit(False))
    plain = plain.withColumn("sound", sound).persist()
    try:
        seen = Observation()
        count = lambda k, v: F.count_if(F.col("sound") & (F.get("y", F.lit(k)) == v)).alias(f"n{k}_{v}")
        observed = plain.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("sound")).alias("bad"), *[count(k, v) for k in range(outputs) for v in (0, 1)])
        net = fresh([width, *hidden, outputs], seed)
        flat = net.flat()
        first, second, losses = np.zeros(flat.size), np.zeros(flat.size), []
        for step in range(1, epochs + 1):
            source = observed if step == 1 else plain
            total, loss = _summed(source.where("sound").select("x", "y", "w"), net.like(flat), positives)
            if step == 1:
                facts = seen.get
                _check(facts, outputs)
            mean = total / facts["rows"]
            first, second = 0.9 * first + 0.1 * mean, 0.999 * second + 0.001 * mean**2
            flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            losses.append(loss / facts["rows"])
        return Fitted(net.like(flat), tuple(losses), facts["rows"])
    finally:
        plain.unpersist()


def _check(facts: dict, outputs: int) -> None:
    if facts["bad"]:
        raise NetError(f"{facts['bad']} of {facts['rows']} rows have other widths, or features, targets or weights that can't be used")
    single = [k for k in range(outputs) if not facts[f"n{k}_0"] or not facts[f"n{k}_1"]]
    if single:
        raise NetError(f"targets {single} have one class only")
