"""Experiments from specifications: training, validation and evaluation of models on shared features, and a leaderboard.

A specification is a JSON object: ``name``, ``training_path`` (trainer
records), ``split_numerator`` and ``split_denominator`` of the records that
train, ``pattern`` of the candidates, ``features`` (components of a kernel),
``model`` (``kind`` and its parameters), ``evaluation_paths``, and at will
``training_limit``. Experiments that name the same records, pattern and
features share one extraction.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators import metrics as A
from spanmill.operators import models as M
from spanmill.operators import nets, sampling
from spanmill.operators.kernels import SpecError, compile_kernel
from spanmill.sources import bundles, records

#: Fits a model on rows ``(features, label)`` and returns the score as a function of the feature column.
Fit = Callable[..., Callable[[Column], Column]]
MODELS: dict[str, Fit] = {}


def model(kind: str) -> Callable[[Fit], Fit]:
    """Registers a model under a name that specifications use."""

    def add(fit: Fit) -> Fit:
        if kind in MODELS:
            raise SpecError(f"there is a model {kind!r} already")
        MODELS[kind] = fit
        return fit

    return add


@model("logistic")
def _logistic(rows: DataFrame, penalty: float = 0.001) -> Callable[[Column], Column]:
    weights, bias = M.fit_logistic(rows, penalty=penalty)
    return lambda x: M.logistic(x, weights, bias)


@model("net")
def _net(rows: DataFrame, hidden: list[int] = (16,), epochs: int = 80, rate: float = 0.03, seed: int = 0, positive: float = 1.0) -> Callable[[Column], Column]:
    fitted = nets.fit(rows.select("features", F.array("label").alias("targets")), tuple(hidden), epochs=epochs, rate=rate, positive=[positive], seed=seed)
    return lambda x: nets.scores(x, fitted.net)[0]


@dataclass(frozen=True)
class Spec:
    name: str
    training_path: str
    features: list[dict]
    model: dict
    evaluation_paths: list[str] = field(default_factory=list)
    pattern: str = "[.!?]"
    split_numerator: int = 4
    split_denominator: int = 5
    training_limit: int | None = None

    @property
    def extraction(self) -> str:
        """What two experiments must agree in to share their features."""
        return json.dumps([self.training_path, self.training_limit, self.pattern, self.features, self.evaluation_paths], sort_keys=True)


def parse(text: str) -> Spec:
    """A specification from JSON; unknown and missing fields, models and components raise ``SpecError``."""
    try:
        raw = json.loads(text)
        spec = Spec(**raw)
    except (TypeError, json.JSONDecodeError) as e:
        raise SpecError(f"a specification can't be read: {e}") from None
    if spec.model.get("kind") not in MODELS:
        raise SpecError(f"unknown model {spec.model.get('kind')!r}; there are {sorted(MODELS)}")
    if not 0 < spec.split_numerator < spec.split_denominator:
        raise SpecError("a split needs 0 < numerator < denominator")
    compile_kernel(spec.features, spec.pattern)
    return spec


def read(spark: SparkSession, paths: list[str]) -> list[Spec]:
    """Specifications from files; two of one name raise."""
    specs = [parse(bundles._read(spark, path, bundles.MANIFEST_BYTES).decode()) for path in paths]
    if len({s.name for s in specs}) < len(specs):
        raise SpecError("two experiments have one name")
    return specs


def _examples(spark: SparkSession, spec: Spec, path: str, limit: int | None = None) -> DataFrame:
    """``(doc_id, break_end, features, label)``: candidates of trainer records, and whether a closed sentence ends there."""
    found = records.read_records(spark, [path], limit, required=True).records.select(F.col("number").alias("doc_id"), "text", "spans")
    rows = compile_kernel(spec.features, spec.pattern).candidates(found.select("doc_id", "text"))
    gold = found.select("doc_id", F.explode(F.filter("spans", lambda s: ~s["right_open"])).alias("s")).select("doc_id", F.col("s.end").alias("break_end"), F.lit(1).alias("label")).distinct()
    return rows.select("doc_id", "break_end", "features").join(gold, ["doc_id", "break_end"], "left").fillna(0, ["label"])


def scores(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """``(experiment, part, label, score)`` of every candidate in validation and evaluation; features are extracted once for all experiments that share them."""
    out: DataFrame | None = None
    shared: dict[str, tuple[DataFrame, list[DataFrame]]] = {}
    for spec in specs:
        if spec.extraction not in shared:
            shared[spec.extraction] = _examples(spark, spec, spec.training_path, spec.training_limit).persist(), [_examples(spark, spec, p).persist() for p in spec.evaluation_paths]
        examples, evaluation = shared[spec.extraction]
        split = sampling.prefix_split(examples.select("doc_id").distinct(), "doc_id", spec.split_numerator, spec.split_denominator)
        train = examples.join(split, "doc_id")
        options = {k: v for k, v in spec.model.items() if k != "kind"}
        try:
            score = MODELS[spec.model["kind"]](train.where("train"), **options)
        except TypeError as e:
            raise SpecError(f"{spec.name}: {e}") from None
        parts = [("validation", train.where("not train")), *(("evaluation", rows) for rows in evaluation)]
        for part, rows in parts:
            scored = rows.select(F.lit(spec.name).alias("experiment"), F.lit(part).alias("part"), F.col("label").cast("int").alias("label"), score(F.col("features")).alias("score"))
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise SpecError("no experiments")
    return out


def run(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The leaderboard of the experiments that the files specify: best thresholds and F1 in validation and evaluation, ranked."""
    return A.leaderboard(scores(spark, read(spark, paths)))
