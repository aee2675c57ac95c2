"""A pipeline builder (§2.11): scan, features, model and decoder as DataFrame functions, composed lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.operators import decode as D
from spanmill.operators import features as X
from spanmill.operators import models as M


class PipelineError(ValueError):
    """A pipeline that lacks a part or whose parts don't fit."""


@dataclass(frozen=True)
class Pipeline:
    """``run`` gives spans ``(doc_id, start, end)`` in bytes; each ``with_*`` returns a new pipeline.

    ``blocks`` are named feature columns over ``features.context``; their order
    is the order of the model's weights.
    """

    pattern: str = "[.!?]"
    blocks: tuple[tuple[str, Callable[[], Column]], ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    threshold: float = 0.5
    tail: bool = True
    heads: tuple[tuple[str, tuple[float, ...], float], ...] = ()

    def with_scanner(self, pattern: str) -> Pipeline:
        return replace(self, pattern=pattern)

    def with_block(self, name: str, block: Callable[[], Column]) -> Pipeline:
        return replace(self, blocks=(*self.blocks, (name, block)))

    def with_model(self, weights: list[float], bias: float) -> Pipeline:
        return replace(self, weights=tuple(weights), bias=bias)

    def with_head(self, name: str, weights: list[float], bias: float) -> Pipeline:
        """One more output of ``score_matrix``; heads are independent."""
        if name in [n for n, *_ in self.heads]:
            raise PipelineError(f"there is a head {name!r} already")
        return replace(self, heads=(*self.heads, (name, tuple(weights), bias)))

    def score_matrix(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, feature_pos, break_end, scores)``: a score of each head, in their order."""
        if not self.heads:
            raise PipelineError("a score matrix needs a head")
        scores = F.array(*[M.logistic(F.col("features"), list(w), b) for _, w, b in self.heads])
        return self.extract(docs).select("doc_id", "feature_pos", "break_end", scores.alias("scores"))

    def selected(self, docs: DataFrame, head: str, threshold: float, eligible: Column | None = None) -> DataFrame:
        """Breaks ``(doc_id, break_end)`` of one head at a threshold, where ``eligible`` holds of a row."""
        at = [n for n, *_ in self.heads].index(head)
        rows = self.score_matrix(docs)
        return (rows.where(eligible) if eligible is not None else rows).where(F.col("scores")[at] >= threshold).select("doc_id", "break_end")

    def with_threshold(self, threshold: float, tail: bool = True) -> Pipeline:
        return replace(self, threshold=threshold, tail=tail)

    @property
    def around(self) -> tuple[str, ...]:
        """What the blocks look at; all there is where a block doesn't say."""
        own = {getattr(X, name): fields for name, fields in X.BLOCK_FIELDS.items()}
        return tuple(dict.fromkeys(f for _, block in self.blocks for f in own.get(block, X.EVERYTHING)))

    @property
    def reach(self) -> int:
        """How far the blocks look."""
        own = {getattr(X, name): reach for name, reach in X.BLOCK_REACH.items()}
        return max((own.get(block, X.REACH) for _, block in self.blocks), default=X.REACH)

    def extract(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, feature_pos, break_end, features)``."""
        if not self.blocks:
            raise PipelineError("a pipeline needs a feature block")
        rows = X.context(docs, self.pattern, reach=self.reach, around=self.around)
        return rows.select("doc_id", "feature_pos", (F.col("feature_pos") + F.octet_length("here")).alias("break_end"), F.concat(*[b() for _, b in self.blocks]).alias("features"))

    def score(self, docs: DataFrame) -> DataFrame:
        if not self.weights:
            raise PipelineError("a pipeline needs a model")
        return self.extract(docs).withColumn("score", M.logistic(F.col("features"), list(self.weights), self.bias))

    def run(self, docs: DataFrame) -> DataFrame:
        sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"))
        return D.threshold_spans(self.score(docs), sizes, self.threshold, self.tail)

    def fit(self, docs: DataFrame, gold: DataFrame, penalty: float = 0.001) -> Pipeline:
        """Fit on ``gold`` breaks ``(doc_id, break_end)`` by distributed logistic regression and tune the threshold on them."""
        from spanmill.operators import metrics as A

        rows = self.extract(docs).join(gold.select("doc_id", "break_end").distinct().withColumn("label", F.lit(1)), ["doc_id", "break_end"], "left").fillna(0, ["label"])
        weights, bias = M.fit_logistic(rows, penalty=penalty)
        fitted = self.with_model(weights, bias)
        best = A.best_threshold(A.sweep(rows.select("label", M.logistic(F.col("features"), weights, bias).alias("score")))).first()
        return fitted.with_threshold(best["step"] / 100 if best else 0.5, self.tail)
