"""Feature kernels from a specification: a JSON list of components becomes one array column over ``features.line_context``."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.operators import features as X


class SpecError(ValueError):
    """A specification that names no such component, or one with wrong parameters."""


def _classes(names: list[str]) -> list[str]:
    unknown = [n for n in names if n not in X.BYTE_CLASSES]
    if unknown:
        raise SpecError(f"unknown byte classes {unknown}")
    return [X.BYTE_CLASSES[n] for n in names]


#: Component kinds: how wide each is and how it is built, from its parameters.
KINDS: dict[str, tuple[Callable[..., int], Callable[..., Column]]] = {
    "byte_window": (lambda left, right: left + right + 1, X.byte_window),
    "encoded_byte_window": (lambda left, right: left + right + 1, X.encoded_window),
    "ascii_class": (lambda: 6, X.ascii_neighbours),
    "boundary_shape": (lambda: 22, X.boundary_shape),
    "token_shape": (lambda: 12, X.token_shape),
    "byte_class_counts": (lambda left, right, classes: len(classes), lambda left, right, classes: X.class_counts(_classes(classes), left, right)),
    "directional_byte_class_counts": (lambda left, right, classes: 2 * len(classes), lambda left, right, classes: X.class_counts(_classes(classes), left, right, True)),
    "unicode_category_counts": (lambda left, right, categories: len(categories), lambda left, right, categories: X.class_counts([f"\\p{{{c}}}" for c in categories], left, right)),
    "directional_unicode_category_counts": (lambda left, right, categories: 2 * len(categories), lambda left, right, categories: X.class_counts([f"\\p{{{c}}}" for c in categories], left, right, True)),
    "lexicon": (lambda left=5, right=3: left + right + 9, X.lexicon_block),
    "terminators": (lambda: X.TERMINATOR_WIDTH, X.terminator_block),
    "line_byte_counts": (lambda: len(X.LINE_CHARS), lambda: F.col("line_shares")),
}


#: Components that look at their line, and what the others need of ``features.context`` beyond ``EVERYTHING`` and its reach.
LINE_KINDS = {"boundary_shape", "line_byte_counts"}
NEEDS = {"lexicon": (X.LEXICON_FIELDS[1:], X.LEXICON_REACH), "terminators": (X.TERMINATOR_FIELDS[1:], X.REACH)}
#: Components that also work on an element of ``text.locate`` inside a row.
IN_ROW = {"lexicon", "terminators"}


@dataclass(frozen=True)
class Kernel:
    """A compiled specification: names and widths of its blocks, and the column that holds all of them.

    ``inner`` makes the same column of a context inside a row, from a getter of
    its fields; it is missing where a component can't.
    """

    blocks: tuple[tuple[str, int], ...]
    features: Column
    pattern: str = "[.!?]"
    around: tuple[str, ...] = X.EVERYTHING
    reach: int = X.REACH
    inner: Callable[[Callable[[str], Column]], Column] | None = None

    @property
    def width(self) -> int:
        return sum(n for _, n in self.blocks)

    def extract(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, feature_pos, features)`` of all candidates."""
        return self.candidates(docs).drop("break_end")

    def candidates(self, docs: DataFrame) -> DataFrame:
        """The same with ``break_end``, the byte behind the candidate."""
        context = X.line_context if LINE_KINDS & {name for name, _ in self.blocks} else X.context
        return context(docs, self.pattern, reach=self.reach, around=self.around).select(
            "doc_id", "feature_pos", (F.col("feature_pos") + F.octet_length("here")).alias("break_end"), self.features.alias("features")
        )


def compile_kernel(spec: str | list[dict], pattern: str = "[.!?]") -> Kernel:
    """A kernel from ``[{"kind": ..., parameters}, ...]``, as JSON or as it is; an unknown kind or parameter raises."""
    components = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(components, list) or not components:
        raise SpecError("a kernel needs a list of components")
    blocks, columns, builders = [], [], []
    for c in components:
        kind, parameters = c.get("kind"), {k: v for k, v in c.items() if k != "kind"}
        if kind not in KINDS:
            raise SpecError(f"unknown component {kind!r}")
        width, build = KINDS[kind]
        try:
            blocks.append((kind, width(**parameters)))
        except TypeError as e:
            raise SpecError(f"{kind}: {e}") from None
        if max((parameters.get(k, 0) for k in ("left", "right")), default=0) > X.REACH:
            raise SpecError(f"{kind}: windows reach {X.REACH} characters at most")
        columns.append(build(**parameters))
        builders.append((build, parameters))
    needs = [NEEDS[name] for name, _ in blocks if name in NEEDS]
    around = tuple(dict.fromkeys((*X.EVERYTHING, *(f for fields, _ in needs for f in fields))))
    inner = None
    if {name for name, _ in blocks} <= IN_ROW:
        inner = lambda get: F.concat(*[build(**parameters, get=get) for build, parameters in builders])
        around = tuple(dict.fromkeys(f for fields, _ in needs for f in fields))
    return Kernel(tuple(blocks), F.concat(*columns), pattern, around, max([X.REACH, *(r for _, r in needs)]), inner)
