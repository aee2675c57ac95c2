"""Model artifacts: a JSON form of linear models, and bundle manifests checked against their files in Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "spanmill-logistic-1"
MANIFEST = "format string, name string, version string, engine string, task string, thresholds map<string,double>, files array<struct<path:string,role:string,bytes:bigint,sha256:string>>"


class ArtifactError(ValueError):
    """A model file or bundle that can't be used."""


def model_to_json(weights: list[float], bias: float, blocks: list[tuple[str, int]]) -> str:
    """Weights with their feature blocks ``(name, width)``."""
    at, schema = 0, []
    for name, width in blocks:
        schema.append({"name": name, "offset": at, "width": width})
        at += width
    if at != len(weights):
        raise ArtifactError(f"blocks hold {at} features, the model {len(weights)}")
    return json.dumps({"format": FORMAT, "bias": bias, "weights": weights, "feature_dim": at, "schema_blocks": schema})


def model_from_json(text: str) -> tuple[list[float], float, list[tuple[str, int]]]:
    """The inverse; another format or width is an error."""
    raw = json.loads(text)
    if raw.get("format") != FORMAT:
        raise ArtifactError(f"unknown format {raw.get('format')!r}")
    blocks = [(b["name"], b["width"]) for b in raw["schema_blocks"]]
    if sum(w for _, w in blocks) != raw["feature_dim"] or raw["feature_dim"] != len(raw["weights"]):
        raise ArtifactError("widths differ")
    return raw["weights"], raw["bias"], blocks


def check_bundles(spark: SparkSession, root: str) -> DataFrame:
    """``(bundle, path, role, problem)``: each file that a manifest under ``root`` lists, and what is wrong with it (null: nothing).

    Reads ``*/manifest.json`` and hashes the files in place, so any number of
    bundles is checked by one job. Unsafe paths, missing files, sizes and
    SHA-256 are told apart.
    """
    folder = lambda c: F.regexp_extract(c, "([^/]+)/[^/]+$", 1)
    manifests = spark.read.option("multiLine", True).schema(MANIFEST).json(f"{root}/*/manifest.json").select(folder(F.col("_metadata.file_path")).alias("bundle"), F.explode("files").alias("f"))
    files = spark.read.format("binaryFile").load(f"{root}/*/*").select(
        folder(F.col("path")).alias("bundle"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256")
    )
    listed = manifests.select("bundle", "f.path", "f.role", F.col("f.bytes").alias("bytes"), F.col("f.sha256").alias("wanted"))
    both = listed.join(files.withColumnRenamed("file", "path"), ["bundle", "path"], "left")
    problem = (
        F.when(F.col("path").rlike("^/|^[A-Za-z]:|(?:^|/)\\.\\.(?:/|$)|\\\\"), "unsafe path").when(F.col("length").isNull(), "missing")
        .when(F.col("length") != F.col("bytes"), "size").when(F.col("sha256") != F.lower("wanted"), "sha256")
    )
    return both.select("bundle", "path", "role", problem.alias("problem"))
