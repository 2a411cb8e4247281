"""What another runtime needs to score windows, as files of a folder."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidelark.functions.features import REGISTRY
from tidelark.sources.artifacts import Bundle, node_table, write_csv, write_json


def export(spark: SparkSession, bundle: Bundle, gate: tuple[float, float], folder: str) -> list[str]:
    """Writes the bundle, trees, features with their meaning, preprocessing, gate, postprocessing and model parameters; returns the names.

    Features outside the registry are refused: nothing else can compute them.
    """
    if unknown := [f for f in bundle.features if f not in REGISTRY]:
        raise ValueError(f"not in the registry: {', '.join(unknown)}")
    at = lambda name: f"{folder.rstrip('/')}/{name}"
    write_json(spark, bundle.to_json(), at("bundle.json"))
    write_json(spark, bundle.model.to_json(), at("model.json"))
    write_csv(node_table(spark, bundle.model).coalesce(1), at("nodes.csv"))
    order = [(i, f, REGISTRY[f].group, REGISTRY[f].meaning) for i, f in enumerate(bundle.features)]
    write_csv(spark.createDataFrame(order, "position int, feature string, group string, meaning string").coalesce(1), at("features.csv"))
    prepared = [(f, bundle.fills.get(f, 0.0), *map(float, bundle.clips.get(f, (float("-inf"), float("inf"))))) for f in bundle.features]
    write_csv(spark.createDataFrame(prepared, "feature string, fill double, low double, high double").coalesce(1), at("preprocess.csv"))
    write_json(spark, json.dumps({"dc_above": gate[0], "ac_dc_ratio_below": gate[1]}), at("gate.json"))
    write_json(spark, json.dumps({"threshold": bundle.threshold} | bundle.postprocess), at("postprocess.json"))
    return ["bundle.json", "model.json", "nodes.csv", "features.csv", "preprocess.csv", "gate.json", "postprocess.json"]
