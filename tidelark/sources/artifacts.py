"""Artifacts of a run: tables with a fixed schema as CSV or Parquet, and what was learned as one JSON document."""

from __future__ import annotations

import json
import platform
from dataclasses import dataclass, field
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators.trees import Ensemble

REQUIRED = ["features", "fills", "clips", "model", "threshold"]


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, even if there are no rows."""
    rows = df if df.head(1) else df.repartition(1)  # an empty frame of no partitions would leave no file, hence no header
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


@dataclass
class Bundle:
    """What scoring needs, and how it came about."""

    features: list[str]
    fills: dict[str, float]
    clips: dict[str, tuple[float, float]]
    model: Ensemble
    threshold: float
    bands: dict[str, tuple[float, float]] = field(default_factory=dict)
    quality: dict[str, tuple[str, float]] = field(default_factory=dict)
    postprocess: dict[str, Any] = field(default_factory=dict)
    fingerprint: dict[str, Any] = field(default_factory=dict)

    def to_json(self) -> str:
        plain = {k: v for k, v in self.__dict__.items() if k != "model"}
        return json.dumps(plain | {"model": json.loads(self.model.to_json())}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Bundle:
        x = json.loads(text)
        if missing := [k for k in REQUIRED if k not in x]:
            raise ValueError(f"the bundle lacks {', '.join(missing)}")
        pairs = lambda d: {k: tuple(v) for k, v in d.items()}
        return Bundle(**x | {"model": Ensemble.from_json(json.dumps(x["model"])), "clips": pairs(x["clips"]), "bands": pairs(x.get("bands", {})), "quality": pairs(x.get("quality", {}))})


def write_json(spark: SparkSession, text: str, path: str) -> None:
    """One document as a text file of the store."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()).rstrip("\n")


def fingerprint(spark: SparkSession, folder: str | None = None, pattern: str = "*", prefix: int = 4 << 20) -> dict[str, Any]:
    """Versions, and digests of the first bytes of input files."""
    out: dict[str, Any] = {"python": platform.python_version(), "spark": spark.version, "pyspark": pyspark.__version__}
    if folder:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        digests = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2(F.substring("content", 1, prefix), 256).alias("sha256"))
        out["inputs"] = {r["name"]: r["sha256"] for r in digests.collect()}
    return out


def node_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """The ensemble as rows of nodes."""
    rows = []
    for t, tree in enumerate(model.trees):
        for i, n in enumerate(tree.nodes):
            if hasattr(n, "value"):
                rows.append((t, i, f"{t}-{i}", "Leaf", None, None, None, None, 0.0, n.cover, n.value))
            else:
                rows.append((t, i, f"{t}-{i}", n.feature, n.threshold, n.yes, n.no, n.missing, n.gain, n.cover, None))
    return spark.createDataFrame(rows, "Tree int, Node int, ID string, FeatureName string, Split double, Yes int, No int, Missing int, Gain double, Cover double, LeafValue double")
