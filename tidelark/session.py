"""Sessions, and making this package known to executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

import tidelark

_shipped: set[str] = set()
#: Staged tables of this process, and where they are.
_staged: dict[str, tuple] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors once per application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(tidelark.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="tidelark-")) / "tidelark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master, where it may be unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidelark/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that lost executors don't mean recomputing it.

    The table is deleted by `unstage`, by `release`, or when this process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _staged[path] = (place.getFileSystem(spark._jsc.hadoopConfiguration()), place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes what `staged` wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for own in [k for k in _staged if k.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
            _delete(own)


def staged_paths() -> list[str]:
    return list(_staged)


def release(paths: Iterable[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in list(paths):
        _delete(path)


def _delete(path: str) -> None:
    if path in _staged:
        store, place = _staged.pop(path)
        store.delete(place, True)


def _clean_up() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone by then
        release(staged_paths())


atexit.register(_clean_up)


def session(app: str = "tidelark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; other settings by keyword, dots as two underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
