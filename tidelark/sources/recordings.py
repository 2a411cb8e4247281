"""Recordings and window caches as tables.

Files are read through Spark's binary source, so any store that Spark reaches
will do; each file is one row until a task has parsed it. HDF5 needs h5py on
the executors; without it, an opener of another tree format can be given.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators.split import NAME
from tidelark.session import ship

#: Channels of each signal, as stored; fixed values.
CHANNELS = {"ppg": 6, "emg": 2, "acc": 3}
#: The first windows of a nested recording are left out.
SKIP = 3


def open_hdf5(content: bytes) -> Mapping:
    """A tree of groups and arrays."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py on the executors") from e
    return h5py.File(io.BytesIO(content), "r")


def files(spark: SparkSession, folder: str, pattern: str = "*.h5") -> DataFrame:
    """path and content of each file of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def has_two_channels(shape: tuple[int, ...]) -> bool:
    """A muscle signal of two channels, continuous or cut into windows."""
    return len(shape) == 2 and 2 in shape or len(shape) == 3 and 2 in shape[1:]


def oriented(a: np.ndarray, channels: int) -> np.ndarray:
    """(time, channels), or (windows, time, channels); an axis of that many is the channels, the last one first."""
    a = np.asarray(a, float)
    if a.ndim == 1:
        a = a[:, None]
    if a.shape[-1] == channels:
        return a
    if a.shape[-2] == channels:
        return np.swapaxes(a, -1, -2)
    if a.ndim == 3:
        raise ValueError(f"no axis of {channels} channels in {a.shape}")
    return a


def _nested(group: Mapping) -> list[tuple[str, int, int, Mapping]]:
    found = []
    for name in group:
        if (m := re.match(NAME, name)) and hasattr(group[name], "keys"):
            found.append((name, int(m[2]), int(m[3]), group[name]))
    return sorted(found, key=lambda x: x[1])


def _channels(a: np.ndarray) -> list[list[float]]:
    return np.ascontiguousarray(a.T).tolist()


def _rows(sample: str, group: Mapping, size: int, stride: int, ratio: int) -> Iterator[dict]:
    """Windows of one sample, or one row that says why it is rejected."""
    nested = _nested(group)
    if nested:
        labels = {label for _, _, label, _ in nested}
        if len(labels) > 1:
            yield {"sample": sample, "reject": "invalid_target"}
            return
        kept = nested[SKIP:]
        if not kept:
            yield {"sample": sample, "reject": "no_windows"}
            return
        if not all("emg" in g and has_two_channels(g["emg"].shape) for _, _, _, g in kept):
            yield {"sample": sample, "reject": "no_emg"}
            return
        whole = {k for k in ("emg", "acc") if all(k in g for _, _, _, g in kept)}  # missing from one: missing from all
        for name, index, label, g in kept:
            signals = {k: _channels(oriented(g[k][()], CHANNELS[k])) for k in ("ppg", *whole) if k in g}
            yield {"sample": sample, "window": name, "window_index": index, "start": index * stride, "target": label} | signals
        return
    tail = sample.rsplit("_", 1)[-1]
    if not re.fullmatch(r"-?\d+", tail):
        yield {"sample": sample, "reject": "invalid_target"}
        return
    if "emg" not in group or not has_two_channels(group["emg"].shape):
        yield {"sample": sample, "reject": "no_emg"}
        return
    if "ppg" not in group:
        yield {"sample": sample, "reject": "no_ppg"}
        return
    a = {k: oriented(group[k][()], CHANNELS[k]) for k in CHANNELS if k in group}
    if a["ppg"].ndim == 3:  # cut already: never cut again
        for i in range(len(a["ppg"])):
            yield {"sample": sample, "window": f"{sample}#{i}", "window_index": i, "start": i * size, "target": int(tail)} | {k: _channels(v[i]) for k, v in a.items() if v.ndim == 3 and i < len(v)}
        return
    for i, start in enumerate(range(0, len(a["ppg"]) - size + 1, stride)):
        row = {"sample": sample, "window": f"{sample}#{i}", "window_index": i, "start": start, "target": int(tail), "ppg": _channels(a["ppg"][start : start + size])}
        for k, r in (("emg", ratio), ("acc", 1)):
            if k in a and start * r < len(a[k]):
                row[k] = _channels(a[k][start * r : (start + size) * r])
        yield row


COLUMNS = ["path", "sample", "window", "window_index", "start", "target", "ppg", "emg", "acc", "reject"]
SIGNALS = "array<array<double>>"
SCHEMA = f"path string, sample string, window string, window_index long, start long, target int, ppg {SIGNALS}, emg {SIGNALS}, acc {SIGNALS}, reject string"


def windows(recordings: DataFrame, opener: Callable[[bytes], Mapping] = open_hdf5, size: int = 300, stride: int = 100, ratio: int = 10) -> DataFrame:
    """A row for each window of each recording (columns path, content), and one with a reason for each rejected sample or unreadable file.

    Nested groups are ordered by the number in their names, without the first
    three, and share one label; flat ones take their label from their name.
    A window is its channels, each an array.
    """
    ship(recordings.sparkSession)
    recordings.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a recording is large; one is parsed at a time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows: list[dict] = []
                try:
                    tree = opener(bytes(content))
                    for sample in sorted(tree):
                        rows += _rows(sample, tree[sample], size, stride, ratio)
                except (OSError, ValueError, KeyError, zipfile.BadZipFile) as e:  # what was read of the file stays
                    rows.append({"sample": None, "reject": f"unreadable: {type(e).__name__}"})
                for i in range(0, len(rows), 64):
                    part = pd.DataFrame([{c: r.get(c) for c in COLUMNS} for r in rows[i : i + 64]]).assign(path=path)
                    yield part.astype({c: "Int64" for c in ("window_index", "start", "target")})

    return recordings.mapInPandas(run, SCHEMA)


CACHE = ["prob_raw", "stage1_enabled", "quality", "ood_rate", "stage1_dc", "stage1_acdc", "window_start_sec", "window_end_sec"]
REQUIRED = ["prob_raw", "stage1_enabled", "target"]


def read_window_caches(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of NPZ caches, one file for each sample: sample, target, window_index and the cached values, null past a shorter array's end."""
    ship(spark)
    fields = ", ".join(f"{c} double" for c in CACHE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    if missing := [k for k in REQUIRED if k not in z]:
                        raise ValueError(f"{path} lacks {', '.join(missing)}")
                    n = len(z["prob_raw"])
                    sample = str(z["sample_name"][()]) if "sample_name" in z else path.rsplit("/", 1)[-1].removesuffix(".npz")
                    values = {}
                    for c in CACHE:
                        a = np.asarray(z[c], float)[:n] if c in z else np.empty(0)
                        values[c] = np.concatenate([a, np.full(n - len(a), np.nan)])
                    yield pd.DataFrame({"sample": sample, "target": int(z["target"][()]), "window_index": np.arange(n)} | values)

    return files(spark, folder, "*.npz").mapInPandas(run, f"sample string, target int, window_index long, {fields}")


def write_window_caches(df: DataFrame, folder: str) -> DataFrame:
    """Writes an NPZ file for each sample to a folder of any store that pyarrow reaches; returns sample, path and n_windows."""
    ship(df.sparkSession)
    held = [c for c in CACHE if c in df.columns]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        pdf = pdf.sort_values("window_index")
        out = io.BytesIO()
        np.savez_compressed(out, sample_name=str(key[0]), target=int(pdf["target"].iloc[0]), **{c: pdf[c].to_numpy() for c in held})
        store.create_dir(base, recursive=True)
        path = f"{base}/{safe_name(str(key[0]))}.npz"
        with store.open_output_stream(path) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"sample": [key[0]], "path": [path], "n_windows": [len(pdf)]})

    kind = dict(df.dtypes)["sample"]
    return df.groupBy("sample").applyInPandas(run, f"sample {kind}, path string, n_windows long")


def safe_name(name: str) -> str:
    """Fit for a file: runs of other characters become an underscore."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name).strip("_") or "sample"


def safe_name_column(c: str) -> object:
    clean = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.when(clean == "", "sample").otherwise(clean)
