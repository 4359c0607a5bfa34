"""Recordings as a data source: `spark.read.format("recording")` and `readStream`, one file one partition.

A recording is a NumPy archive (X, labels, blocks, fs, subject, session). Files are listed and read through Arrow's file
systems, so a folder may be local, in HDFS or in an object store. As a stream, new files are taken in order of name: the
offset is the last name seen, and so a restart goes on behind it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROWS = "file string, subject string, session string, trial int, block int, label string, idle boolean, fs double, signal array<array<double>>"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Trials of an Arrow batch.
_BATCH = 256


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Names of a folder's recordings, in order."""
    store, root = _open(path)
    found = store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".npz"))


def _rows(path: str, name: str, idle: str) -> Iterator[pa.RecordBatch]:
    store, root = _open(path)
    with store.open_input_stream(f"{root}/{name}") as f:
        z = np.load(io.BytesIO(f.read()), allow_pickle=False)
    x, labels = z["X"].astype(np.float64), z["labels"].astype(str)
    if len(x) != len(labels):
        raise ValueError(f"{name}: {len(x)} trials, {len(labels)} labels")
    # Without blocks of its own, a run of equal labels is a block.
    blocks = z["blocks"] if "blocks" in z else np.cumsum(np.append(0, labels[1:] != labels[:-1]))
    said = [str(z[k]) if k in z else "" for k in ("subject", "session")]
    for at in range(0, len(x), _BATCH):
        n = len(x[at : at + _BATCH])
        columns = [
            pa.array([name] * n),
            *(pa.array([s] * n) for s in said),
            pa.array(np.arange(at, at + n), pa.int32()),
            pa.array(blocks[at : at + n], pa.int32()),
            pa.array(labels[at : at + n].tolist()),
            pa.array([v.startswith(idle) for v in labels[at : at + n]]),
            pa.array([float(z["fs"])] * n),
            pa.array(x[at : at + n].tolist(), pa.list_(pa.list_(pa.float64()))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.idle = options["path"], options.get("idle", "idle")
        wanted = options.get("subjects", "")
        self.subjects = set(wanted.split(",")) if wanted else None

    def partitions(self) -> list[InputPartition]:
        """One a file; a list of subjects leaves out the files of others, which are not opened at all."""
        return [_File(f) for f in _files(self.path) if self.subjects is None or f.split("__")[0] in self.subjects]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        """Without files Spark asks for one part that is none."""
        return _rows(self.path, partition.name, self.idle) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.idle = options["path"], options.get("idle", "idle")

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(_files(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path) if start["last"] < f <= end["last"]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition.name, self.idle)


class Recordings(DataSource):
    """Options: path; subjects (names with commas between) for batch reads; idle (prefix of labels of the idle set)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def write_recordings(epochs: DataFrame, path: str, subject: str, session: str, order: str, label: str, signal: str = "signal", block: str | None = None, fs: float = 250.0) -> DataFrame:
    """(file, trials): one recording of each subject and session, as subject__session.npz; nothing is written until it is read.

    A file is written whole by one task, as a recording is one sitting; a task that runs again writes the same file.
    """

    def save(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_order")
        body, (store, root) = io.BytesIO(), _open(path)
        blocks = {"blocks": part["_block"].to_numpy(dtype=np.int64)} if block else {}
        np.savez_compressed(body, X=np.stack([np.stack(s) for s in part["_x"]]), labels=part["_label"].to_numpy(dtype=str), fs=np.asarray(fs), subject=np.asarray(str(key[0])), session=np.asarray(str(key[1])), **blocks)
        store.create_dir(root, recursive=True)
        name = f"{key[0]}__{key[1]}.npz"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(body.getvalue())
        return pd.DataFrame({"file": [name], "trials": [len(part)]})

    rows = epochs.select(subject, session, F.col(order).alias("_order"), F.col(label).cast("string").alias("_label"), F.col(signal).alias("_x"), *([F.col(block).alias("_block")] if block else []))
    return rows.groupBy(subject, session).applyInPandas(save, "file string, trials bigint")
