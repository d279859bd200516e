"""Sorted arrays of 64-bit keys in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from waymark.session import scratch_folder


def new_folder(spark: SparkSession) -> str:
    return scratch_folder(spark, "arrays")


def local_path(uri: str) -> str | None:
    """The path, if tasks can open it as a file of a shared mount."""
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write at once under the final name, so a task that runs twice leaves one whole file."""
    path = local_path(folder)
    if path is None:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(np.ascontiguousarray(values))
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(np.ascontiguousarray(values))
    os.replace(part, f"{path}/{name}")


def map_array(folder: str, name: str, kind) -> np.ndarray:
    """The array as a memory map. From a remote store it is fetched into a file that goes with the mapping."""
    path = local_path(folder)
    if path is not None:
        return np.memmap(f"{path}/{name}", kind, "r") if os.path.getsize(f"{path}/{name}") else np.empty(0, kind)
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{name}") as source, tempfile.TemporaryFile() as copy:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, kind, "r") if copy.tell() else np.empty(0, kind)


def by_bucket(df: DataFrame, schema: str, bucket: Callable[[dict[str, np.ndarray]], np.ndarray], write: Callable[[int, dict[str, np.ndarray]], dict]) -> DataFrame:
    """Call ``write(bucket, columns)`` once per bucket of a frame whose partitions are sorted by bucket; rows of ``schema`` come back."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        at = None

        def flush() -> pa.RecordBatch:
            whole = {c: np.concatenate([h[c] for h in held]) for c in names}
            held.clear()
            return pa.RecordBatch.from_pydict(write(at, whole))

        for batch in batches:
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            buckets = bucket(columns)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(buckets)], strict=True):
                if start == end:
                    continue
                if at is not None and buckets[start] != at:
                    yield flush()
                at = int(buckets[start])
                held.append({c: v[start:end] for c, v in columns.items()})
        if held:
            yield flush()

    return df.mapInArrow(run, schema)
