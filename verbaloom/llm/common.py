"""Helpers shared by the llm operators: shipping code, shared storage, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package's code, once for each application.

    Workers import the package by name, so that their bounded caches outlive a task.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="verbaloom-")) / "verbaloom_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares; what lies there goes when the driver ends."""
    return scratch(spark, name)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, key: str, buckets: int, compression: str = "none") -> DataFrame:
    """As ``stored``, in buckets by ``key``: later joins on it do not move these rows. The catalog keeps no entry of it."""
    spark = df.sparkSession
    table = f"verbaloom_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", compression).option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    # an external table: its files stay, and the plan above has found them
    spark.sql(f"DROP TABLE {table}")
    return out


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound the rows and the bytes that JVM and Python hold at once, as rows can be very long texts; a row is never cut.

    Plans are made when their results are asked for, so the session keeps the setting; it changes no result.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        spark.conf.set(key, value)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_groups(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches whose texts have about ``limit`` bytes at most (a longer text comes alone)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        at = 0
        while at < len(size):
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            part = batch.slice(at, end - at)
            yield part, col.slice(at, end - at).to_pylist()
            at = end


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def fold(col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % folds, F.lit(0))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the undirected links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
