"""Helpers that the corpus operators share.

Every operator selects the columns it works on first, so that other columns of the
input, whatever their names, never meet the operator's own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace
from millrace.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Text is worked through in slices of about so many bytes; one document is never cut.
SLICE_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent along with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(millrace.__file__).parent.parent))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there."""
    path = path or scratch_dir(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_of(frame: DataFrame) -> Column:
    """The text column, a null being an empty text."""
    return F.coalesce(frame["text"].cast("string"), F.lit(""))


def bounded_broadcast(frame: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Ask for a broadcast only if the counted rows fit the limit; else Spark joins by shuffle."""
    return F.broadcast(frame) if rows * row_bytes <= limit else frame


def byte_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for slices of a column of strings."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table made by an expression: no Python on the executors."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    fields = ", ".join(f"{part.split()[0]}: {part.split()[1]}" for part in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))
