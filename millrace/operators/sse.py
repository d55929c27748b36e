"""Frames to event payloads, with native expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values of the `data` lines of a text: what follows the colon and at most one blank.
_DATA_LINES = """
transform(
  filter(split({text}, '{line_end}'), line -> line = 'data' OR startswith(line, 'data:')),
  line -> CASE WHEN startswith(line, 'data: ') THEN substr(line, 7) ELSE substr(line, 6) END)"""
# Frames with carriage returns may hold more line ends, and blank lines that the file
# scan does not split at; the others, nearly all, are split at line feeds only.
_EVENTS = rf"""
CASE WHEN contains(value, '\r')
  THEN transform(split(value, '\r\n\r\n|\r\r'), text -> {_DATA_LINES.format(text="text", line_end=r"\r\n|\r|\n")})
  ELSE array({_DATA_LINES.format(text="value", line_end=r"\n")}) END"""
_PAYLOADS = rf"transform({_EVENTS}, found -> CASE WHEN size(found) > 0 THEN array_join(found, '\n') END)"


def split_valid_utf8(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that are UTF-8, and those that are not."""
    valid = F.is_valid_utf8("value")
    return frames.where(valid), frames.where(~valid)


def parse_sse(frames: DataFrame) -> DataFrame:
    """One row per event with its payload in ``data``; other columns are kept.

    Comments and fields other than ``data`` are dropped, several ``data`` lines are
    joined by line feeds, and events without a ``data`` line yield no row.
    """
    # The generator makes `data` a column of its own: later filters use it without
    # extracting it again.
    return frames.select("*", F.expr(f"explode({_PAYLOADS}) AS data")).drop("value").where(F.col("data").isNotNull())
