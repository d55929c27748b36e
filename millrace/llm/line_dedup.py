"""Line deduplication.

Hashes of lines are dealt out by range and sorted by document and position; each range is
streamed once and gives, per line, its first occurrence and its number of documents. The
few lines that lie across ranges are added up. The result is a compressed bitmap of the
kept lines per document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_of

# White space that is stripped from both ends of a line before it is compared.
STRIPPED = b" \t\n\x0b\x0c\r"

LINE_SCHEMA = "doc_id BIGINT, content BIGINT, pos INT, h1 BIGINT, h2 BIGINT"
RUN_SCHEMA = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, doc_id BIGINT, content BIGINT, pos INT"
SIGNED = 1 << 63


def _lines(min_chars: int):
    """A document in; its lines out, as 128-bit hashes of their keys. Keys that are too short have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows, pos, h1, h2 = [], [], [], []
                for row, text in enumerate(part.column("text").cast(pa.binary())):
                    for at, line in enumerate(text.as_py().split(b"\n")):
                        key = line.strip(STRIPPED).lower()  # on bytes, A-Z only
                        rows.append(row)
                        pos.append(at)
                        if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                            digest = xxhash.xxh3_128_intdigest(key)
                            h1.append((digest >> 64) - SIGNED)
                            h2.append((digest & (2 * SIGNED - 1)) - SIGNED)
                        else:
                            h1.append(None)
                            h2.append(None)
                rows = pa.array(rows, pa.int32())
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(rows),
                        part.column("content").take(rows),
                        pa.array(pos, pa.int32()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                    ],
                    names=["doc_id", "content", "pos", "h1", "h2"],
                )

    return run


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """For each row but the first, whether it differs from the one before in any of the columns."""
    out = np.zeros(batch.num_rows - 1, bool)
    for name in names:
        column = batch.column(name)
        values, nulls = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        out |= (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines in; per run of one hash its first line and number of documents out.

    A run that goes on in the next batch is held back as one row of counts.
    """
    names = ["h1", "h2", "n_docs", "doc_id", "content", "pos"]
    held, last = None, None  # the open run; the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])  # its first row has been counted
        new_line = np.concatenate([[last is None], _changes(batch, ["h1", "h2"])])
        new_doc = np.concatenate([[last is None], _changes(batch, ["h1", "h2", "doc_id", "content"])])
        starts = np.flatnonzero(new_line)
        counts = np.add.reduceat(new_doc.astype(np.int64), np.concatenate([[0], starts]) if not new_line[0] else starts)
        if not new_line[0]:
            held["n_docs"] += int(counts[0])
            counts = counts[1:]
        if len(starts):
            rows = batch.take(pa.array(starts))
            rows = pa.record_batch(
                [rows.column("h1"), rows.column("h2"), pa.array(counts), *(rows.column(name) for name in names[3:])], names=names
            )
            if held:
                yield pa.RecordBatch.from_pylist([held], schema=rows.schema)
            held = rows.slice(len(starts) - 1).to_pylist()[0]
            yield rows.slice(0, len(starts) - 1)
        last = batch.slice(batch.num_rows - 1)
    if held:
        yield pa.RecordBatch.from_pylist([held], schema=_run_schema())


def _run_schema() -> pa.Schema:
    return pa.schema([(n, pa.int32() if n == "pos" else pa.int64()) for n in ("h1", "h2", "n_docs", "doc_id", "content", "pos")])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[dropped] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        dropped = pa.array([len(x) for x in batch.column("dropped").to_pylist()], pa.int64())
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("content"), batch.column("n_lines"), dropped, pa.array(maps, pa.binary())],
            names=["doc_id", "content", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """doc_id, content, n_lines, n_dropped, keep_bitmap: one row per document.

    A line is repeated if its key (ASCII white space stripped, A-Z lower-cased) has at least
    ``min_chars`` code points and occurs in at least ``min_docs`` documents. Repeated lines
    are dropped; with ``keep_first`` the first by doc_id and position stays. The bitmap has a
    bit per line, packed and compressed by zlib. ``content`` is a hash of the text: rows with
    the same doc_id and text are one document. A null or empty text is one empty line. A null
    doc_id is an id of its own and sorts first.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("content"), "text")
    lines = stored(rows.mapInArrow(_lines(min_chars), LINE_SCHEMA), "lines")
    order = ["h1", "h2", "doc_id", "content"]
    in_order = lines.where("h1 IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    runs = in_order.mapInArrow(_runs, RUN_SCHEMA)
    repeated = (
        runs.groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("doc_id", "content", "pos")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )
    repeated = stored(repeated, "repeated-lines")  # so that the join deals out both sides itself and can split a common line
    drop = F.col("first").isNotNull()
    if keep_first:
        drop &= ~F.struct("doc_id", "content", "pos").eqNullSafe(F.col("first"))
    marked = lines.join(repeated, ["h1", "h2"], "left")
    per_doc = marked.groupBy("doc_id", "content").agg(
        (F.max("pos") + 1).cast("long").alias("n_lines"), F.collect_set(F.when(drop, F.col("pos"))).alias("dropped")
    )
    return per_doc.mapInArrow(_bitmaps, "doc_id BIGINT, content BIGINT, n_lines BIGINT, n_dropped BIGINT, keep_bitmap BINARY")


def _kept(text: bytes, n_lines: int, bitmap: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)
    return b"\n".join(line for line, bit in zip(text.split(b"\n"), bits, strict=True) if bit)


def _texts(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column("text").cast(pa.binary()), batch.column("n_lines"), batch.column("keep_bitmap")]
            for text, n, bitmap in zip(*columns, strict=True):
                text = _kept(text.as_py(), n.as_py(), bitmap.as_py())
                out.append(hashlib.sha256(text).hexdigest() if digest else text)
            result = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.record_batch(
                [batch.column(n) for n in ("doc_id", "n_lines", "n_dropped")] + [result],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text, or its SHA-256 in hex with ``digest``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), "text")
    on = F.col("id").eqNullSafe(bitmaps["doc_id"]) & (F.col("hash") == bitmaps["content"])
    both = rows.join(bitmaps, on).select("doc_id", "text", "n_lines", "n_dropped", "keep_bitmap")
    return both.mapInArrow(_texts(digest), "doc_id BIGINT, n_lines BIGINT, n_dropped BIGINT, text STRING")
