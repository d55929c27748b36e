"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Documents are dealt out into blocks. A block explodes its texts into n-grams and adds up
equal ones first, so that a common n-gram leaves a block once. The n-gram count table is
partitioned by the leading bits of the n-grams' hashes: each range adds up what all blocks sent
and joins the totals back to the blocks' n-grams. Each block then sums up its documents.

What travels is one cell per block and range: the sorted hashes as differences and the
counts, both byte plane by byte plane and compressed. A block never has more than ``FAN`` cells (or one a part). More
blocks than that are first merged in groups of ``FAN``, range by range; the groups' tables are cut into
finer ranges and merged in turn, and the totals come back the same way. So every task merges about as
much as one block holds, however many blocks there are.

Within a task, n-grams are sorted, merged and counted one part of their hashes at a time, and the
results take the places of the hashes, so that a task needs little more than its n-grams do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, text_of
from millrace.llm.words import GOLDEN, scramble, word_hashes

ORDER = 2
BACKOFF = 0.4  # fixed factor per step back
BLOCK_BYTES = 20 << 20
BLOCK_GRAMS = 12 << 20  # of texts of very short words, or of a high order, a block has fewer bytes
FAN = 512  # a power of two
PART_BITS = 4  # leading bits of a hash that tell the parts apart that a task works through
SLICE_WORDS = 1 << 18  # words are worked through in slices of about so many; one document is never cut

SCORE_SCHEMA = "doc_id BIGINT, content BIGINT, n_tokens BIGINT, n_seen BIGINT, log_score DOUBLE"
CELL_SCHEMA = "block BIGINT, range BIGINT, grams BINARY, counts BINARY"
TOTAL_SCHEMA = "block BIGINT, range BIGINT, totals BINARY"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, byte plane by byte plane, compressed: small values take little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def sorted_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values in order (equal ones by place), the values in that order, and where runs of equal ones begin.

    One plain sort: the leading bits of a value with its place in the others. Values that only
    differ in the bits that made way are put right afterwards; there are few.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int32), values, np.zeros(0, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = (values & ~low) | np.arange(n, dtype=np.uint64)
    keys.sort()
    places = (keys & low).astype(np.int32)
    found = values[places]
    new = found[1:] != found[:-1]
    keys >>= bits
    alike = keys[1:] == keys[:-1]
    del keys
    clash = np.flatnonzero(new & alike)
    if len(clash):
        group = np.concatenate([[0], np.cumsum(~alike)])
        rows = np.flatnonzero(np.isin(group, group[clash]))
        places[rows] = places[rows][np.lexsort((places[rows], found[rows]))]
        found = values[places]
        new = found[1:] != found[:-1]
    return places, found, np.concatenate([[0], np.flatnonzero(new) + 1])


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(starts, append=n)


class Block:
    """The n-grams of a block's texts.

    ``grams`` has, order by order, a hash for every run of words within a text; ``ends`` the
    number of its last word, and ``words`` for each text the number of its first word, and of all.
    """

    def __init__(self, texts: pa.ChunkedArray, order: int):
        hashes, firsts, total = [], [], 0
        for chunk in texts.chunks:
            for _, _, data, offsets in byte_slices(chunk):
                found, words = word_hashes(data, offsets)
                firsts.append(words[:-1] + total)
                hashes.append(found)
                total += len(found)
        self.words = np.concatenate([*firsts, [total]]).astype(np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        del hashes
        n_words = np.diff(self.words)
        self.doc = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
        self.sizes = [int(np.maximum(n_words - k, 0).sum()) for k in range(order)]
        self.grams, self.ends = np.empty(sum(self.sizes), np.uint64), np.empty(sum(self.sizes), np.int32)
        done = np.cumsum([0, *self.sizes[:-1]])  # where the next n-grams of each order go
        for a, b in self.slices():
            first, end = self.words[a], self.words[b]
            nth = np.arange(first, end) - self.words[self.doc[first:end]]  # of a word in its text
            some = words[first:end]
            with np.errstate(over="ignore"):
                run = scramble(some + GOLDEN)
                for k in range(1, order + 1):
                    if k > 1:
                        # The run of k words that ends here: that of k - 1 words ending one word earlier, and this word.
                        longer = np.zeros_like(run)
                        longer[1:] = scramble(run[:-1] * GOLDEN + some[1:] + np.uint64(k))
                        run = longer
                    ends = np.flatnonzero(nth >= k - 1)
                    at = slice(done[k - 1], done[k - 1] + len(ends))
                    self.grams[at], self.ends[at] = run[ends], ends + first
                    done[k - 1] = at.stop

    def slices(self) -> Iterator[tuple[int, int]]:
        """First and end text of slices."""
        first = 0
        while first < len(self.words) - 1:
            end = int(np.searchsorted(self.words, self.words[first] + SLICE_WORDS, side="right")) - 1
            end = min(max(end, first + 1), len(self.words) - 1)
            yield first, end
            first = end


def _places(grams: np.ndarray) -> Iterator[np.ndarray]:
    """Part by part, the places of its n-grams. What is written to places given out earlier doesn't matter."""
    part = grams.astype("<u8", copy=False).view(np.uint8)[7::8] >> np.uint8(8 - PART_BITS)
    for k in range(1 << PART_BITS):
        yield np.flatnonzero(part == k)


def _edges(grams: np.ndarray, first: int, bits: int, part_bits: int) -> list[int]:
    """Where the parts of sorted n-grams begin, and the end; the n-grams are of one range, of ``bits`` bits."""
    heads = [((first << part_bits) + k) << (64 - bits - part_bits) for k in range(1, 1 << part_bits)]
    return [0, *np.searchsorted(grams, np.array(heads, np.uint64)).tolist(), len(grams)]


def _cut(grams: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """Sorted n-grams and counts as packed cells by their leading bits."""
    if not len(grams):
        return []
    ranges = grams >> np.uint64(64 - bits)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1])
    ends = np.append(starts[1:], len(grams))
    return [(int(ranges[a]), pack_sorted(grams[a:b]), pack(counts[a:b])) for a, b in zip(starts, ends, strict=True)]


def _cell_table(block: int, cells: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table(
        {
            "block": pa.array([block] * len(cells), pa.int64()),
            "range": pa.array([x[0] for x in cells], pa.int64()),
            "grams": pa.array([x[1] for x in cells], pa.binary()),
            "counts": pa.array([x[2] for x in cells], pa.binary()),
        }
    )


def _cells(order: int, bits: int):
    """A block in; a cell for each range of hashes out. There are as many ranges as parts at least."""

    def run(block: pa.Table) -> pa.Table:
        grams, cells = Block(block.column("text"), order).grams, []
        grams.sort()
        for a, b in pairwise(_edges(grams, 0, 0, PART_BITS)):
            found = grams[a:b]
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, b - a), bool), found[1:] != found[:-1]]))
            cells += _cut(found[starts], _lengths(starts, b - a), bits)
        return _cell_table(block.column("block")[0].as_py(), cells)

    return run


def _grams(cells: pa.Table) -> list[np.ndarray]:
    return [unpack_sorted(x.as_py()) for x in cells.column("grams")]


def _counts(cells: pa.Table) -> list[np.ndarray]:
    return [unpack(x.as_py()) for x in cells.column("counts")]


def _merged(cells: pa.Table, grams: list[np.ndarray], bits: int, part_bits: int = PART_BITS) -> Iterator[tuple]:
    """Part by part, of some cells of one range, of ``bits`` bits, and their n-grams: each cell's rows;
    places of the n-grams in order, distinct n-grams and where each begins.
    """
    first = cells.column("range")[0].as_py()
    edges = [_edges(x, first, bits, part_bits) for x in grams]
    for k in range(1 << part_bits):
        rows = [slice(x[k], x[k + 1]) for x in edges]
        places, found, starts = sorted_runs(_of(grams, rows))
        if len(places):
            yield rows, places, found[starts], starts


def _of(values: list[np.ndarray], rows: list[slice]) -> np.ndarray:
    return np.concatenate([x[at] for x, at in zip(values, rows, strict=True)])


def _give_back(grams: list[np.ndarray], rows: list[slice], places: np.ndarray, starts: np.ndarray, totals: np.ndarray) -> None:
    """The total of each n-gram takes its place."""
    all_ = np.empty(len(places), np.uint64)
    all_[places] = np.repeat(totals, _lengths(starts, len(places)))
    done = 0
    for x, at in zip(grams, rows, strict=True):
        x[at] = all_[done : done + at.stop - at.start]
        done += at.stop - at.start


def _total_table(cells: pa.Table, totals: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": cells.column("block"), "range": cells.column("range"), "totals": pa.array([pack(x) for x in totals], pa.binary())})


def _totals(bits: int):
    """All cells of a range in; for each the totals over all blocks out."""

    def run(cells: pa.Table) -> pa.Table:
        grams, counts = _grams(cells), _counts(cells)
        for rows, places, _, starts in _merged(cells, grams, bits):
            _give_back(grams, rows, places, starts, np.add.reduceat(_of(counts, rows)[places], starts))
        return _total_table(cells, grams)

    return run


def _merge(bits: int, finer: int):
    """The cells of a group of blocks in one range in; the group's cells for ranges of ``finer`` more bits out."""

    def run(cells: pa.Table) -> pa.Table:
        counts, out = _counts(cells), []
        for rows, places, distinct, starts in _merged(cells, _grams(cells), bits, min(PART_BITS, finer)):
            out += _cut(distinct, np.add.reduceat(_of(counts, rows)[places], starts), bits + finer)
        return _cell_table(cells.column("group")[0].as_py(), out)

    return run


def _spread(bits: int):
    """The cells of a group of blocks in one range, and the group's totals in it; each cell's totals out."""

    def run(cells: pa.Table, totals: pa.Table) -> pa.Table:
        grams, done = _grams(cells), 0
        found = np.concatenate([unpack(x.as_py()) for x in totals.sort_by("range").column("totals")])
        for rows, places, distinct, starts in _merged(cells, grams, bits):
            _give_back(grams, rows, places, starts, found[done : done + len(distinct)])
            done += len(distinct)
        return _total_table(cells, grams)

    return run


def corpus_totals(cells: DataFrame, blocks: int, bits: int, fan: int = FAN) -> DataFrame:
    """block, range, totals: for each cell the counts of its n-grams over all cells, in their order.

    ``bits`` leading bits of a hash are its range. ``fan`` is a power of two.
    """
    if blocks <= fan:
        return cells.groupBy("range").applyInArrow(_totals(bits), TOTAL_SCHEMA)
    finer = fan.bit_length() - 1
    grouped = cells.withColumn("group", F.floor(F.col("block") / fan).cast("long")).groupBy("group", "range")
    upper = corpus_totals(grouped.applyInArrow(_merge(bits, finer), CELL_SCHEMA), -(-blocks // fan), bits + finer, fan)
    upper = upper.withColumn("group", F.col("block")).withColumn("wide", F.shiftright("range", finer)).groupBy("group", "wide")
    return grouped.cogroup(upper).applyInArrow(_spread(bits), TOTAL_SCHEMA)


def _scored(order: int, n_tokens: int, leave_out: bool, bits: int):
    """A block's documents and the totals of its n-grams in; scores out."""

    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(rows.column("text"), order)
        grams, n_words = block.grams, np.diff(block.words)
        totals = totals.sort_by("range")
        part = totals.column("range").to_numpy() >> (bits - PART_BITS)
        for k, at in enumerate(_places(grams)):
            if not len(at):
                continue
            places, _, starts = sorted_runs(grams[at])
            at = at[places]
            corpus = np.concatenate([unpack(totals.column("totals")[x].as_py()) for x in np.flatnonzero(part == k)])
            counts = np.repeat(corpus.astype(np.int64), _lengths(starts, len(at)))
            if leave_out:
                # Equal n-grams are in the order of their places, so those of a document lie together.
                doc = block.doc[block.ends[at]]
                new = np.zeros(len(at), bool)
                new[starts] = True
                new[1:] |= doc[1:] != doc[:-1]
                times = _lengths(np.flatnonzero(new), len(at))
                counts -= np.repeat(times, times)
            grams[at] = counts
        by_place = grams.view(np.int64)
        outside = np.maximum(n_tokens - (n_words if leave_out else 0 * n_words), 1)
        n_seen, log_score = np.zeros(len(n_words), np.int64), np.zeros(len(n_words))
        for a, b in block.slices():
            first, end = block.words[a], block.words[b]
            doc = block.doc[first:end]
            # From the unigram up: where a longer n-gram has been seen, its ratio replaces the backed-off score.
            shorter = by_place[first:end]
            score = np.log(np.maximum(shorter, 0.5) / outside[doc])
            done, hits = block.sizes[0], np.zeros(len(doc), bool)
            for size in block.sizes[1:]:
                low, high = done + np.searchsorted(block.ends[done : done + size], np.array([first, end], np.int32))
                ends = block.ends[low:high] - first
                longer = np.zeros(len(doc))
                longer[ends] = by_place[low:high]
                hits = longer > 0
                ratio = np.log(np.maximum(longer[ends], 1) / np.maximum(shorter[ends - 1], 1))
                score[ends] = np.where(hits[ends], ratio, score[ends] + math.log(BACKOFF))
                shorter, done = longer, done + size
            n_seen[a:b] = np.bincount(doc - a, weights=hits, minlength=b - a)
            log_score[a:b] = np.bincount(doc - a, weights=score, minlength=b - a)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "content": rows.column("content"),
                "n_tokens": pa.array(n_words, pa.int64()),
                "n_seen": pa.array(n_seen, pa.int64()),
                "log_score": pa.array(log_score, pa.float64()),
            }
        )

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, leave_out: bool = True, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, content, n_tokens, n_seen, log_score, mean_log_score: one row per document.

    Tokens are words between ASCII white space, A-Z lower-cased. A token's score is the ratio
    of the counts of the longest n-gram (up to ``order``) that ends in it and has been seen,
    to that of its context, times 0.4 for each step back; a word seen nowhere else counts as
    half an occurrence. With ``leave_out`` a document's own n-grams don't count for it.
    ``n_seen`` says how many tokens needed no step back. Scores are natural logarithms, summed.
    A null or empty text has no tokens, the sum 0 and no mean. Every row is scored, repeated
    or not; a null doc_id is returned as it is.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    measure = rows.agg(F.sum(F.octet_length("text")), F.sum(n_words)).first()
    blocks = max(1, math.ceil((measure[0] or 0) / block_bytes), math.ceil((measure[1] or 0) * order / BLOCK_GRAMS))
    bits = max(PART_BITS, min(blocks - 1, fan - 1).bit_length())
    rows = rows.withColumn("content", F.xxhash64("text"))
    # Equal rows go to different blocks too.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "content", F.monotonically_increasing_id()), F.lit(blocks)))
    tasks = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "block")
    cells = rows.groupBy("block").applyInArrow(_cells(order, bits), CELL_SCHEMA)
    totals = corpus_totals(cells, blocks, bits, fan)
    scored = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scored(order, measure[1] or 0, leave_out, bits), SCORE_SCHEMA)
    return scored.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
