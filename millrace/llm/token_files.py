"""Token files in Simple-8b.

A file row is one document: its ids packed into 64-bit words, little-endian. The upper four
bits of a word are a selector, which says how many ids of how many bits the other sixty hold.
Ids that need more than sixty bits are escaped: a word with selector 15 and then the id as a
word of its own. Ids are cut into blocks of a fixed number; a word never holds ids of two
blocks, and the row lists the word at which each block begins, so that blocks can be decoded
alone and all words of one selector at once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, text_of
from millrace.session import scratch_dir

# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK_IDS = 1024
# Each length of a stretch as a sum of two shorter ones.
STRETCHES = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}

FILE_SCHEMA = "doc_id BIGINT, part INT, row BIGINT, n_tokens BIGINT, words BINARY, block_words ARRAY<INT>"

DIGEST_SCHEMA = "doc_id BIGINT, part INT, row BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value needs, one at least; over 60 for those that don't fit a word."""
    small = np.searchsorted(1 << np.arange(1, 60, dtype=np.uint64), ids, side="right") + 1
    return np.where(ids >> np.uint64(60) > 0, 64, small)


def encode(ids: np.ndarray, offsets: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack documents, which lie one after another in ``ids`` and end at the offsets after the first.

    Returns the words, the first word of each block, the first block of each document (and
    their number), and the first word of each document (and their number).
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    sizes = np.diff(offsets)
    blocks_of = -(-sizes // block_ids)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    within = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks_of)
    block_start = np.repeat(offsets[:-1], blocks_of) + within * block_ids
    block_end = np.minimum(block_start + block_ids, np.repeat(offsets[1:], blocks_of))
    room = np.repeat(block_end, block_end - block_start) - np.arange(n)
    # Per id the first selector with enough bits; one past the last if none has.
    least = np.searchsorted(BITS, _bit_lengths(ids)).astype(np.uint8)
    # The same for the ids of a stretch of each length; longer stretches from shorter ones.
    needs = {1: least}
    for count, (one, other) in STRETCHES.items():
        longer, overlap = needs[one].copy(), max(n - one, 0)
        np.maximum(longer[:overlap], needs[other][one : one + overlap], out=longer[:overlap])
        needs[count] = longer
    # The selector that takes most ids of those that follow, from each place on: the last one set.
    selector = np.full(n, len(COUNTS) - 1, np.uint8)
    room = np.minimum(room, 60).astype(np.uint8)
    for k in range(len(COUNTS) - 1, -1, -1):
        count = int(COUNTS[k])
        selector[(needs[count] <= k) & (room >= count)] = k
    escaped = least == len(COUNTS)
    step = COUNTS[selector]
    # Words begin where the greedy choice from each block's first id leads.
    word_at = []
    jump = step.tolist()
    for at, end in zip(block_start.tolist(), block_end.tolist(), strict=True):
        while at < end:
            word_at.append(at)
            at += jump[at]
    word_at = np.array(word_at, np.int64)
    width = 1 + escaped[word_at]
    place = np.concatenate([[0], np.cumsum(width)])
    words = np.zeros(place[-1], np.uint64)
    chosen_selector = selector[word_at]
    for k, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        mine = np.flatnonzero((chosen_selector == k) & (width == 1))
        values = ids[word_at[mine][:, None] + np.arange(count)]
        packed = np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1) if len(mine) else []
        words[place[mine]] = np.uint64(k << 60) | np.asarray(packed, np.uint64)
    big = np.flatnonzero(width == 2)
    words[place[big]], words[place[big] + 1] = np.uint64(ESCAPE << 60), ids[word_at[big]]
    block_word = place[np.searchsorted(word_at, block_start)]
    doc_word = place[np.searchsorted(word_at, offsets)]
    return words, block_word, first_block, doc_word


def decode_counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words of whole blocks, and how many of them end up to each word."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE):  # in order: what follows an escape is an id
        if not raw[at]:
            raw[at + 1] = True
    counts = np.append(COUNTS, [0, 0])[selector]
    counts[raw] = 1
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    for k, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        mine = np.flatnonzero((selector == k) & ~raw)
        if len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (words[mine][:, None] >> shifts) & np.uint64((1 << int(bits)) - 1)
            ids[begins[mine][:, None] + np.arange(count)] = values
    ids[begins[raw]] = words[raw]
    return ids, ends


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of the words of whole blocks."""
    return decode_counted(words)[0]


def _documents(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of documents, some hundreds together, and the offsets of the documents in them."""
    for first in range(0, len(column), 512):
        packed = [x.as_buffer() for x in column.slice(first, 512)]
        words = np.frombuffer(b"".join(packed), "<u8")
        ids, ends = decode_counted(words)
        ends = np.concatenate([[0], ends])
        yield ids, ends[np.cumsum([0] + [len(x) // 8 for x in packed])]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Letters that are letters in every version of Unicode, before a full stop or comma that ends a word.
_CLOSED_WORD = "([A-Za-z\u00df-\u00f6\u00f8-\u00ff])([.,]) "
# Words of such letters, digits and ASCII signs only, and how this vocabulary splits them into pieces.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next free one."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = {chr(b): letter for b, letter in _byte_letters().items()}


class WordIds:
    """Ids of texts by the word-level vocabulary, which never joins what a space or a line feed parts.

    It drops white space and lower-cases, so equal words have equal ids: each distinct word of
    a slice is encoded once, and the first words met are remembered, up to a bound on their
    number. Plain words go to the vocabulary's merges piece by piece; any other goes through
    the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        self.tokenizer, self.remembered = _tokenizer(path), remembered
        self.merges, self.known, self.pieces = self.tokenizer.model.tokenize, {}, {}
        self.bytes = str.maketrans(_BYTES)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            ids = struct.pack(f"<{len(found)}H", *[x.id for x in found]) if (found := self.merges(text)) else b""
            if len(self.pieces) < self.remembered and len(piece) <= 40:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self._piece, _PIECES.findall(word.lower())))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def _of_words(self, words: list[str]) -> list[bytes]:
        found = []
        for word in words:
            ids = self.known.get(word)
            if ids is None:
                ids = self._word(word)
                if len(self.known) < self.remembered and len(word) <= 40:
                    self.known[word] = ids
            found.append(ids)
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and the offsets of the texts."""
        texts = pc.replace_substring(texts, "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _CLOSED_WORD, "\\1 \\2 ")
        split = pc.split_pattern(texts, " ")
        per_text = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        of_word = self._of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 2
        flat = np.frombuffer(b"".join(of_word), np.uint16)
        begins = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        text = np.repeat(np.arange(len(texts)), per_text)
        n = sizes[word]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64) + 1)])
        source = np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.full(int(offsets[-1]), end_id, np.uint64)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = flat[source]
        return out, offsets


def _encoded(tokenizer: str, end_id: int):
    """Texts in order in; rows of a file out, with the number of the task as that of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids, number, done = WordIds(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, _, _ in byte_slices(batch.column("text")):
                part = batch.slice(first, end - first)
                ids, offsets = word_ids(part.column("text"), end_id)
                words, block_word, first_block, doc_word = encode(ids, offsets)
                packed = words.astype("<u8").tobytes()
                rows = []
                for k in range(part.num_rows):
                    blocks = block_word[first_block[k] : first_block[k + 1]] - doc_word[k]
                    rows.append((packed[8 * doc_word[k] : 8 * doc_word[k + 1]], blocks.astype(np.int32)))
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(np.full(part.num_rows, number, np.int32)),
                        pa.array(np.arange(done, done + part.num_rows)),
                        pa.array(np.diff(offsets)),
                        pa.array([x for x, _ in rows], pa.binary()),
                        pa.array([x for _, x in rows], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "part", "row", "n_tokens", "words", "block_words"],
                )
                done += part.num_rows

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, order: Sequence[Column] | None = None) -> None:
    """Encode whole texts and write them in order; ``part`` numbers the files and ``row`` the rows of one.

    The order is ascending by doc_id, or by some columns or expressions of ``docs``. A null text has
    no ids but the end id; a null doc_id comes first; rows that repeat a doc_id follow each
    other, in the order of a hash of the text. An empty table gives files without rows.
    """
    keys = [docs["doc_id"].cast("long"), F.xxhash64(text_of(docs))] if order is None else order
    names = [f"key_{k}" for k in range(len(keys))]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text_of(docs).alias("text"),
        *[key.alias(name) for key, name in zip(keys, names, strict=True)],
        F.monotonically_increasing_id().alias("tie"),  # equal rows may go to different tasks
    )
    in_order = rows.repartitionByRange(*names, "tie").sortWithinPartitions(*names, "tie").select("doc_id", "text")
    in_order.mapInArrow(_encoded(tokenizer, end_id), FILE_SCHEMA).write.parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sums = [], []
        for ids, offsets in _documents(batch.column("words")):
            data = ids.astype("<u4")
            sizes += np.diff(offsets).tolist()
            sums += [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = [*(batch.column(x) for x in ("doc_id", "part", "row")), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
        yield pa.record_batch(columns, names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all from the decoded files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = files.select("doc_id", "part", "row", "words").mapInArrow(_digests, DIGEST_SCHEMA)
    # Parts are files, so their number, and the rows of one, are bounded by how the files were written.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    start = (F.col("before") + F.col("inside")).alias("start")
    return rows.join(parts, "part").select("doc_id", start, "n_tokens", "ids_crc32")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the ids of each document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [decode(np.frombuffer(words.as_buffer(), "<u8")).astype(np.int64) for words in batch.column("words")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "words")
    return rows.mapInArrow(run, "doc_id BIGINT, ids ARRAY<BIGINT>")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int, order: Sequence[Column] | None = None) -> DataFrame:
    """Write the files to the shared folder, in the order that ``write_token_files`` describes, and read them back."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id, order)
    return read_digests(spark, path)
