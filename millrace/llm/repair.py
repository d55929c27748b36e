"""Repair of conversations whose structure is damaged, at least cost.

A path of edits is one whole number: its high digits carry the cost, its low digits the letters of
the audit, one digit of fixed width for each place from the left and zeros after the last. The
least number is the cheapest path, and among those the least audit. A conversation is a line of
states, so ordinary minima over such numbers decide everything.

Of a row only one symbol matters to that: whether it must go, else its role's initial and whether it
is truncated. Conversations are cut into blocks of consecutive rows; each block gives the least number
for every pair of states before and after it, and these tables are joined to the conversation's.
Numbers of equal cost over the same rows are never beginnings of each other (only inserted rows
could make the difference, and they cost), so the least of a block stays the least of the whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.places import numbered, starts_of_runs

# Costs of the edits, and their letters in ASCII order as digits from 1.
KEEP, REROLE, DELETE, INSERT, KEPT_TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "-DIKR"
D, I, K, R = 1, 2, 3, 4
BITS = 3
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

# States: nothing yet, after system, after user, after assistant. Which role comes next, and to where.
NEXT = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))
ENDS = (0, 3)
BLOCK = 256  # rows
SPACE = " \t\n\x0b\x0c\r"

Paths = list[tuple[int, int] | None]  # for each state the least number and its number of letters


def _widths(rows: int) -> int:
    """Letters that fit into the numbers of a block: its rows, and two inserted before each and at the end."""
    return 3 * rows + 2


def _insert(paths: Paths, width: int) -> Paths:
    """Paths after any inserted rows; after two of them a state that could have been had for less comes again."""
    reached = paths
    for _ in range(2):
        further = list(reached)
        for state, path in enumerate(reached):
            if path:
                for role, then in NEXT[state]:
                    if role != "s":
                        further[then] = _least(further[then], _step(path, INSERT, I, width))
        reached = further
    return reached


def _step(path: tuple[int, int], cost: int, letter: int, width: int) -> tuple[int, int]:
    value, n = path
    return value + (cost << BITS * width) + (letter << BITS * (width - 1 - n)), n + 1


def _least(a: tuple[int, int] | None, b: tuple[int, int] | None) -> tuple[int, int] | None:
    return b if a is None else a if b is None else min(a, b)


def block_paths(symbols: str, start: int) -> Paths:
    """Least paths over a block's rows from one state. Symbols: ``-`` must go, else s, u, a or o; a capital is truncated."""
    width = _widths(len(symbols))
    paths: Paths = [None] * 4
    paths[start] = (0, 0)
    for symbol in symbols:
        after: Paths = [None] * 4
        for state, path in enumerate(_insert(paths, width)):
            if not path:
                continue
            after[state] = _least(after[state], _step(path, DELETE, D, width))
            if symbol == "-":
                continue
            extra = KEPT_TRUNCATED if symbol.isupper() else 0
            for role, then in NEXT[state]:
                if role == symbol.lower():
                    after[then] = _least(after[then], _step(path, KEEP + extra, K, width))
                if role != "s":
                    after[then] = _least(after[then], _step(path, REROLE + extra, R, width))
        paths = after
    return _insert(paths, width)


def _split(path: tuple[int, int], width: int) -> tuple[int, int]:
    """Cost, and the letters as a number of as many digits as there are."""
    value, n = path
    return value >> BITS * width, (value & ((1 << BITS * width) - 1)) >> BITS * (width - n)


def join_paths(first: Paths, width: int, table: list[Paths], more: int) -> tuple[Paths, int]:
    """Least paths over some rows and a block behind them, and the width of their numbers."""
    out: Paths = [None] * 4
    for state, path in enumerate(first):
        if not path:
            continue
        cost, letters = _split(path, width)
        for then, further in enumerate(table[state]):
            if further:
                added, rest = _split(further, more)
                n, total = path[1] + further[1], width + more
                value = ((cost + added) << BITS * total) + (((letters << BITS * further[1]) + rest) << BITS * (total - n))
                out[then] = _least(out[then], (value, n))
    return out, width + more


def _solved(paths: Paths, width: int) -> tuple[int, str]:
    best = None
    for state in ENDS:
        best = _least(best, paths[state])
    cost, letters = _split(best, width)
    digits = format(letters, "o") if best[1] else ""  # a digit is three bits
    return cost, digits.translate(str.maketrans("1234", LETTERS[1:]))


def solve(symbols: str) -> tuple[int, str]:
    """Cost and audit of a conversation's symbols."""
    return _solved(block_paths(symbols, 0), _widths(len(symbols)))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, symbols) in; the block's paths out, from the empty state only if it is the first."""
    for batch in batches:
        packed = []
        for block, symbols in zip(batch.column("block").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
            packed.append(pickle.dumps([block_paths(symbols, start) if block or not start else [None] * 4 for start in range(4)]))
        names = ["conv", "block", "symbols", "paths"]
        yield pa.record_batch([*(batch.column(x) for x in names[:3]), pa.array(packed, pa.binary())], names=names)


def _edits(symbols: Iterator[str], audit: str) -> str:
    """What to do with each row, and where to insert: k keeps, d deletes, u and a set the role, U and A insert."""
    out, state = [], 0
    for letter in audit:
        role, then = NEXT[state][-1]
        symbol = "" if letter == "I" else next(symbols)
        if letter == "K" and symbol.lower() == "s":
            then = 1
        out.append({"D": "d", "K": "k", "R": role, "I": role.upper()}[letter])
        state = state if letter == "D" else then
    return "".join(out)


def _solve_conversations(rows: pa.Table) -> pa.Table:
    """All blocks of a conversation in; its cost, audit and edits out."""
    rows = rows.sort_by("block")
    paths: Paths = [(0, 0), None, None, None]
    width = 0
    for symbols, packed in zip(rows.column("symbols").to_pylist(), rows.column("paths").to_pylist(), strict=True):
        paths, width = join_paths(paths, width, pickle.loads(packed), _widths(len(symbols)))
    cost, audit = _solved(paths, width)
    edits = _edits((x for block in rows.column("symbols").to_pylist() for x in block), audit)
    return pa.table({"conv": rows.column("conv").slice(0, 1), "cost": [cost], "audit": [audit], "edits": [edits]})


def _solve_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block."""
    for batch in batches:
        solved = [(x, *solve(x)) for x in batch.column("symbols").to_pylist()]
        columns = [pa.array([x[1] for x in solved], pa.int64()), pa.array([x[2] for x in solved], pa.string())]
        columns.append(pa.array([_edits(iter(x[0]), x[2]) for x in solved], pa.string()))
        yield pa.record_batch([batch.column("conv"), *columns], names=["conv", "cost", "audit", "edits"])


class _Repaired:
    """The repaired conversation as a digest, fed row by row."""

    def __init__(self, edits: str):
        self.edits, self.at, self.digest, self.any = edits, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] in "UA":
            self._put("user" if self.edits[self.at] == "U" else "assistant", "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "d":
            self._put({"k": role, "u": "user", "a": "assistant"}[edit], text)

    def end(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, pos, role, text, edits) in order in, the row at place 0 with the edits; per conversation its digest out."""
    conv, open_ = None, None
    for batch in batches:
        done = []
        for c, pos, role, text, edits in zip(*(batch.column(x).to_pylist() for x in ("conv", "pos", "role", "text", "edits")), strict=True):
            if pos == 0:
                if open_:
                    done.append((conv, open_.end()))
                conv, open_ = c, _Repaired(edits)
            else:
                open_.row(role, text)
        yield pa.record_batch([pa.array([x[k] for x in done], pa.string()) for k in range(2)], names=["conv", "repaired_sha256"])
    if open_:
        yield pa.record_batch([pa.array([conv]), pa.array([open_.end()])], names=["conv", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after damage by a hash of (conv_id, turn); a null is one space. ``conv`` is conv_id as text.

    Of twenty hash values one drops the row, one empties its text, one takes out full stops,
    exclamation and question marks, one repeats the row and one sets its role to user.
    """
    rows = conversations.select(
        F.coalesce(conversations["conv_id"].cast("string"), F.lit(" ")).alias("conv"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit(" ")).alias("text"),
    )
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.withColumn("kind", kind).where("kind <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    The conversations are damaged first (``damaged``); their rows then go by turn, nulls first, rows
    of one turn by a hash of role and text. All values that are null count as one space: so
    there may be a conversation without an id, whose conv_id is null. A role without a letter,
    or with another than s, u or a first, can't be kept as it is. Texts are compared whole, by
    128 bits of hash. A conversation of which no row is left gives zeros and the digest of an
    empty text. No rows, no result.
    """
    rows = damaged(conversations)
    bare = F.btrim("text", F.lit(SPACE))
    rows = rows.select(
        "*",
        F.xxhash64("role", "text").alias("d1"),
        F.xxhash64("text", F.lit("|"), "role").alias("d2"),
        (bare == "").alias("is_blank"),
        (~F.substr(bare, F.lit(-1)).isin(".", "!", "?")).alias("is_cut"),
        F.substr("role", F.lit(1), F.lit(1)).alias("initial"),
    )
    placed = numbered(rows, "conv", ["turn", "d1", "d2"], "damaged")
    narrow = placed.drop("role", "text", "part")
    first = stored(narrow.groupBy("conv", "d1", "d2").agg(F.min("pos").alias("first")), "first-seen")
    narrow = narrow.join(first, ["conv", "d1", "d2"]).withColumn("seen", (F.col("pos") > F.col("first")) & ~F.col("is_blank"))
    goes = F.col("is_blank") | F.col("seen")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    symbol = F.when(goes, F.lit("-")).when(F.col("is_cut"), F.upper(known)).otherwise(known)
    number = F.floor((F.col("pos") - 1) / block).cast("long")
    cells = F.sort_array(F.collect_list(F.struct("pos", symbol.alias("symbol"), known.alias("role"))))
    blocks = narrow.groupBy("conv", number.alias("block")).agg(
        F.count_if("is_blank").alias("blank"), F.count_if("seen").alias("duplicate"), F.count_if(~goes & F.col("is_cut")).alias("truncated"), cells.alias("cells")
    )
    blocks = blocks.select(
        "conv", "block", "blank", "duplicate", "truncated",
        F.array_join(F.col("cells.symbol"), "").alias("symbols"), F.array_join(F.col("cells.role"), "").alias("roles"),
    )
    blocks = stored(blocks, "blocks")

    # Pairs of neighbours, with the last row of the block before.
    last = blocks.select("conv", (F.col("block") + 1).alias("block"), F.expr("right(roles, 1)").alias("before"))
    roles = blocks.join(last, ["conv", "block"], "left").withColumn("roles", F.concat(F.coalesce("before", F.lit("")), "roles"))
    pairs = F.expr("filter(sequence(1, greatest(length(roles) - 1, 1)), i -> length(roles) > 1 AND NOT substr(roles, i, 2) IN ('su', 'ua', 'au'))")
    illegal = roles.groupBy("conv").agg(
        F.sum(F.size(pairs)).alias("illegal"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.count("*").alias("n_blocks"),
    )
    turns = narrow.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    turns = turns.agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("n_turns"))
    gaps = F.expr("try_cast(cast(high AS decimal(38, 0)) - low + 1 - n_turns AS bigint)")
    counts = stored(illegal.join(turns, "conv").withColumn("gaps", F.when(F.col("high").isNull(), F.lit(0)).otherwise(gaps)), "counts")

    schema = "conv STRING, cost BIGINT, audit STRING, edits STRING"
    sized = blocks.select("conv", "block", "symbols")
    long_ = sized.join(counts.where("n_blocks > 1").select("conv"), "conv", "left_semi")
    short = sized.join(counts.where("n_blocks = 1").select("conv"), "conv", "left_semi").mapInArrow(_solve_single, schema)
    tables = long_.repartition("conv", "block").mapInArrow(_tables, "conv STRING, block BIGINT, symbols STRING, paths BINARY")
    solved = short.unionByName(tables.groupBy("conv").applyInArrow(_solve_conversations, schema))
    solved = stored(solved, "audits")

    no_text = F.lit(None).cast("string")
    stream = placed.select("conv", "pos", "role", "text", no_text.alias("edits"))
    stream = stream.unionByName(solved.select("conv", F.lit(0).cast("long").alias("pos"), no_text.alias("role"), no_text.alias("text"), "edits"))
    digests = stream.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_digests, "conv STRING, repaired_sha256 STRING")

    everyone = conversations.select(F.coalesce(conversations["conv_id"].cast("string"), F.lit(" ")).alias("conv")).distinct()
    whole = everyone.join(counts, "conv", "left").join(solved, "conv", "left").join(digests, "conv", "left")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv_id = F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id")
    return whole.select(conv_id, *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
