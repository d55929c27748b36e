"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketches: in round i every shingle is hashed to one of the bins, and a bin keeps the least
hash of the first round that reaches it. After as many rounds as there are bins, round
``bins + j`` puts all shingles into bin j, so that every coordinate is filled for certain;
two sketches agree in a coordinate with a probability equal to the similarity.

Documents with equal shingle sets are one class from the start, and a class is one row from
then on. Candidates share a band. Groups of candidates are never turned into all pairs:

* In each of a few rounds a group has a few leaders, and every member that isn't in the
  component of its leaders yet is compared with some of them. Copies of one text come
  together here.
* What remains are groups of several components, most of them held together by a passage
  that many documents share. Two sets that are similar enough must share one of their
  rarest shingles, a fifth of each set, in whatever common order of rarity; members that
  do, and are in different components still, are compared.

So every pair of members of a group that are similar enough ends in one component: no link
between candidates is lost, and what is compared follows the true copies, not the squares of
the groups.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, stored, text_of
from millrace.llm.exact_dedup import drop_repeated_rows
from millrace.llm.words import GOLDEN, scramble, shingles, word_hashes

# A pair of similarity 0.8 shares none of the bands with probability (1 - 0.8 ** 5) ** 32, 3 in a million.
BANDS = 32
BAND_ROWS = 5
# Rounds of leaders, and leaders per member in all but the first. Any numbers give the same result;
# the last step takes what they leave.
ROUNDS = 4
LEADERS = 4
# Counters for the order of rarity. They are fetched by the driver, 4 bytes each; collisions only blur the order.
COUNTERS = 1 << 20
COUNTER_PARTS = 64
# Members that one copy of a leader's text serves.
MEMBERS_PER_TASK = 256
EMPTY_BIN = np.uint64(0xFFFFFFFFFFFFFFFF)

BASE_SCHEMA = "doc_id BIGINT, content BIGINT, n_shingles BIGINT, set_id BINARY, bands ARRAY<BIGINT>"


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of distinct 64-bit hashes; there must be one at least."""
    out = np.full(bins, EMPTY_BIN, np.uint64)
    at_once = max(1, 1024 // len(items))
    with np.errstate(over="ignore"):
        for first in range(0, bins, at_once):
            rounds = np.arange(first, min(first + at_once, bins), dtype=np.uint64)
            hashed = scramble(items[None, :] ^ scramble((rounds + np.uint64(1)) * GOLDEN)[:, None])
            into = ((hashed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            values = (rounds[:, None] << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, into.ravel().astype(np.int64), values.ravel())
            if (out != EMPTY_BIN).all():
                return out
        for bin_no in np.flatnonzero(out == EMPTY_BIN):
            hashed = scramble(items ^ scramble(np.uint64(bins + bin_no + 1) * GOLDEN))
            out[bin_no] = (np.uint64(bins + bin_no) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF)).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band of the sketch, different bands having different keys."""
    rows = coordinates.reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            keys = scramble(keys * GOLDEN + rows[:, k])
    return keys.view(np.int64)


def _sketches(size: int, bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column("text")):
                hashes, words = word_hashes(data, offsets)
                counts, sets, keys = [], [], []
                for row in range(end - first):
                    items = np.unique(shingles(hashes[words[row] : words[row + 1]], size))
                    counts.append(len(items))
                    sets.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    keys.append(band_keys(sketch(items, bands * band_rows), bands) if len(items) else None)
                part = batch.slice(first, end - first)
                columns = [part.column("doc_id"), part.column("content"), pa.array(counts, pa.int64())]
                columns += [pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["doc_id", "content", "n_shingles", "set_id", "bands"])

    return run


def _linked(size: int, percent: int):
    """Leaders and members in order of leader and part, leaders first; linked pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column("text")):
                hashes, words = word_hashes(data, offsets)
                part = batch.slice(first, end - first)
                links = []
                rows = zip(*(part.column(n).to_pylist() for n in ("leader", "part", "member", "id")), strict=True)
                for row, (leader, chunk, member, node) in enumerate(rows):
                    items = np.unique(shingles(hashes[words[row] : words[row + 1]], size))
                    if group != (leader, chunk):
                        group, leaders = (leader, chunk), []
                    if not member:
                        leaders.append(items)
                        continue
                    for other in leaders:
                        if 100 * min(len(items), len(other)) < percent * max(len(items), len(other)):
                            continue
                        both = len(np.intersect1d(items, other, assume_unique=True))
                        if 100 * both >= percent * (len(items) + len(other) - both):
                            links.append((leader, node))
                            break
                yield pa.record_batch(
                    [pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["u", "v"]
                )

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (leader, id) whose full shingle sets are similar enough, as u and v.

    Every text in question is sent once per leader; a leader with many members is sent once
    per part of them.
    """
    counts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).alias("parts"))
    members = pairs.join(counts, "leader").select(
        "leader", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "id"
    )
    leaders = counts.select(
        "leader",
        F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"),
        F.lit(False).alias("member"),
        F.col("leader").alias("id"),
    )
    sent = texts.join(members.unionByName(leaders), "id").select("leader", "part", "member", "id", "text")
    sent = sent.repartition("leader", "part").sortWithinPartitions("leader", "part", "member")
    return sent.mapInArrow(_linked(size, percent), "u BIGINT, v BIGINT")


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that each linked node reaches.

    Each round every node moves to the neighbour (or itself) that comes first, and the links
    move along until none is left. Turn by turn the least id comes first, which ends stars
    round their least member at once, and then an order drawn anew, which shortens paths of
    any order by a share: the rounds grow with the logarithm of the longest path.
    """
    edges = stored(links.where("u <> v").select("u", "v").distinct(), "links")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = (lambda c: F.xxhash64(F.lit(turn), c)) if turn % 2 else (lambda c: F.lit(0).cast("long"))  # noqa: B023
        rank = lambda c: F.struct(order(c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        moves = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        moves = stored(moves.select("u", F.least("near", rank("u"))["n"].alias("to")), "moves")
        labels = labels.join(moves, labels["label"] == moves["u"], "left")
        labels = stored(labels.select("node", F.coalesce("to", "label").alias("label")), "labels")
        u, v = moves.select("u", F.col("to").alias("new_u")), moves.select(F.col("u").alias("v"), F.col("to").alias("new_v"))
        edges = edges.join(u, "u").join(v, "v").where("new_u <> new_v")
        edges = stored(edges.select(F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).distinct(), "links")
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return stored(labels.join(least, "label").select("node", "component"), "components")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that a link joins are gone through again."""
    u, v = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    across = links.join(u, "u", "left").join(v, "v", "left")
    above = components(across.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    above = above.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    new = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(found, "node", "left_anti")
    rows = found.unionByName(new.withColumn("component", F.col("node"))).join(above, "component", "left")
    return stored(rows.select("node", F.coalesce("joined", "component").alias("component")), "components")


def _open_members(in_band: DataFrame, found: DataFrame) -> DataFrame:
    """band, id, c: members, with their components so far, of groups that have several components."""
    rows = in_band.join(found, in_band["id"] == found["node"], "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    groups = rows.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    return stored(rows.join(stored(groups.select("band"), "open-bands"), "band", "left_semi"), "open-members")


def _with_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """leader, id: each open member with a few leaders of its groups that are in other components.

    First the least member leads a group, then some that are drawn anew in each round.
    """
    orders = [F.xxhash64(F.lit(turn * LEADERS + k), "id") for k in range(LEADERS)] if turn else [F.col("id")]
    leaders = rows.groupBy("band").agg(*(F.min(F.struct(o.alias("order"), "id", "c")).alias(f"l{k}") for k, o in enumerate(orders)))
    rows = rows.join(stored(leaders, "leaders"), "band")
    chosen = rows.groupBy("id").agg(*(F.min(F.when(F.col("c") != F.col(f"l{k}.c"), F.col(f"l{k}")))["id"].alias(f"l{k}") for k in range(len(orders))))
    chosen = chosen.select("id", F.explode(F.array_distinct(F.array(*(f"l{k}" for k in range(len(orders)))))).alias("l")).where("l IS NOT NULL")
    return chosen.select(F.least("id", "l").alias("leader"), F.greatest("id", "l").alias("id")).distinct()


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for first, end, data, offsets in byte_slices(batch.column("text")):
        hashes, words = word_hashes(data, offsets)
        for row in range(end - first):
            yield np.unique(shingles(hashes[words[row] : words[row + 1]], size))


def _counted(size: int):
    """Per task, how often shingles fall on each counter, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for items in _sets(batch, size):
                np.add.at(counts, (items % np.uint64(COUNTERS)).astype(np.int64), 1)
        parts = [zlib.compress(part.tobytes(), 1) for part in np.split(counts, COUNTER_PARTS)]
        yield pa.record_batch([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    return run


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per part within a task."""
    sums: dict[int, np.ndarray] = {}
    for batch in parts:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(data), np.uint32)
            sums[part] = sums[part] + counts if part in sums else counts
    data = pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())
    yield pa.record_batch([pa.array(list(sums), pa.int32()), data], names=["part", "counts"])


def _prefixes(size: int, percent: int, counters):
    """Each set's rarest shingles: as many as a similar set must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        for batch in batches:
            rows, found, places, sizes = [], [], [], []
            for row, items in enumerate(_sets(batch, size)):
                length = len(items) - -(-percent * len(items) // 100) + 1
                order = np.lexsort((items, counts[(items % np.uint64(COUNTERS)).astype(np.int64)]))
                found.append(items[order[:length]])
                rows.append(np.full(length, row))
                places.append(np.arange(length))
                sizes.append(np.full(length, len(items)))
            none = [np.zeros(0, np.int64)]
            columns = [batch.column(n).take(pa.array(np.concatenate(rows or none))) for n in ("id", "c")]
            columns += [pa.array(np.concatenate(x or none).view(np.int64)) for x in (found, places, sizes)]
            yield pa.record_batch(columns, names=["id", "c", "shingle", "place", "n"])

    return run


def _rare_pairs(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """leader, id: pairs of members of different components that share a rare shingle."""
    texts = stored(texts.join(members, "id"), "open-texts")
    counts = texts.select("text").mapInArrow(_counted(size), "part INT, counts BINARY")
    counts = counts.repartition(COUNTER_PARTS, "part").mapInArrow(_summed, "part INT, counts BINARY").collect()
    sums = np.zeros(COUNTERS, np.uint32).reshape(COUNTER_PARTS, -1)
    for row in counts:
        sums[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    counters = texts.sparkSession.sparkContext.broadcast(sums.ravel())  # COUNTERS * 4 bytes
    rare = stored(texts.mapInArrow(_prefixes(size, percent, counters), "id BIGINT, c BIGINT, shingle BIGINT, place BIGINT, n BIGINT"), "rare-shingles")
    several = rare.groupBy("shingle").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("shingle")
    rare = rare.join(stored(several, "rare-shared"), "shingle", "left_semi")
    other = rare.select("shingle", *(F.col(x).alias(f"{x}_") for x in ("id", "c", "place", "n")))
    # At the first shingle that two sets share in this order, at most what follows in both is shared besides.
    room = F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"))
    possible = room * (100 + percent) >= percent * (F.col("n") + F.col("n_"))
    pairs = rare.join(other, "shingle").where((F.col("c") != F.col("c_")) & (F.col("id_") < F.col("id")) & possible)
    return pairs.select(F.col("id_").alias("leader"), "id").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """doc_id, content, n_shingles, component_id, kept: one row per document.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles; a text with fewer words is one shingle, a text without words
    (null, empty, only white space) has none and is linked with nothing. component_id is the
    least doc_id reachable over links, and the document that has it is kept. Rows with the
    same doc_id are one document: links of any of them count for all. ``content`` is a hash
    of the text. A row without doc_id is linked with nothing, has no component_id and is kept.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("content"), "text")
    base = stored(rows.mapInArrow(_sketches(size, bands, band_rows), BASE_SCHEMA), "sketches")
    usable = base.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    classes = stored(classes.select("set_id", F.col("least.doc_id").alias("id"), "least.bands"), "classes")
    texts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")

    in_band = classes.select("id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Aggregates are written before they are joined: the join then deals out both sides itself and can split a large group.
    in_band = stored(in_band.join(stored(shared.select("band"), "shared-bands"), "band"), "candidates")
    # One shuffle of the texts at every size; later steps move only texts of candidates.
    texts = stored(texts.join(in_band.select("id").distinct().hint("merge"), "id"), "candidate-texts")

    # Rows of one doc_id with different texts hang together as well.
    several = usable.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a <> b")
    aliases = usable.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("set_id", "id"), "set_id")
    found = components(aliases.select(F.col("id").alias("u"), F.col("doc_id").alias("v")))
    tested = None
    for turn in range(ROUNDS):
        pairs = _with_leaders(_open_members(in_band, found), turn)
        pairs = pairs if tested is None else pairs.join(tested, ["leader", "id"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = merged(found, stored(verified(pairs, texts, size, percent), "links"))
    members = stored(_open_members(in_band, found).select("id", "c").distinct(), "open-documents")
    pairs = _rare_pairs(members, texts, size, percent)
    pairs = stored(pairs.join(tested, ["leader", "id"], "left_anti"), "pairs")
    found = merged(found, stored(verified(pairs, texts, size, percent), "links"))

    of_class = classes.select("set_id", "id").join(found, F.col("id") == F.col("node"), "left")
    of_class = of_class.select("set_id", F.coalesce("component", "id").alias("component_id"))
    with_class = base.join(of_class, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return with_class.select(
        "doc_id", "content", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one document of each group, and one row of those with equal doc_id and text.

    Rows without doc_id stay, one for each text.
    """
    docs = drop_repeated_rows(docs)
    dropped = near_duplicates(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
