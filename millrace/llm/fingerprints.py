"""Threshold-scaled sketches of documents, with DataFrame and SQL functions only.

A text's shingles of five words are hashed, and every hash below a fixed fraction of all hashes
is retained, so a sketch grows with its text and two sketches show how much of the smaller text
the larger one contains, however unequal they are. A text that has fewer than ``FLOOR`` of them
retains its ``FLOOR`` least hashes instead (all, if there are no more). Both are sets that can
be merged: the sketch of two texts together follows from their sketches alone.

Documents are compared with the next one by doc_id. They are dealt out once, by ranges of
(doc_id, hash of the text) of about equal numbers of rows; the first document of a range also goes
to the range before it, as a guest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_broadcast, stored, text_of

SIZE = 5  # words in a shingle
FRACTION = 8  # one hash in so many is below the threshold
FLOOR = 16
DIGITS = 12  # hexadecimal digits of a hash
RANGE_BYTES = 16 << 20  # of texts in a range, but there are several ranges for each task
MAX_RANGES = 20_000  # beyond, ranges grow: their ends are part of the query's plan
# Equal rows (same doc_id and text) beyond this number are worked on once.
MANY = 100_000

_SPACE = r"\x20\x09-\x0D"


def threshold(fraction: int = FRACTION) -> str:
    """Hashes below this text of hexadecimal digits are retained."""
    return format(16**DIGITS // fraction, f"0{DIGITS}x")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sketch_sql(text: str, size: int = SIZE, fraction: int = FRACTION, floor: int = FLOOR) -> str:
    """SQL for the sketch of a text: sorted distinct hashes as texts of ``DIGITS`` hexadecimal digits.

    Words are runs other than ASCII white space, upper and lower case apart. A text of fewer words than a
    shingle is one shingle; without words the sketch is empty. A hash is the start of the
    shingle's MD5, its words joined by one space.
    """
    # Word by word: slice() copies the whole array each time.
    run = ", ' ', ".join(f"w[i + {k}]" for k in range(size))
    runs = f"transform(sequence(0, size(w) - {size}), i -> substr(md5(concat({run})), 1, {DIGITS}))"
    hashes = f"CASE WHEN size(w) < {size} THEN array(substr(md5(array_join(w, ' ')), 1, {DIGITS})) ELSE {runs} END"
    below = f"array_distinct(filter(all, x -> x < '{threshold(fraction)}'))"
    least = f"slice(array_sort(array_distinct(all)), 1, {floor})"
    chosen = _let(hashes, "all", _let(below, "below", f"CASE WHEN size(below) >= {floor} THEN array_sort(below) ELSE {least} END"))
    words = rf"split(trimmed, r'[{_SPACE}]+')"
    chosen = f"CASE WHEN trimmed = '' THEN cast(array() AS array<string>) ELSE {_let(words, 'w', chosen)} END"
    return _let(f"btrim({text}, ' \t\n\x0b\x0c\r')", "trimmed", chosen)


def _limit(sketch_name: str, fraction: int, floor: int) -> str:
    """SQL: the greatest hash up to which a sketch has all hashes of its text."""
    last = format(16**DIGITS // fraction - 1, f"0{DIGITS}x")
    return f"CASE WHEN size({sketch_name}) < {floor} THEN 'g' ELSE greatest(element_at({sketch_name}, -1), '{last}') END"


def containment_sql(a: str, b: str, fraction: int = FRACTION, floor: int = FLOOR) -> str:
    """SQL: the estimated share of the smaller text's shingles that the other one has, from 0 to 1.

    Only hashes count up to which both sketches are complete. Equal sketches give 1, and
    unequal ones 0 if one of them has no hash in that range.
    """
    count = lambda x: f"size(filter({x}, x -> x <= lim))"
    share = f"CASE WHEN least({count(a)}, {count(b)}) = 0 THEN 0D ELSE {count(f'array_intersect({a}, {b})')} / CAST(least({count(a)}, {count(b)}) AS DOUBLE) END"
    return f"CASE WHEN {a} = {b} THEN 1D ELSE {_let(f'least({_limit(a, fraction, floor)}, {_limit(b, fraction, floor)})', 'lim', share)} END"


def merged_sql(a: str, b: str, fraction: int = FRACTION, floor: int = FLOOR) -> str:
    """SQL: the sketch of both texts' shingles together."""
    below = f"filter(both, x -> x < '{threshold(fraction)}')"
    return _let(f"array_sort(array_union({a}, {b}))", "both", f"CASE WHEN size({below}) >= {floor} THEN {below} ELSE slice(both, 1, {floor}) END")


def fingerprint_sql(sketch_name: str) -> str:
    """SQL: a sketch as one text, its hashes one after another."""
    return f"array_join({sketch_name}, '')"


def sketch_of_sql(fingerprint: str) -> str:
    """SQL: the sketch that a fingerprint writes out."""
    return f"regexp_extract_all({fingerprint}, '[0-9a-f]{{{DIGITS}}}', 0)"


def _bucket(doc_id: str, content: str, cuts: list[int], total: int, null_buckets: int) -> Column:
    """Number of the range of (doc_id, content); it grows with both, null ids last.

    ``cuts`` are doc_ids in order; one that stands there several times is an id of many rows,
    whose rows are divided among that many ranges by content.
    """
    uniform = (F.col(content).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    part = lambda n: F.least(F.greatest(F.floor(uniform * n), F.lit(0)), n - 1).cast("int")
    nulls = F.lit(total) + part(F.lit(null_buckets))
    if not cuts:
        return F.when(F.col(doc_id).isNull(), nulls).otherwise(F.lit(0))
    distinct = sorted(set(cuts))
    upto, at = [0], 0
    for cut in distinct:
        while at < len(cuts) and cuts[at] == cut:
            at += 1
        upto.append(at)
    steps = max(1, math.ceil(math.log2(len(distinct) + 1)))
    values, ends = (f"array({', '.join(f'{x}{kind}' for x in numbers)})" for numbers, kind in ((distinct, "L"), (upto, "")))
    # Binary search: the number of distinct cuts that are not above the id.
    place = F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(distinct)}), (s, _) -> CASE WHEN s.lo >= s.hi THEN s "
        f"WHEN element_at({values}, int((s.lo + s.hi) div 2 + 1)) <= {doc_id} THEN named_struct('lo', int((s.lo + s.hi) div 2 + 1), 'hi', s.hi) "
        f"ELSE named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2)) END, s -> s.lo)"
    )
    ends, values = F.expr(ends), F.expr(values)
    before, upto_here = F.element_at(ends, F.greatest(place, F.lit(1))), F.element_at(ends, place + 1)
    exact = (place > 0) & (F.element_at(values, F.greatest(place, F.lit(1))) == F.col(doc_id))
    return F.when(F.col(doc_id).isNull(), nulls).when(exact, before + 1 + part(upto_here - before)).otherwise(upto_here)


def compare_neighbours(
    docs: DataFrame, size: int = SIZE, fraction: int = FRACTION, floor: int = FLOOR, range_bytes: int = RANGE_BYTES, many: int = MANY
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per document.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document. Documents are in the order of doc_id, nulls
    last; rows of one doc_id go by a hash of the text, and after the last row comes the first.
    ``near_edited`` and ``near_next`` are the estimated containment of the fingerprint in the
    edited text's and the next document's, or the other way round, whichever is the smaller text.
    A null text counts as empty, and an empty text has an empty fingerprint, which only equals
    another empty one. Equal rows (doc_id and text) each give a row. No documents, no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    counts = stored(rows.groupBy("doc_id", "content").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "ids")
    total = counts.agg(F.sum("n"), F.sum("bytes"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.max("n")).first()
    if not total[0]:
        return _likeness(rows.withColumn("next_text", F.col("text")), size, fraction, floor)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_RANGES, max(4 * tasks, math.ceil(total[1] / range_bytes)))
    tasks = max(tasks, buckets // 4)
    with_id = total[0] - (total[2] or 0)
    own = math.ceil(buckets * with_id / total[0])
    cuts = []
    if own > 1:
        shares = [k / own for k in range(1, own)]
        cuts = rows.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * own))).first()[0]
    bucket = _bucket("doc_id", "content", cuts, own, max(1, buckets - own))

    # The first document of each range that has any, and the range before it.
    in_order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "content")
    firsts = counts.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(in_order).alias("first"))
    places = Window.orderBy("bucket")  # a row per range
    wrapped = F.coalesce(F.lag("bucket").over(places), F.max("bucket").over(places.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("bucket", F.col("first.doc_id").alias("first_id"), F.col("first.content").alias("first_content"), wrapped.alias("before"))
    firsts = stored(firsts, "range-heads")

    rest, copies = rows, None
    if total[3] > many:
        hot = counts.where(F.col("n") > many).select(F.col("doc_id").alias("hot_id"), F.col("content").alias("hot_content"), F.col("n").alias("hot_n"))
        hot = stored(hot, "repeated-rows")
        hot = bounded_broadcast(hot, total[0] // many, 64)
        same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("content") == F.col("hot_content"))
        repeated = rows.join(hot, same).groupBy("doc_id", "content").agg(F.max("text").alias("text"), F.first("hot_n").alias("n"))
        repeated = stored(repeated, "repeated-rows")
        rest = rows.join(hot, same, "left_anti").unionByName(repeated.drop("n"))
        # A copy is followed by a copy, but for the last one, which is among the rest.
        copies = _likeness(repeated.withColumn("next_text", F.col("text")), size, fraction, floor, "n")
        copies = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 2) / many).cast("int")))).repartition("doc_id", "piece")
        left = F.least(F.lit(many), F.col("n") - 1 - F.col("piece") * many).cast("int")
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), left))).drop("n", "piece", "copy")

    at_head = (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("first_content"))
    heads = bounded_broadcast(firsts.withColumnRenamed("bucket", "head_bucket"), buckets, 64)
    placed = rest.withColumn("bucket", bucket).join(heads, at_head, "left")
    here, guest = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    targets = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, guest))
    dealt = placed.select("doc_id", "content", "text", F.inline(targets)).repartition(tasks, "bucket")
    following = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "content")
    dealt = dealt.withColumn("next_text", F.lead("text").over(following)).withColumn("sketch", F.expr(sketch_sql("text", size, fraction, floor)))
    dealt = dealt.withColumn("next_sketch", F.lead("sketch").over(following)).where(~F.col("guest"))
    compared = _likeness(dealt, size, fraction, floor)
    return compared.unionByName(copies) if copies is not None else compared


def _likeness(pairs: DataFrame, size: int, fraction: int, floor: int, *kept: str) -> DataFrame:
    """The result's columns of rows with ``text`` and ``next_text``, and their sketches if they are there."""
    for name, text in (("sketch", "text"), ("next_sketch", "next_text")):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.expr(sketch_sql(text, size, fraction, floor)))
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.expr("concat(substr(text, 1, n_chars - n_chars div 2), substr(next_text, 1, n_chars div 2))"))
    pairs = pairs.withColumn("edited_sketch", F.expr(sketch_sql("edited", size, fraction, floor)))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(fingerprint_sql("sketch")).alias("fingerprint"),
        F.expr(fingerprint_sql("edited_sketch")).alias("edited_fingerprint"),
        F.expr(containment_sql("sketch", "edited_sketch", fraction, floor)).alias("near_edited"),
        F.expr(containment_sql("sketch", "next_sketch", fraction, floor)).alias("near_next"),
        *kept,
    )
