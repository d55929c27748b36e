"""Mixing sources to target weights by Poisson replication.

Each document gets a number of copies drawn from a Poisson distribution by inverting it at
a hash of the document; the mean is its source's target share over its present share. The
copies are dealt out over all partitions by hash, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_broadcast, stored, text_of

# A mean above this is drawn as a sum of independent draws with smaller means.
MEAN_PER_DRAW = 32
DIGITS = 13  # hex digits of a hash, 52 bits, which a double holds exactly
SOURCE_BYTES = 2048  # of a source's row, most of it the distribution function
OWN = ("copy_no", "n_copies", "shuffle_key")


def _hex(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _cumulative(mean: Column) -> Column:
    """Values of the distribution function at 0, 1, ... until it can't grow in a double."""
    last = F.ceil(mean + 14 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """source, weight, bytes, rate: the mean number of copies of a document of each source.

    The mix is to hold ``size`` times the bytes of the input, shared out by weight; sources
    that ``weights`` doesn't name, and null, have weight 1. Bytes are those of the text in UTF-8.
    """
    named = F.lit(1.0)
    for source, weight in (weights or {}).items():
        named = F.when(F.col("mix_source") == source, F.lit(float(weight))).otherwise(named)
    sizes = docs.select(docs["source"].cast("string").alias("mix_source"), F.octet_length(text_of(docs)).cast("long").alias("b"))
    sizes = sizes.groupBy("mix_source").agg(F.sum("b").alias("bytes")).withColumn("weight", named)
    whole = F.struct(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("weights"))
    whole = sizes.select(whole.alias("whole")).scalar()
    rate = F.col("weight") / whole["weights"] * whole["bytes"] * F.lit(float(size)) / F.col("bytes")
    return sizes.select("mix_source", "weight", "bytes", F.when(F.col("bytes") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def _repeated(docs: DataFrame) -> DataFrame:
    """mix_id, mix_first: ids that stand for several texts, and the least hash of those texts."""
    rows = docs.select(docs["doc_id"].cast("string").alias("mix_id"), F.xxhash64(text_of(docs)).alias("h")).where("mix_id IS NOT NULL")
    found = rows.groupBy("mix_id").agg(F.min("h").alias("mix_first"), F.max("h").alias("last"))
    found = stored(found.where("mix_first <> last").drop("last"), "repeated")
    return bounded_broadcast(found, found.count(), 64)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    seed: int = 0,
    by_text: bool = False,
    own_columns: bool = True,
) -> DataFrame:
    """Copies of the documents in shuffled order, with copy_no, n_copies and shuffle_key.

    The number of copies depends on the seed, the doc_id, the text's source and the rates
    alone: rows that repeat a doc_id of a source get equally many copies. A null doc_id or
    source is a value like others. With ``by_text`` different texts are drawn apart also where
    they share a doc_id or have none, by a hash of the text as well; a doc_id that stands for one
    text is drawn as without, and equal texts of one doc_id, or without any, still share a draw. Input columns called like the three new
    ones are dropped; without ``own_columns`` there are no new ones, and all of the input's stay.
    A source with only empty texts has no size to mix by and gets no copies.
    """
    docs = docs.drop(*OWN) if own_columns else docs
    names = docs.columns
    rates = repetition_rates(docs, weights, size).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PER_DRAW)).cast("int"))
    # A row per source, counted before it is broadcast: the documents aren't dealt out by source.
    rates = stored(rates.select("mix_source", "draws", _cumulative(F.col("rate") / F.col("draws")).alias("steps")), "rates")
    rates = bounded_broadcast(rates, rates.count(), SOURCE_BYTES)
    ident = F.coalesce(F.col("r.doc_id").cast("string"), F.lit("null"))
    extra = []
    if by_text:
        text_hash = F.xxhash64(F.coalesce(F.col("r.text").cast("string"), F.lit("")))
        apart = F.col("r.doc_id").isNull() | (F.col("mix_first") != text_hash)
        ident = F.when(apart, F.concat_ws("/", ident, text_hash.cast("string"))).otherwise(ident)
        extra = ["mix_first"]

    def uniform(draw: Column) -> Column:
        digits = F.substring(_hex(F.lit(str(seed)), ident, draw.cast("string")), 1, DIGITS)
        return F.conv(digits, 16, 10).cast("double") / 16.0**DIGITS

    points = F.transform(F.sequence(F.lit(1), F.col("draws")), uniform)
    count = F.aggregate("points", F.lit(0), lambda n, u: n + F.size(F.filter("steps", lambda c: c <= u)))
    rows = docs.select(F.struct(*names).alias("r"))
    if by_text:
        rows = rows.join(_repeated(docs), F.col("r.doc_id").cast("string") == F.col("mix_id"), "left").drop("mix_id")
    rows = rows.join(rates, F.col("r.source").cast("string").eqNullSafe(F.col("mix_source")))
    rows = rows.select("r", *extra, "steps", points.alias("points")).select("r", *extra, count.alias("n_copies")).where("n_copies > 0")
    rows = rows.select("r", *extra, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    key = _hex(F.lit(f"{seed}/order"), ident, F.col("copy_no").cast("string"))
    rows = rows.withColumn("shuffle_key", key).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
    return rows.select("r.*", *OWN) if own_columns else rows.select("r.*")
