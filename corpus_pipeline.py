"""From raw documents to token files: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ship, stored, table
from millrace.llm.decontam import drop_contaminated
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import drop_near_duplicates
from millrace.llm.quality import drop_rejected, fit
from millrace.llm.queries import END_ID, MIX_SEED, MIX_SIZE, WINDOW, tokenizer_path
from millrace.llm.token_files import token_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    ship(spark)
    return drop_rejected(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is similar by five-word shingles; equal rows leave one."""
    ship(spark)
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shuffled order, as often as equal weights of all sources ask for."""
    return mix(docs, size=MIX_SIZE, seed=MIX_SEED, by_text=True, own_columns=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies in an order by hash, copy by copy, as their digests per document."""
    ship(spark)
    shuffled = F.xxhash64(F.lit(MIX_SEED), docs["doc_id"], docs["text"], F.monotonically_increasing_id())
    return token_digests(docs, tokenizer_path(), END_ID, order=[shuffled])


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token files", tokens),
]

# The classifier, sketches and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each copy in the token files, after all stages.

    Each stage reads what the one before has written to the shared folder. Null ids and texts, ties and
    repeated rows are treated as the stages' operators say; an empty table gives no rows, and
    further columns go along up to the last stage, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
