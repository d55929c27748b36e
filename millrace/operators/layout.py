"""How stored layers lie: by day of the load and load, closed days as one partition."""

from __future__ import annotations

import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage

TABLE_OPTIONS = "compression 'zstd', partitionOverwriteMode 'dynamic'"
LOAD_COLUMNS = "load_day DATE, load_id STRING"
COMPACTED = "compacted"
COMPACTING = "millrace.compacting"


def ensure_layer(spark: SparkSession, layer: str, root: str | None = None) -> None:
    """Create the layer's database if absent, below ``root`` if given."""
    place = f" LOCATION {storage.literal(f'{root}/{layer}')}" if root else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {storage.quoted(layer)}{place}")


def property_of(spark: SparkSession, table: str, name: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    row = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == name).first()
    return row["value"] if row else None


def set_property(spark: SparkSession, table: str, name: str, value: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({storage.literal(name)} = {storage.literal(value)})")


def partition_values(spark: SparkSession, table: str, only: str = "") -> list[tuple[str, ...]]:
    """The values of the partitions' columns, as text, from the catalog alone."""
    rows = spark.sql(f"SHOW PARTITIONS {table} {only}").collect()
    return [tuple(unquote(part.split("=", 1)[1]) for part in row[0].split("/")) for row in rows]


def partitions_of(spark: SparkSession, table: str, only: str = "") -> list[tuple[str, str]]:
    """(day, load) of the partitions, from the catalog alone."""
    return partition_values(spark, table, only)


def load_place(spark: SparkSession, table: str, load_id: str) -> str:
    """The partition of a load: where it was written before, or else today's."""
    found = partitions_of(spark, table, f"PARTITION (load_id = {storage.literal(load_id)})")
    day = found[0][0] if found else datetime.datetime.now(datetime.timezone.utc).date().isoformat()
    return f"load_day = DATE {storage.literal(day)}, load_id = {storage.literal(load_id)}"


def compact_days(spark: SparkSession, table: str, before: datetime.date) -> list[str]:
    """Turn the loads of each day before the given one into one partition; returns those days.

    So the number of partitions follows the days and the loads of open days. The rows of a
    day are written beside the table and swapped in by the catalog; the day in work is
    noted with the table, so that a run that was cut off is taken up again. Loads of closed
    days can't be repeated afterwards. Run it between cycles.
    """
    unfinished = property_of(spark, table, COMPACTING)
    by_day: dict[str, list[str]] = {}
    for day, load in partitions_of(spark, table):
        by_day.setdefault(day, []).append(load)
    done = []
    for day, loads in sorted(by_day.items()):
        if day >= before.isoformat() or loads == [COMPACTED]:
            continue
        place = lambda load, day=day: f"PARTITION (load_day = DATE {storage.literal(day)}, load_id = {storage.literal(load)})"
        if not (unfinished == day and COMPACTED in loads):
            rows = spark.table(table).where(F.col("load_day") == F.lit(day).cast("date")).drop("load_day", "load_id")
            path = _beside(spark, table, day)
            rows.hint("rebalance").write.mode("overwrite").option("compression", "zstd").parquet(path)
            set_property(spark, table, COMPACTING, day)
            if COMPACTED in loads:
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {place(COMPACTED)}")
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {place(COMPACTED)} LOCATION {storage.literal(path)}")
        for load in loads:
            if load != COMPACTED:
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {place(load)}")
        set_property(spark, table, COMPACTING, "")
        done.append(day)
    spark.catalog.refreshTable(table)
    return done


def _beside(spark: SparkSession, table: str, day: str) -> str:
    """A folder for a compacted day, another one each time."""
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(F.col("col_name") == "Location").first()["data_type"]
    version = 0
    while storage.exists(spark, path := f"{details.rstrip('/')}_days/{day}-{version}"):
        version += 1
    return path


def without_load(df: DataFrame) -> DataFrame:
    """A stored relation without the columns of its layout."""
    return df.drop("load_day", "load_id")
