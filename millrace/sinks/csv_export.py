"""Export of gold relations as ``;``-separated CSV."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import storage
from millrace.session import scratch_dir

# Reports are mostly small: several are computed at a time.
SIDE_BY_SIDE = 4
CSV_OPTIONS = {
    "sep": ";",
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_text(df: DataFrame) -> DataFrame:
    """Columns as CSV can hold them: times as text, sub-documents as JSON text."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.VariantType, T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def export_csv(models: Mapping[str, DataFrame], path: str, single_file: bool = True) -> dict[str, str]:
    """Write each relation to ``<path>/<name>.csv``; returns the paths by name.

    A relation is computed in parallel, and its sorted partitions are written in order.
    With ``single_file`` they are then copied one after another into one file, whatever
    their size, through a small buffer; without, ``<name>.csv`` is always a folder whose files, in name order, hold the
    rows in order, each with a header. Relations of equal name in two layers are told apart
    by their layer. A few are written side by side. A report appears under its name by a rename: the one before is moved
    aside first, comes back if the rename fails, and goes last. No relations, no files.
    """
    names = [full_name.split(".")[-1] for full_name in models]

    def export(full_name: str, df: DataFrame) -> str:
        name = full_name.split(".")[-1]
        return _export(df, f"{path.rstrip('/')}/{full_name if names.count(name) > 1 else name}.csv", single_file)

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return dict(zip(models, pool.map(export, models.keys(), models.values()), strict=True))


def _export(df: DataFrame, target: str, single_file: bool) -> str:
    spark = df.sparkSession
    # Written next to the target, so that the rename stays within one file system.
    folder, _, file_name = target.rpartition("/")
    mark = scratch_dir(spark, "csv").rpartition("/")[2]
    hidden, older = f"{folder}/.{mark}-{file_name}", f"{folder}/.{mark}-older-{file_name}"
    try:
        if single_file:
            parts = f"{hidden}/parts"
            csv_text(df).write.options(**CSV_OPTIONS | {"header": "false"}).csv(parts)
            source = f"{hidden}/{file_name}"
            header = ";".join(_quoted(name) for name in df.columns) + "\n"
            storage.concatenate(spark, [f"{parts}/{name}" for name in storage.part_files(spark, parts)], source, header)
        else:
            csv_text(df).write.options(**CSV_OPTIONS).csv(source := f"{hidden}/parts")
        if storage.exists(spark, target):
            storage.rename(spark, target, older)
        try:
            storage.rename(spark, source, target)
        except Exception:
            if storage.exists(spark, older):
                storage.rename(spark, older, target)
            raise
    finally:
        storage.delete(spark, hidden)
        storage.delete(spark, older)
    return target


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ';"\n\r') else name


def layer_relations(spark: SparkSession, layer: str = "gold") -> dict[str, DataFrame]:
    """Every stored table or view of a catalog database by ``layer.name``; none without the database."""
    if not spark.catalog.databaseExists(layer):
        return {}
    names = [table.name for table in spark.catalog.listTables(layer) if not table.isTemporary]
    return {f"{layer}.{name}": spark.table(storage.quoted(f"{layer}.{name}")) for name in names}


def export_layer(spark: SparkSession, path: str, layer: str = "gold", single_file: bool = True) -> dict[str, str]:
    """Export every stored table or view of a catalog database; no database, no files."""
    return export_csv(layer_relations(spark, layer), path, single_file)
