"""File-system metadata calls (list, rename, delete) through Hadoop's FileSystem, and names in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def make_dirs(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    if not _fs(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"cannot rename {source} to {target}")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    return _fs(spark, path).getContentSummary(_path(spark, path)).getLength()


def concatenate(spark: SparkSession, sources: list[str], target: str, header: str) -> None:
    """Write a header and then the files one after another; bytes pass through a small buffer."""
    fs = _fs(spark, target)
    out = fs.create(_path(spark, target))
    try:
        out.write(bytearray(header, "utf-8"))
        for source in sources:
            stream = fs.open(_path(spark, source))
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()


def quoted(name: str) -> str:
    """A table or layer name, part by part in back quotes, unless a part has them already."""
    parts = name.split(".") if "`" not in name else [name]
    return ".".join(part if part.startswith("`") else "`" + part.replace("`", "``") + "`" for part in parts)


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def part_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files directly in ``path``, in name order."""
    names = (status.getPath().getName() for status in _fs(spark, path).listStatus(_path(spark, path)))
    return sorted(name for name in names if name.startswith("part-"))
