"""Scans of queue files: frames are the texts between blank lines.

A text scan may cut a file at any byte. Where two frames are separated by exactly one
blank line every cut is harmless; where they are separated by more, a cut inside the run
of line feeds can give a frame to both sides. Outside producers may write such runs, so
their ``.bin`` files are read in one piece each, by streaming through them, unless the
caller says that they are ``splittable``. Files that ``land`` writes (``.txt``) have no
such runs and are always cut freely. No size of a file decides anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_END = "\n\n"
QUEUE_FILES = "*.{bin,txt}"
# Hadoop's codec that passes a file through unchanged and, as codecs do, in one piece.
# The second name of its setting is the one in the client jars that Spark ships.
IN_ONE_PIECE = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".bin",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".bin",
}
AMBIGUOUS = (
    "a file that was read in several pieces has several blank lines in a row; "
    "read it in one piece, as a .bin file and without splittable=True: "
)


def _scan(spark: SparkSession, path: str | list[str], streaming: bool, by_topic: bool, options: dict) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    schema = "value STRING, topic STRING" if by_topic else "value STRING"
    reader = reader.format("text").schema(schema).option("lineSep", FRAME_END).option("pathGlobFilter", QUEUE_FILES)
    return reader.options(**options).load(path)


def read_frames(
    spark: SparkSession,
    path: str | list[str],
    streaming: bool = False,
    by_topic: bool = False,
    splittable: bool = False,
    **options: str | int,
) -> DataFrame:
    """Frames of the queue files in a folder as ``value`` with their ``file_name``.

    With ``by_topic`` the folder has a sub-folder ``topic=<name>`` per topic, as ``land``
    writes them, and the topic is a column. With ``splittable``, in batch as in a stream,
    a ``.bin`` file is shared by many tasks; if a cut then meets frames that are separated
    by several blank lines, the job fails rather than give a frame twice.
    ``options`` go to the text source; for streams ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bound a batch.
    """
    pieces = {} if splittable else IN_ONE_PIECE
    return _named(_scan(spark, path, streaming, by_topic, {**pieces, **options}))


def _named(frames: DataFrame) -> DataFrame:
    """Frames with their file name; an error where a cut may have doubled one."""
    in_pieces = F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    problem = F.raise_error(F.concat(F.lit(AMBIGUOUS), F.col("_metadata.file_path"))).cast("string")
    value = F.when(F.startswith("value", F.lit("\n")) & in_pieces, problem).otherwise(F.col("value"))
    others = [name for name in frames.columns if name != "value"]
    return frames.select(value.alias("value"), *others, F.col("_metadata.file_name").alias("file_name"))


def new_frames(spark: SparkSession, path: str, last_name: str | None = None, splittable: bool = False) -> DataFrame:
    """Frames of the files whose name is greater than the last loaded one.

    The name filter removes files from the scan before anything is read.
    """
    frames = read_frames(spark, path, splittable=splittable)
    return frames if last_name is None else frames.where(F.col("file_name") > last_name)
