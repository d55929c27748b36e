"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that results depend on. Both can be changed on a running session.
RESULT_SETTINGS = {
    # dt is stored without a zone; offsets in the feed are converted to UTC.
    "spark.sql.session.timeZone": "UTC",
    # A document that repeats a key is still one valid document.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# Where the state of running counts is kept: on disk, with changes only in the checkpoint.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to a running session."""
    for name, value in RESULT_SETTINGS.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for name, value in STATE_SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in RESULT_SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which is
    then kept in the setting for the rest of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = spark.conf.get("millrace.local.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.local.dir", base)
    return base


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
