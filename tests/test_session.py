import types

import pytest

from millrace.session import RESULT_SETTINGS, configure, scratch_dir, shared_dir


def fake(master, **conf):
    """A stand-in for a session on another master."""
    settings = types.SimpleNamespace(get=conf.get, set=conf.__setitem__)
    return types.SimpleNamespace(conf=settings, sparkContext=types.SimpleNamespace(master=master))


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_dir(fake("yarn", **{"spark.checkpoint.dir": "hdfs://data/shared/"})) == "hdfs://data/shared"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_a_cluster_without_one_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))


def test_a_local_session_without_one_keeps_one_folder():
    session = fake("local[2]")
    assert shared_dir(session) == shared_dir(session)


def test_configure(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    configure(spark)
    assert all(spark.conf.get(name) == value for name, value in RESULT_SETTINGS.items())
