"""Work folder and spreading."""

import os

import pytest

from inkwell.session import clean_work, spread, work_folder, written


def test_written_tables_live_in_the_shared_folder_until_cleaned(spark):
    folder = work_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir") + "/inkwell"
    df = written(spark.range(10), "t")
    assert df.count() == 10
    made = [n for n in os.listdir(folder) if n.startswith("t-")]
    assert made
    clean_work(spark)
    assert not any(n in os.listdir(folder) for n in made)


def test_spread_only_where_asked_for(spark):
    rows = spark.range(100, numPartitions=2)
    assert spread(rows, "id") is rows
    spark.conf.set("inkwell.spread", "8")
    try:
        assert spread(rows, "id").rdd.getNumPartitions() == 8
    finally:
        spark.conf.unset("inkwell.spread")


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,512]"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})()

    with pytest.raises(RuntimeError):
        work_folder(Session())
