"""Lineage cuts and their release."""

import os

from latentia import session


def test_cut_and_release(spark):
    df = session.cut(spark.range(10).withColumnRenamed("id", "a"))
    assert df.count() == 10 and df.columns == ["a"]
    where = session.work_dir(spark).removeprefix("file:")
    assert os.path.isdir(where)
    session.release(spark)
    assert not os.path.exists(where)
    assert session.cut(spark.range(3)).count() == 3


def test_package_is_sent_once(spark):
    session.ship(spark)
    session.ship(spark)
    assert spark.sparkContext._latentia_shipped
