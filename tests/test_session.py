"""The shared folder: what is written, and what is deleted."""

import os

import pytest

from lynceus import session as S
from lynceus.session import discard, scratch, written


def test_tables_are_deleted(spark):
    folder = S.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    a = written(spark.range(3))
    b = written(a)
    discard(a, None, spark.range(1))
    assert set(os.listdir(folder)) - before == {os.path.basename(b.written_path)} and b.count() == 3
    with scratch(spark):
        written(spark.range(2))
        with scratch(spark):
            written(spark.range(2))
    assert set(os.listdir(folder)) - before == {os.path.basename(b.written_path)}
    discard(b)
    assert set(os.listdir(folder)) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        S.shared_folder(Session())
    assert all(S.LOCAL_MASTER.fullmatch(x) for x in ("local", "local[4]", "local-cluster[3,2,1024]")) and not S.LOCAL_MASTER.fullmatch("yarn")


def test_freed_memory_goes_back_to_the_system(spark):
    S.tidy(spark)
    assert "Trim native heap" in S.trimmed(spark)
