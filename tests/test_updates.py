"""Snapshots under several writers: no change is lost without an error."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomstone.operators import tables


def test_an_interleaved_writer_is_told(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_snapshot(spark.range(3), root)
    a, b = tables.version(spark, root), tables.version(spark, root)
    tables.write_snapshot(tables.read_snapshot(spark, root, a).union(spark.range(10, 11)), root, base=a)
    before = set(os.listdir(root))
    with pytest.raises(tables.Conflict):
        tables.write_snapshot(tables.read_snapshot(spark, root, b).union(spark.range(20, 21)), root, base=b)
    assert set(os.listdir(root)) == before and tables.version(spark, root) == 2
    tables.updated(spark, root, lambda t: t.union(spark.range(20, 21)))
    assert sorted(r.id for r in tables.read_snapshot(spark, root).collect()) == [0, 1, 2, 10, 20]


def test_writers_at_once_keep_all_changes(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_snapshot(spark.range(1), root)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: tables.updated(spark, root, lambda t: t.union(spark.range(k, k + 1)), tries=30), range(1, 7)))
    assert sorted(r.id for r in tables.read_snapshot(spark, root).collect()) == list(range(7)) and tables.version(spark, root) == 7


def test_a_change_that_always_comes_late_ends_in_a_conflict(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_snapshot(spark.range(1), root)

    def change(t):
        tables.write_snapshot(spark.range(5), root)
        return t.withColumn("id", F.col("id") + 1)

    with pytest.raises(tables.Conflict):
        tables.updated(spark, root, change, tries=2)
    with pytest.raises(tables.NoSnapshot):
        tables.read_snapshot(spark, str(tmp_path / "none"))
