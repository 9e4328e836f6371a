import os
import types

import pytest

from panelwright import staging
from panelwright.schema import literal_table


def session(folder, master, app="app"):
    conf = types.SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId=app))


def test_the_cluster_names_the_folder(spark):
    assert staging.staging_folder(session("hdfs:///x", "yarn")) == "hdfs:///x"
    assert staging.staging_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_only_local_sessions_get_a_folder_of_their_own():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_folder(session(None, "spark://host:7077"))
    own = staging.staging_folder(session(None, "local[2]"))
    assert os.path.isdir(own) and staging.staging_folder(session(None, "local[2]")) == own
    assert staging.staging_folder(session(None, "local[2]", "other")) != own


def test_settled_tables_keep_rows_types_and_know_their_size(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) as s", "map('a', id) as m", "array(id) as l")
    back = staging.settle(df)
    assert back.dtypes == df.dtypes and back.count() == 100
    size = int(str(back._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert 0 < size < 100_000
    assert staging.settle(df.where("id < 0")).count() == 0


def test_shuffles_end_with_the_write_and_released_tables_are_gone(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        blocks = manager.getAllFiles()
        names = [blocks.apply(i).getName() for i in range(blocks.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffle_files()
    back = staging.settle(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").sum("id").repartition(3))
    assert not shuffle_files() - before
    path = back.inputFiles()[0].removeprefix("file:").replace("///", "/")
    other = spark.range(3)
    assert os.path.exists(path) and back.count() == 7
    staging.release(back, other, None)
    assert not os.path.exists(os.path.dirname(path)) and other.count() == 3
    staging.release(back)


def test_literal_tables_are_small_enough_to_broadcast(spark):
    rows = [("it's", None, {"K": "v"}), ("back\\slash", 2.5, None)]
    df = literal_table(spark, rows, "name string, x double, m map<string,string>")
    assert [(r.name, r.x, r.m) for r in df.collect()] == rows
    joined = spark.range(10).selectExpr("cast(id as string) as name").join(df, "name")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
