"""Where intermediate tables are written, and when they go."""

from types import SimpleNamespace

import pytest

from lamella.llm import common


def session(master, conf=None, own=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: own, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf or d), sparkContext=context), made


def test_the_setting_of_the_session_comes_first():
    assert common.shared_dir(session("spark://x", "hdfs://a/b/")[0]) == "hdfs://a/b"
    assert common.shared_dir(session("yarn", None, "hdfs://c")[0]) == "hdfs://c"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(session(master)[0])


def test_a_local_session_gets_a_folder():
    spark, made = session("local[4]")
    assert common.shared_dir(spark) == made[0]


def test_scratch_tables(spark):
    with common.scratch() as kept:
        a, b = (common.table(spark.range(3), n) for n in "ab")
        kept.append(b)
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(a._lamella_path).count()
    common.release(b)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(b._lamella_path).count()
