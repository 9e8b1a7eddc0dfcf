from types import SimpleNamespace

import pytest

from grainsift.functions.lineage import checkpoint_folder, cut


def session(master, conf=None, have=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: have, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf if k == "spark.checkpoint.dir" else d)), made


def test_the_cluster_names_the_folder():
    spark, made = session("spark://host:7077", "hdfs:///shared")
    checkpoint_folder(spark)
    assert made == ["hdfs:///shared"]
    spark, made = session("spark://host:7077", "hdfs:///shared", "hdfs:///own")
    checkpoint_folder(spark)
    assert made == []


def test_only_a_local_session_makes_its_own():
    spark, made = session("local[4]")
    checkpoint_folder(spark)
    assert len(made) == 1
    for master in ("yarn", "k8s://host", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            checkpoint_folder(session(master)[0])


def test_cut_reads_from_the_folder(spark):
    df = cut(spark.range(10))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 10
