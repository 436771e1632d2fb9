from types import SimpleNamespace

import pytest

from barspark.plans import shared_dir, stage


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: None),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)),
    )


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(master))
    assert shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"


def test_stages_read_back(spark):
    rows = stage(spark.range(10).selectExpr("id", "null as nothing", "array(id) as list").drop("nothing"), "test")
    assert sorted(r.id for r in rows.collect()) == list(range(10)) and rows.schema["list"].dataType.simpleString() == "array<bigint>"
