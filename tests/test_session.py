import os

import pytest

from parcelight import session


class Cluster:
    """What work_dir asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = type("C", (), {"master": master}), {"spark.checkpoint.dir": folder}


def test_folder_of_intermediate_tables():
    assert session.work_dir(Cluster("yarn", "hdfs://x/work/")) == "hdfs://x/work"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.work_dir(Cluster(master))
    assert os.path.isdir(session.work_dir(Cluster("local[4]")))


def test_tables_are_discarded(spark):
    session.discard(spark)
    df = session.materialize(spark.range(3), "numbers")
    path = session._written[0]
    assert df.count() == 3 and os.path.isdir(path)
    assert session.discard(spark) == 1 and not os.path.exists(path)
