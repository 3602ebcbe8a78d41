"""The shared folder rule and the release of cut tables."""

import os

import pytest

from keelson import session


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


class _Session:
    sparkContext = _Context()
    conf = {}


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session())


def test_cut_tables_are_released(spark):
    before = session._CUTS.pop(spark.sparkContext.applicationId, [])
    df = session.cut_lineage(spark.range(5))
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.cut_lineage(spark.range(0)).count() == 0
    assert session.release_cuts(spark) == 2 and not os.path.exists(path)
    session._CUTS[spark.sparkContext.applicationId] = before
