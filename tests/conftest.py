import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from keelson.session import get_spark
    scratch = tempfile.mkdtemp(prefix="keelson-test-")
    s = get_spark("local[4]", app="keelson-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": f"{scratch}/ckpt", "spark.local.dir": f"{scratch}/local",
                         "spark.sql.streaming.schemaInference": "false"})
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
