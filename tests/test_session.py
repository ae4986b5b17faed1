"""The shared folder: the setting where there is one, a temporary folder on a local master only."""

from types import SimpleNamespace

import pytest

from rangeweave import session


def a_session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert session.shared_dir(a_session("spark://m:7077", "hdfs://n/shared/")) == "hdfs://n/shared"
    assert session.shared_dir(a_session("local[4]")).startswith("file:///")
    for master in ("spark://m:7077", "yarn", "k8s://https://m", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(a_session(master))
