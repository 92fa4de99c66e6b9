"""The checkpoint folder: read from the session; a private /tmp folder only in local mode."""

import pytest

from brickyard.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, conf):
        self.master, self._conf, self.dir = master, _Conf(conf), None

    def getCheckpointDir(self):
        return self.dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, conf=None, runtime=None):
        self.sparkContext = _Context(master, conf or {})
        self.conf = _Conf(runtime or {})


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_folder_is_used():
    assert ensure_checkpoint_dir(_Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})) == \
        "hdfs:///shared/ckpt"
    assert ensure_checkpoint_dir(_Session("k8s://x", runtime={"spark.checkpoint.dir": "s3a://b/ckpt"})) == "s3a://b/ckpt"


def test_local_mode_gets_a_private_folder():
    d = ensure_checkpoint_dir(_Session("local[2]"))
    assert d.startswith("/tmp/brickyard-ckpt-")
