"""Where intermediates go: the session's folder, the context's, or (local runs only) one of our own."""

import pytest

from recsift import session as S


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.applicationId = master, folder, "test"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, conf=None, folder=None):
        self.conf, self.sparkContext = _Conf(conf or {}), _Context(master, folder)


@pytest.fixture(autouse=True)
def no_shipping(monkeypatch):
    monkeypatch.setattr(S, "ship_package", lambda spark: None)


def test_setting_of_the_session_comes_first():
    s = _Session("spark://x:7077", {"spark.checkpoint.dir": "s3://shared/a"}, "s3://shared/b")
    assert S.ensure_checkpoint_dir(s) == "s3://shared/a"
    assert S.scratch_path(s, "n").startswith("s3://shared/a/n-")


def test_checkpoint_folder_of_the_context():
    s = _Session("spark://x:7077", folder="s3://shared/b")
    assert S.ensure_checkpoint_dir(s) == "s3://shared/b" and S.scratch_path(s, "n").startswith("s3://shared/b/n-")


def test_own_folder_in_local_runs_only():
    assert S.ensure_checkpoint_dir(_Session("local[2]")).startswith("/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(_Session("spark://x:7077"))
