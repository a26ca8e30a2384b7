"""The folder that driver and executors share."""

import pytest

from polyframe.session import shared_dir, temporary


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/of-this-run"


class Session:
    def __init__(self, master, folder=None, setting=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_the_setting_comes_first():
    assert shared_dir(Session("spark://a:7077", "file:/own", "/mnt/shared/")) == "/mnt/shared"


def test_the_contexts_folder_comes_next():
    assert shared_dir(Session("spark://a:7077", "file:/own")) == "file:/own"


def test_only_local_masters_get_one_of_our_own():
    assert shared_dir(Session("local[4]")).endswith("/of-this-run")
    for master in ("spark://a:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))


def test_temporary(spark):
    assert temporary(spark, "x").startswith(shared_dir(spark))
