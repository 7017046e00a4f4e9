import pytest

from sentinela.llm.common import shared_folder


class Session:
    """A session with a master and, perhaps, the setting."""

    def __init__(self, master, folder=None):
        settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master, "getConf": lambda _: settings})()


def test_shared_folders():
    assert shared_folder(Session("spark://m:7077", "hdfs://shared/x")) == "hdfs://shared/x"
    own = Session("local[4]")
    assert shared_folder(own) == shared_folder(own) != shared_folder(Session("local[2]"))
    for master in ("spark://m:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_folder(Session(master))
