from types import SimpleNamespace

import pytest

from lexiloom.llm import storage


def frame(master, folder=None, setting=None):
    found = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=found.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: setting))
    return SimpleNamespace(sparkSession=session, checkpoint=lambda: found), found


def test_only_a_local_session_checkpoints_into_a_folder_of_its_own():
    for master in ("local", "local[8]", "local[*]"):
        df, found = frame(master)
        assert storage.checkpoint(df) == found and len(found) == 1
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError):
            storage.checkpoint(frame(master)[0])
        assert storage.checkpoint(frame(master, setting="/shared")[0]) == ["/shared"]
        assert storage.checkpoint(frame(master, folder="/there")[0]) == []
