import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("GRAPHLOOM_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graphloom.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
