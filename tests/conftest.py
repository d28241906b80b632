import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from terrametric.session import builder

    shared = tmp_path_factory.mktemp("shared")
    s = builder("local[2]", 4).config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
