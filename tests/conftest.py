import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from basalt.session import builder

    b = builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    b = b.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.local.dir", str(tmp_path_factory.mktemp("local"))).config("spark.driver.host", "127.0.0.1")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
