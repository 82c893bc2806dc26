import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from arborlake.session import local_session

    session = local_session("4", "4g", 2)
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny tables: compiling costs more than it saves
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
