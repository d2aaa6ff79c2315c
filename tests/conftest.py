import pytest

from treeloom.session import build, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build("local[4]", "tests", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
