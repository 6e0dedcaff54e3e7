import tempfile

import pytest

from saltmarsh.session import session


@pytest.fixture(scope="session")
def spark():
    own = session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="saltmarsh-tests-")}
    )
    own.sparkContext.setLogLevel("OFF")
    yield own
    own.stop()
