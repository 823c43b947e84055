import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.session import build_session  # noqa: E402
from workload.scratch import ensure_shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    ensure_shared_folder(session)
    return session


@pytest.fixture
def evaluate(spark):
    """Value of an SQL expression over a column `text` for each of the given texts."""
    def run(expression, texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, text string")
        return [r[0] for r in df.orderBy("i").selectExpr(f"{expression} AS v").collect()]

    return run
