import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cinderlog import configure  # noqa: E402
from cinderlog.operators import events  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def lines(spark):
    """Frame of raw lines; each argument is a list of lines of one incident."""

    def make(**incidents):
        rows = [
            (name, number, text)
            for name, texts in incidents.items()
            for number, text in enumerate(texts, start=1)
        ]
        return spark.createDataFrame(
            rows, "incident_id string, line_number long, raw_line string"
        )

    return make


@pytest.fixture
def events_of(lines):
    def make(**incidents):
        return events.events_of(events.parse_lines(lines(**incidents)))

    return make


@pytest.fixture
def frame(spark):
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make
