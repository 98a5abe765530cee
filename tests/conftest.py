import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


PAGES = "user_id string, doc_id string, number int, width double, height double, title string, text string, language string"


@pytest.fixture
def make_pages(spark):
    """Pages of one document from a list of texts, or rows of (doc_id, number, text)."""

    def make(texts, doc="d"):
        rows = [("u", doc, i, 595.0, 842.0, None, t, "en") if not isinstance(t, tuple) else ("u", t[0], t[1], 595.0, 842.0, None, t[2], "en") for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, PAGES)

    return make
