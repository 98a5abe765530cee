import os

from quire.functions import stages


def test_written_tables_are_read_again_and_dropped_with_the_session(spark):
    made = stages.written(spark.range(5).selectExpr("id", "cast(id as string) s"))
    assert made.count() == 5 and made.columns == ["id", "s"]
    folder = stages._WRITTEN[spark.sparkContext.applicationId][-1]
    assert stages.written(spark.range(0)).count() == 0
    stages.drop_written(spark)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_small_sides_are_measured_in_rows_and_bytes(spark):
    rows = spark.range(10).selectExpr("id", "repeat('x', 1000) s", "array(id, null) a")
    assert stages.is_small(rows) and not stages.is_small(rows, rows=9) and not stages.is_small(rows, size=9_000)
    assert stages.is_small(rows.limit(0), rows=0)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
            getConf = staticmethod(lambda: {})  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    try:
        stages.shared_folder(Session)
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a machine-local folder was taken")
