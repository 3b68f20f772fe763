import pytest

from stayline.sources import scratch


@pytest.mark.parametrize(
    "context, setting, expected", [("file:/c", "file:/s/", "file:/c"), (None, "file:/s/", "file:/s"), (None, None, "/warehouse")]
)
def test_the_shared_folder(context, setting, expected):
    class Session:
        class conf:
            @staticmethod
            def get(name, *default):
                return setting if name == "spark.checkpoint.dir" else "/warehouse"

        class sparkContext:
            applicationId = "app"
            getCheckpointDir = staticmethod(lambda: context)

    assert scratch.folder(Session) == f"{expected}/stayline-app"
    assert scratch.path(Session, "a") != scratch.path(Session, "a")


def test_a_warehouse_on_one_machine_is_refused_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(name, *default):
                return None if name == "spark.checkpoint.dir" else "file:/home/me/spark-warehouse"

        class sparkContext:
            applicationId, master = "app", "local[2]"
            getCheckpointDir = staticmethod(lambda: None)

    assert scratch.folder(Session) == "file:/home/me/spark-warehouse/stayline-app"
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(Session)


def test_written_table_keeps_rows_and_types(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "folder", lambda _: f"{tmp_path}/tables")
    df = spark.sql("SELECT id, CAST(id AS DECIMAL(10,2)) AS d, CAST(NULL AS STRING) AS s FROM range(5)")
    table = scratch.table(df, "five")
    assert table.dtypes == df.dtypes and sorted(table.collect()) == sorted(df.collect())
    assert (tmp_path / "tables").exists()
    scratch.clear(spark)
    assert not (tmp_path / "tables").exists()
