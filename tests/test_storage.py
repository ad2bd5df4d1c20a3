import os
import pytest

from stratalith import storage


def test_tables_come_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, t string")
    back = storage.materialize(df, "t", 2)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)] and back.schema == df.schema
    empty = storage.materialize(df.limit(0), "t")
    assert empty.collect() == [] and empty.columns == df.columns


def test_the_named_folder_is_used():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: "hdfs://x/shared/" if k == "spark.checkpoint.dir" else d)})()

    assert storage.scratch_dir(Session()) == "hdfs://x/shared"


def test_a_cluster_without_a_folder_is_refused():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d: d)})(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.scratch_dir(Session())


def test_shared_values_travel_with_their_classes(spark):
    sent = storage.Shared(spark, {"a": 1})
    assert sent.value == {"a": 1}
    sent.drop()


def test_released_tables_are_gone(spark, tmp_path):
    from stratalith import storage

    made = storage.materialize(spark.range(5), "five")
    folder = storage.tables_dir(spark).removeprefix("file://")
    assert made.count() == 5 and os.listdir(folder)
    storage.release(spark)
    assert not os.path.exists(folder)
    assert storage.materialize(spark.range(3), "three").count() == 3
