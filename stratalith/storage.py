"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from contextlib import suppress
from typing import Any

from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster
    session is refused, as its executors would not see a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        folder = tempfile.mkdtemp(prefix="stratalith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[key] = "file://" + folder
    return _OWN[key]


#: By application: its folder of written tables, and what deletes it.
_TABLES: dict[str, tuple[str, Any]] = {}


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables, deleted by ``release`` or at the end of the process."""
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        folder = f"{scratch_dir(spark)}/stratalith-{key}"
        _TABLES[key] = (folder, _deleter(spark, folder))
        atexit.register(_forget, key)
    return _TABLES[key][0]


def _deleter(spark: SparkSession, folder: str):
    """Deletes the folder by the file system that Spark writes it with, the session being stopped or not."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete() -> None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)

    return delete


def _forget(key: str) -> None:
    if key in _TABLES:
        with suppress(Py4JError, OSError):  # the driver's JVM is gone already
            _TABLES.pop(key)[1]()


def release(spark: SparkSession) -> None:
    """Deletes all tables that ``materialize`` has written for this application; what reads them can't be run any more."""
    _forget(spark.sparkContext.applicationId)


#: Rows of a narrow table that one file holds.
ROWS_PER_FILE = 65_536


def materialize(df: DataFrame, label: str, at_most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor then costs a re-read, not a recomputation, and a table that
    several later steps use is computed once. ``at_most``, a bound on the rows of a
    narrow table, keeps a small one from being written as many tiny files.
    """
    spark = df.sparkSession
    if at_most is not None:
        df = df.coalesce(max(1, -(-at_most // ROWS_PER_FILE)))
    path = f"{tables_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast whose classes travel with it: executors need not have this package."""

    def __init__(self, spark: SparkSession, value: Any):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        return pickle.loads(self._sent.value)

    def drop(self) -> None:
        self._sent.unpersist()
