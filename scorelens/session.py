"""Session defaults for tests and the bench, and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "scorelens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of this process where one machine is the cluster."""
    folder = spark.conf.get(SCRATCH_CONF, None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").partition("[")[0] == "local":
        raise ValueError(f"set {SCRATCH_CONF} to a folder that every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    """Removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="scorelens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes what is written to the shared folder inside, at the end; what results still read must be written elsewhere before."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete(spark, path)


_written: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/scorelens-{name}-{uuid.uuid4().hex}"
    for paths in _written[-1:]:
        paths.append(path)
    return path


def write_once(df: DataFrame, name: str) -> str:
    """Write the frame to the shared folder; the path of the copy."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    For frames that several fits read. The copy is columnar, its lineage ends
    at the files, and losing an executor costs a re-read, not a recomputation.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_once(df, name))
