"""Session helpers: shipping this package to Python workers and cutting lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_PARENT = str(Path(__file__).resolve().parents[2])

#: Paths of scratch tables that results may still read.
_scratch: list[str] = []


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout.

    An installed package, or one sent with ``--py-files``, needs nothing; the
    extra path entry does no harm there.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_PARENT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_PARENT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A session on one machine that names none uses a folder of its warehouse; on
    a cluster that is an error, for nothing else tells what is shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")


def write_table(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors: later jobs
    read files, not the plan that made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def write_bucketed(df: DataFrame, what: str, buckets: int, by: list[str]) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df`` in the shared folder bucketed and sorted by columns, and read it; also a function that removes it.

    Joins and groups by these columns read it without a shuffle or a sort.
    """
    spark = df.sparkSession
    name = f"{what}-{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_folder(spark)}/{name}"
    _scratch.append(path)
    spread = df.repartition(buckets, *by)
    spread.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table._written_at = path

    def forget() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_table(table)

    return table, forget


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`write_table` that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove the files at a path of :func:`scratch_path` that nothing reads any more."""
    _delete(spark, path)
    if path in _scratch:
        _scratch.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this process: results of queries made so far cannot be read after this."""
    while _scratch:
        _delete(spark, _scratch.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_sized(df: DataFrame, side: DataFrame, on: list[str], how: str = "left", most: int = 50_000) -> DataFrame:
    """Join with ``side`` broadcast when a count proves it small, else shuffled.

    ``side`` should be a written table or cheap to count. Beyond ``most`` rows
    the plain join leaves the choice, and skewed keys, to adaptive execution.
    """
    from pyspark.sql import functions as F

    small = side.limit(most + 1).count() <= most
    return df.join(F.broadcast(side) if small else side, on, how)
