"""Tables of the run, and intermediate tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        there = tempfile.mkdtemp(prefix="ledgerline-code-")  # the driver serves it as long as it runs
        atexit.register(shutil.rmtree, there, True)
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(there, "ledgerline"), "zip", os.path.dirname(root), os.path.basename(root)))
        _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only local mode, where all is one machine, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ledgerline-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledgerline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written before can't be read after."""
    delete(spark, _application_folder(spark))


def materialize(df: DataFrame, by: str | None = None, **counts: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors.

    by: column whose values get folders of their own, so that a reader of one value skips the others.
    counts: SQL aggregates that are taken while it is written; counted() gives them.
    """
    path, seen = new_path(df.sparkSession), Observation() if counts else None
    writer = (df.observe(seen, *[F.expr(c).alias(n) for n, c in counts.items()]) if seen else df).write
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerline_path, out._ledgerline_counts = path, seen.get if seen else {}
    return out


def counted(df: DataFrame) -> dict[str, int]:
    """The aggregates of a table that materialize() wrote."""
    return df._ledgerline_counts


def together(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables of one schema that materialize() wrote, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._ledgerline_path for t in tables])


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "_ledgerline_path", None)
    if path:
        delete(df.sparkSession, path)
