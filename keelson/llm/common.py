"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: A word: a run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"

#: Removes a query's shuffle files when that query ends; what the next phase
#: needs was written to a table in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Session needs of every operator here: shared folder, package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the eager part of an operator; put back after it."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back. Later
    work, and the recovery from a lost executor, start from that table; the
    shuffle files behind it are no longer needed and are removed."""
    spark = df.sparkSession
    with settings(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        return cut_lineage(df)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
