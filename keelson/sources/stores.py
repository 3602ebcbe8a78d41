"""Stores that Python tasks open themselves (file sink, frame segments).

Spark's readers reach any Hadoop file system; a Python task has no JVM at
hand and goes through pyarrow's file systems. A path is first qualified by the
driver, so that one without a scheme means the cluster's default file system,
as it does for Spark's readers, and not the disk of whichever machine runs the
task."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import SparkSession

#: Hadoop's names of stores -> pyarrow's.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualify(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark's readers would use."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def open_store(uri: str):
    """(pyarrow file system, path in it) of a qualified path."""
    from pyarrow import fs

    scheme = urlsplit(uri).scheme
    if scheme not in SCHEMES:
        raise ValueError(f"Python tasks can't open {scheme or 'an unqualified path'} ({uri}); use one of {', '.join(SCHEMES)}")
    if scheme == "file":
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(SCHEMES[scheme] + uri[len(scheme):])
