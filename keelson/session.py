"""Session construction and lineage control."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every keelson job wants. AQE re-plans joins at runtime from real
# shuffle sizes (broadcast only when the measured side is small, skew-join
# splitting for hot keys); UTC keeps timestamps identical across engines.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "keelson",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with keelson's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (roughly input bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only a local
    session (one machine, one process) may leave it unset: it gets a fresh
    scratch folder. On a cluster executors would write to disks of their own
    and later reads would miss those files, so there an unset folder is an
    error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="keelson-ckpt-", dir=os.environ.get("KEELSON_SCRATCH"))
    sc.setCheckpointDir(configured)
    return configured


@contextmanager
def held(spark: SparkSession, conf: dict[str, object]) -> Iterator[None]:
    """Session settings for the listings and jobs that run within the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For :func:`held` around phases that end in cut_lineage: a job's shuffle files go when it ends, not when the driver
#: happens to collect its garbage; what the next phase needs is in a table.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Tables that cut_lineage wrote in this process, by application.
_CUTS: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back, so a lost executor
    recomputes from here, not from the scan, and non-deterministic columns
    (partition ids, row ids) are frozen. One write pass; unlike
    ``Dataset.checkpoint`` the plan is not evaluated twice."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/keelson-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_cuts(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut_lineage` wrote in this application;
    call it when no DataFrame that reads them is in use. Returns their number."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def release_cut(df: DataFrame) -> None:
    """Delete the table of a DataFrame that :func:`cut_lineage` returned, once
    nothing reads it any more."""
    spark = df.sparkSession
    known = _CUTS.get(spark.sparkContext.applicationId, [])
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in known if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            known.remove(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``keelson`` importable in the Python workers (the ``--py-files``
    of spark-submit): zip the package once per application and add it."""
    import zipfile
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="keelson-pyfiles-"), "keelson.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))
