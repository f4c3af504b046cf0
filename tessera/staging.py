"""Tables written to the cluster's shared folder, so that lineage is cut and a lost executor costs nothing.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is
unset, as in tests, a folder of this process's own is made and registered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; ``drop_staged`` deletes what is written there."""
    path = f"{shared_folder(spark).rstrip('/')}/tessera/{uuid.uuid4().hex}-{label}"
    _written.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the reader of what was written; what was shuffled for it is deleted at once, not when the driver next collects garbage."""
    path, conf = folder(df.sparkSession, label), df.sparkSession.conf
    old = conf.get(_CLEANED, None)
    conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANED, old) if old is not None else conf.unset(_CLEANED)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete every table staged by this process. Call it when all results have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _written:
        where = jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(conf).delete(where, True)
        n += 1
    return n
