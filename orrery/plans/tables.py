"""Tables written on the way: they cut the lineage of long plans and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, what: str) -> str:
    """The URI of a new folder under spark.checkpoint.dir, which the driver and all executors see.

    Only where that setting is absent (single-machine tests) a temporary folder of this process is
    used, and removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
            atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query inside is removed from the disks when the query ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and written as a table in the shared folder."""
    path = shared_dir(df.sparkSession, what)
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
