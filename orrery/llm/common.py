"""What the corpus operators share: Arrow batches, files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from orrery.plans.tables import shared_dir, written  # noqa: F401  for the operators here

#: Rows that an Arrow batch holds at most, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 512
#: Bytes after which a batch ends (it holds one row at least).
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES in this session, unless it asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column text holds about that many bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)


def shared_files(spark: SparkSession, what: str) -> str:
    """A new folder for files, made at once, so that it can be read even if nothing is written there."""
    uri = shared_dir(spark, what)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


def put_file(uri: str, name: str, data: bytes) -> str:
    """Writes data as uri/name through the store's own client, under another name first; returns name."""
    store, folder = pafs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{name}.part") as out:
        out.write(data)
    store.move(f"{folder}/.{name}.part", f"{folder}/{name}")
    return name


def fixed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
