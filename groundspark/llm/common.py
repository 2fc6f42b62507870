"""Helpers shared by the corpus operators.

Conventions for every operator here:

* Input columns are taken by exact name and position (:func:`pick`), so extra
  columns, even ones that differ only in case or clash with an output name,
  have no effect.
* A null text counts as an empty one.  A null ``doc_id`` is a value of its own
  that sorts before all others.
* Rows that share ``doc_id`` and text are one document that is listed twice:
  they get equal decisions.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
ASCII_SPACE = " \t\n\x0b\f\r"
#: A Python worker handles about this many bytes of text at a time.
CHUNK_BYTES = 4 << 20


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless it is installed (or sent by --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, each the first with exactly that name."""
    at = {n: df.columns.index(n) for n in names}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(n) for n, i in at.items()])


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text, with '' for a null text."""
    reach_workers(df.sparkSession)
    d = pick(df, "doc_id", "text")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def row_key() -> Column:
    """Hash of the text; with doc_id it names a document."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only if it names none and all runs on this machine, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="groundspark-")
        shared_dir.own = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df cut from its lineage by a Parquet table in the shared folder, and the table's path."""
    path, names = new_path(df.sparkSession, name), df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*names), path


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that no variable holds any more, now rather than at some later collection."""
    for _ in range(2):  # handles of JVM objects are given back with a delay
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the column; one row is the least."""
    start = size = 0
    col = batch.column(batch.schema.get_field_index(column))
    for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
        n = n or 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def worker_file(blob: bytes) -> str:
    """blob in a file of this worker's own temporary folder, for mapping into memory."""
    fd, path = tempfile.mkstemp(prefix="groundspark-")
    with os.fdopen(fd, "wb") as f:
        f.write(blob)
    return path
