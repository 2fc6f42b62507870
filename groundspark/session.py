"""Sessions and table registration."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "groundspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that governed SQL relies on, the same in every session derived from it."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.adaptive.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])


def scratch(spark: SparkSession, name: str) -> str:
    """A path for tables of this application: in the shared folder that the cluster names, or in a folder of its own if all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(scratch, "own", None) or tempfile.mkdtemp(prefix="groundspark-")
        scratch.own = found
    path = f"{found.rstrip('/')}/{spark.sparkContext.applicationId}-{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def sql_session(spark: SparkSession) -> SparkSession:
    """A session of its own that reads "name" as a column, as the SQL standard does."""
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", "true")
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    return own


def view_name(stem: str) -> str:
    return re.sub(r"\W", "_", stem)


def open_tables(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """A session of its own in which the named Parquet tables of a folder are temporary views."""
    own = sql_session(spark)
    for n in names:
        own.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(view_name(n))
    return own


def register_folder(spark: SparkSession, folder: str) -> list[str]:
    """A view for every Parquet file or folder directly in `folder` (any file system Spark reads), in order of name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found if f.getPath().getName().endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{folder}/{n}").createOrReplaceTempView(view_name(os.path.splitext(n)[0]))
    return [view_name(os.path.splitext(n)[0]) for n in names]


def list_tables(spark: SparkSession) -> dict[str, list[tuple[str, str]]]:
    """Temporary views with their columns and types."""
    return {t.name: [(f.name, f.dataType.simpleString()) for f in spark.table(t.name).schema] for t in spark.catalog.listTables() if t.isTemporary}


def schema_context(spark: SparkSession) -> str:
    return "\n".join(f"- {t}({', '.join(f'{c} {k.upper()}' for c, k in cols)})" for t, cols in sorted(list_tables(spark).items()))


def values(spark: SparkSession, name: str, schema: str, rows: list[tuple]) -> DataFrame:
    """An inline table as a view."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df
