"""How well systems answer: cases with gold queries, reports by system and tier, and comparisons without a network."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .etl import crm
from .observe import CountingModel
from .operators import questions as Q


@dataclass(frozen=True)
class Case:
    id: str
    question: str
    gold: str
    tier: str = ""


#: A data set opens its tables as views in a session of its own.
Dataset = Callable[[SparkSession], SparkSession]
#: A system answers a case: the query and how many tries it took.
System = Callable[[Case, SparkSession], tuple[str, int]]
RESULT = "system string, case string, tier string, valid boolean, correct boolean, attempts int, calls int, ms double"


def inline(tables: dict[str, tuple[str, list[tuple]]]) -> Dataset:
    """A data set of rows given in place: name -> (schema, rows)."""

    def open_(spark: SparkSession) -> SparkSession:
        own = spark.newSession()
        for name, (schema, rows) in tables.items():
            own.createDataFrame(rows, schema).createOrReplaceTempView(name)
        return own

    return open_


def customers(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for name, df in crm.tables(own).items():
        df.createOrReplaceTempView(name)
    return own


def dataset(name: str, folder: str = "") -> Dataset:
    """`crm` (made from ids) or `films` (Parquet tables in a folder)."""
    from .session import register_folder

    if name == "crm":
        return customers
    if name == "films":

        def open_(spark: SparkSession) -> SparkSession:
            own = spark.newSession()
            register_folder(own, folder)
            return own

        return open_
    raise ValueError(f"unknown data set {name}")


def evaluate(spark: SparkSession, name: str, cases: list[Case], data: Dataset, system: System, model: CountingModel | None = None, retries: int = 1) -> DataFrame:
    """One row a case.  A system runs in one fresh session and is scored in another; a case that raises is tried once more."""
    rows = []
    for c in cases:
        calls, start, sql, attempts = (model.calls if model else 0), time.perf_counter(), "", 0
        for _ in range(retries + 1):
            try:
                sql, attempts = system(c, data(spark))
                break
            except Exception:  # noqa: BLE001  a case that fails counts as invalid
                continue
        ms = 1000 * (time.perf_counter() - start)
        fresh = data(spark)
        valid, right = Q.score(fresh.sql, c.gold, sql) if sql else (False, False)
        rows.append((name, c.id, c.tier, valid, right, attempts, (model.calls if model else 0) - calls, ms))
    return spark.createDataFrame(rows, RESULT)


def report(results: DataFrame, *by: str) -> DataFrame:
    """Rates by system (and more columns): n, valid_rate, accuracy, attempts, calls and ms a case."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    keys = by or ("system",)
    return results.groupBy(*keys).agg(F.count("*").alias("n"), rate("valid").alias("valid_rate"), rate("correct").alias("accuracy"), F.avg("attempts").alias("attempts"), F.avg("calls").alias("calls"), F.avg("ms").alias("ms")).orderBy(*keys)


def ladder(spark: SparkSession, cases: list[Case], data: Dataset, layer: Q.Layer, make_model: Callable[[], Callable[[str], str]], links: Callable[[SparkSession, str], list[str]] | None = None) -> DataFrame:
    """Results of five systems, each with one thing more: schema only, semantic layer, value links, plan and votes, critic."""
    names = ", ".join(t.name for t in layer.tables)
    rungs = {
        "baseline": {"context": False, "links": False, "candidates": 1, "corrections": 0},
        "+semantic": {"context": True, "links": False, "candidates": 1, "corrections": 0},
        "+value-link": {"context": True, "links": True, "candidates": 1, "corrections": 0},
        "+plan/votes": {"context": True, "links": True, "candidates": 3, "corrections": 0},
        "grounded": {"context": True, "links": True, "candidates": 3, "corrections": 2},
    }
    out = None
    for name, s in rungs.items():
        model = CountingModel(make_model())

        def system(case: Case, own: SparkSession, s=s, model=model) -> tuple[str, int]:
            before = model.calls
            hints = (lambda q: links(own, q)) if s["links"] and links else None
            got = Q.answer_sql(case.question, model, own.sql, own, layer.context(case.question) if s["context"] else names, s["candidates"], s["corrections"], hints)
            return got.sql, model.calls - before

        one = evaluate(spark, name, cases, data, system, model)
        out = one if out is None else out.union(one)
    return out


def routing_accuracy(cases: list[tuple[str, str]]) -> float:
    """Share of (question, path) pairs that the router gets right."""
    return sum(Q.route(q) == want for q, want in cases) / len(cases)
