"""Texts for the best-known films from outside sources, which are passed in as functions (nothing here opens a connection)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import section, strip_wikitext
from ..session import reach_workers

#: Answers of a server after which asking again makes sense.
PASSING = frozenset({429, 500, 502, 503, 504})


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retry(ask: Callable[[], object], attempts: int = 4, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """ask() again after a lost connection or a passing status, each time after twice the wait."""
    for k in range(attempts):
        try:
            return ask()
        except (OSError, HttpError) as e:
            if k == attempts - 1 or (isinstance(e, HttpError) and e.status not in PASSING):
                raise
            sleep(backoff * 2**k)


def bridge(ids: DataFrame, ask: Callable[[list[str]], dict[str, str]], batch: int = 200) -> DataFrame:
    """id, other: what `ask` knows of the ids in `ids`, asked in batches on the executors; a failing batch is left out."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = f["id"].tolist()
            for i in range(0, len(known), batch):
                try:
                    got = ask(known[i : i + batch])
                except Exception:  # noqa: BLE001  one batch must not end the others
                    continue
                yield pd.DataFrame({"id": list(got), "other": list(got.values())}, dtype=object)

    reach_workers(ids.sparkSession)
    return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct().mapInPandas(run, "id string, other string")


def fetch(pages: DataFrame, ask: Callable[[str], str], attempts: int = 4) -> DataFrame:
    """id, markup: the page of each row (id, page); pages that fail or are missing are left out."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, page in zip(f["id"], f["page"]):
                try:
                    rows.append((key, retry(lambda p=page: ask(p), attempts, 0.0)))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["id", "markup"], dtype=object)

    reach_workers(pages.sparkSession)
    return pages.select("id", "page").mapInPandas(run, "id string, markup string")


def plots(markup: DataFrame) -> DataFrame:
    """id, text: the plot sections of wiki pages as plain text; pages without one are left out."""
    return markup.select("id", strip_wikitext(section(F.col("markup"))).alias("text")).where("text <> ''")


def select_documents(basics: DataFrame, ratings: DataFrame, most: int, ask: Callable[[str], str | None], kinds: tuple[str, ...] = ("movie",)) -> DataFrame:
    """id, title, text of the `most` best-voted titles for which `ask` has a text; failures are left out."""
    top = basics.where(F.col("titleType").isin(*kinds)).join(ratings, "tconst").orderBy(F.desc("numVotes"), "tconst").limit(most)
    top = top.select(F.col("tconst").alias("id"), F.col("primaryTitle").alias("title"), F.col("tconst").alias("page"))
    return top.join(fetch(top, ask), "id").select("id", "title", F.col("markup").alias("text"))
