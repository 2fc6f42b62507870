"""Triples read out of documents by a model that is passed in, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from . import graph as G


def prompt(text: str, ontology: G.Ontology) -> str:
    return "\n".join(["Read the facts out of the text, one a line: subject | relation | object.", "Relations: " + ", ".join(sorted(ontology.relations)), "Text:", text])


def facts(reply: str, relations: frozenset[str]) -> list[tuple[str, str, str]]:
    """Lines of three parts, none empty, with a relation of the ontology; each fact once."""
    rows = ([p.strip() for p in line.lstrip("-* \t").split("|")] for line in reply.split("\n"))
    return list(dict.fromkeys((s, r, o) for s, r, o in (p for p in rows if len(p) == 3) if s and o and r in relations))


def only(ontology: G.Ontology, relations: frozenset[str]) -> G.Ontology:
    """The ontology restricted to some relations."""
    kept = ontology.relations & relations
    intents = tuple(replace(i, targets=i.targets & kept) for i in ontology.intents if i.targets & kept)
    return replace(ontology, relations=kept, attributes=ontology.attributes & kept, connective=ontology.connective & kept, intents=intents)


def extract(docs: DataFrame, ontology: G.Ontology, model: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """Triples of (id, text) rows; the id is the source.  A document whose calls all fail is left out, the others stay."""
    relations = ontology.relations

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, text in zip(f["id"], f["text"]):
                for _ in range(attempts):
                    try:
                        out += [(s, r, o, key) for s, r, o in facts(model(prompt(text or "", ontology)), relations)]
                        break
                    except Exception:  # noqa: BLE001  one document must not end the others
                        continue
            yield pd.DataFrame(out, columns=list(G.TRIPLE), dtype=object)

    reach_workers(docs.sparkSession)
    d = docs.select(F.col("id").cast("string").alias("id"), "text")
    return d.mapInPandas(run, "subject string, relation string, object string, source string")


def build(docs: DataFrame, ontology: G.Ontology, model: Callable[[str], str], path: str, most_calls: int | None = None, attempts: int = 3) -> int:
    """Extracts, writes JSON lines and returns how many; most_calls bounds the documents asked about, in order of id.

    Tasks run side by side; a lost task is run again and its part written once.
    """
    d = docs if most_calls is None else docs.orderBy("id").limit(most_calls)
    return G.write_triples(extract(d, ontology, model, attempts), path)
