"""Answers from a graph: capped rows, cited sentences, and a model's wording of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import graph as G
from .questions import GRAPH_HINTS, Answer, words

MOST_ROWS, MOST_FACTS = 200, 40
EMPTY = "No connected facts were found."


def can_handle(t: DataFrame, question: str, o: G.Ontology, hints: frozenset[str] = GRAPH_HINTS) -> bool:
    """A question with a hint word, or one that names an entity."""
    return bool(words(question) & hints) or not G.seeds_by_spans(G.entities(t, o), question, 1).isEmpty()


def sentences(rows: list, shown: int, inferred: frozenset[str] = frozenset()) -> str:
    """One line a fact with its source; facts of `inferred` sources prefixes are marked; says how many were left out."""
    lines = [f"{r.subject} {r.relation} {r.object} [{r.source}]" + (" (model-inferred)" if str(r.source).split(":")[0] in inferred else "") for r in rows[:shown]]
    if len(rows) > shown:
        lines.append(f"({len(rows) - shown} more facts are not shown)")
    return "\n".join(lines)


def answer(found: DataFrame, shown: int = MOST_FACTS, inferred: frozenset[str] = frozenset(), empty: str = EMPTY) -> Answer:
    """Up to MOST_ROWS triples and their sentences; no result if there is none."""
    rows = found.select(*G.TRIPLE).limit(MOST_ROWS).collect()
    if not rows:
        return Answer("graph", None, "", empty)
    return Answer("graph", found.sparkSession.createDataFrame(rows, found.select(*G.TRIPLE).schema), "", sentences(rows, shown, inferred))


def grounded(base: Answer, question: str, model: Callable[[str], str], budget: int = MOST_FACTS) -> Answer:
    """The model's answer from at most `budget` facts; an empty answer costs no call."""
    if base.result is None:
        return base
    facts = sentences(base.result.limit(budget).collect(), budget)
    said = model(f"Answer from these facts only and cite their sources.\n{facts}\nQuestion: {question}").strip()
    return Answer(base.path, base.result, base.sql, said or base.narrative, base.chart)
