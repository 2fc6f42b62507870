"""Text functions as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import reach_workers

#: Words that carry no meaning of their own in a question about entities.
STOP = frozenset("a an the of in on at to for by with and or is are was were be do does did which who whom whose what when where how many much all any it its this that these those from as".split())


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def normal(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def spans(words: Column, most: int = 6) -> Column:
    """Structs (i, n, text) of all runs of up to `most` words."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("text")))).otherwise(F.expr("cast(array() as array<struct<i:int,n:int,text:string>>)"))))


def atoms(c: Column) -> Column:
    """Values of a multi-valued cell: split at , ; or |, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def json_names(c: Column) -> Column:
    """A JSON array of strings; null for bad JSON; empty strings are dropped."""
    return F.filter(F.from_json(c, "array<string>"), lambda x: x != "")


def csv_safe(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


#: The marks of wiki text that open, close or part something, and the spans that hold no text.
MARKS = re.compile(r"(\{\{|\}\}|\{\||\|\}|\[\[|\]\]|\||<!--.*?(?:-->|\Z)|<ref\b[^>]*?/>|<ref\b.*?(?:</ref\s*>|\Z)|</?[a-z][^>]*>|'{2,5})", re.S | re.I)
PAIRS = {"}}": "{{", "|}": "{|", "]]": "[["}
#: Links into these name spaces show no text.
UNSHOWN = re.compile(r"\s*(?:file|image|category)\s*:", re.I)
OUTER_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]\n]*)\]")


def wiki_text(markup: str | None) -> str | None:
    """The text that wiki markup shows.

    Templates and tables vanish with all that is nested in them, links leave
    their last part, files and categories nothing; references, comments, tags
    and quote marks go.  What is never closed leaves its text.
    """
    if markup is None:
        return None
    open_: list[tuple[str, list[str]]] = [("", [""])]  # the mark, and the parts between bars

    def close(shown: str) -> None:
        open_.pop()
        open_[-1][1][-1] += shown

    for k, piece in enumerate(MARKS.split(markup)):
        mark, parts = open_[-1]
        if k % 2 == 0:
            parts[-1] += piece
        elif piece in ("{{", "{|", "[["):
            open_.append((piece, [""]))
        elif piece in PAIRS:
            if any(m == PAIRS[piece] for m, _ in open_):
                while open_[-1][0] != PAIRS[piece]:  # left open inside
                    close("".join(open_[-1][1]))
                mark, parts = open_[-1]
                close("" if mark != "[[" or UNSHOWN.match(parts[0]) else parts[-1])
            elif piece == "|}":
                parts[-1] += "}"
        elif piece == "|":
            if mark:
                parts.append("")
            else:
                parts[-1] += piece
    while len(open_) > 1:
        close("".join(open_[-1][1]))
    text = OUTER_LINK.sub(r"\1", open_[0][1][0])
    return re.sub(r"\n\s*\n\s*", "\n\n", text).strip()


def strip_wikitext(c: Column) -> Column:
    """wiki_text of a column; nesting needs a stack, so this is an Arrow batch function."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(wiki_text, na_action="ignore")

    reach_workers(SparkSession.active())
    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(c)


def section(c: Column, names: tuple[str, ...] = ("Plot", "Synopsis")) -> Column:
    """Body of the first section with one of the names, in any case and at any level, up to the next heading ('' if none)."""
    return F.btrim(F.regexp_extract(c, rf"(?msi)^==+[ \t]*(?:{'|'.join(names)})[ \t]*==+[ \t]*$(.*?)(?=^==+[^\n]*==+[ \t]*$|\z)", 1), F.lit(" \t\r\n"))


def triple_lines(c: Column, relations: tuple[str, ...]) -> Column:
    """(subject, relation, object) of lines 's | r | o' with three parts and a listed relation."""
    parts = F.transform(F.split(c, "\n"), lambda x: F.transform(F.split(x, "\\|"), lambda y: F.trim(y)))
    good = F.filter(parts, lambda p: (F.size(p) == 3) & (F.size(F.filter(p, lambda y: y == "")) == 0) & F.get(p, 1).isin(*relations))
    return F.transform(good, lambda p: F.struct(F.get(p, 0).alias("subject"), F.get(p, 1).alias("relation"), F.get(p, 2).alias("object")))
