"""Question understanding: schema choice, value links, routing, candidate votes, critique and scoring."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .sqlguard import Analysis, GuardError, analyze

WORD = re.compile(r"[a-z0-9]+")
RANKING = re.compile(r"\b(top|highest|lowest|most|least|best|worst)\b", re.I)
#: Hints of the router.
SQL_HINTS = frozenset("how many count average avg total sum number top highest lowest most least per year list compare".split())
GRAPH_HINTS = frozenset("related connected between similar path both shared common supplies supplier linked relationship theme".split())


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def names_in(question: str) -> list[str]:
    """Phrases of a question that may name something: runs of words that begin with a capital or a digit inside such a run.

    A word's capital may be of any script.  Punctuation behind a word ends the
    run, as does a word that begins small; words that carry no meaning of their
    own don't begin a phrase.
    """
    found: list[list[str]] = []
    going = False
    for raw in question.split():
        word = raw.strip(".,;:!?()[]\"“”„«»")
        named = bool(word) and (word[0].isupper() or (going and word[0].isdigit()))
        if named and not going and word.lower() in T.STOP:
            named = False
        if named:
            if going:
                found[-1].append(word)
            else:
                found.append([word])
        going = named and raw.endswith(word)
    return list(dict.fromkeys(" ".join(p) for p in found))


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str = "string"
    description: str = ""
    link: str = ""  # '', categorical, entity or auto


@dataclass(frozen=True)
class TableDef:
    name: str
    description: str
    columns: tuple[ColumnDef, ...] = ()


@dataclass(frozen=True)
class Layer:
    tables: tuple[TableDef, ...]
    metrics: dict[str, str] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    examples: tuple[tuple[str, str], ...] = ()

    def expand(self, question: str) -> set[str]:
        """The question's words, with the words of every synonym whose phrase occurs in it."""
        q, line = words(question), " ".join(WORD.findall(question.lower()))
        for phrase, meaning in self.synonyms.items():
            if f" {phrase.lower()} " in f" {line} ":
                q |= words(meaning)
        return q

    def select(self, question: str, examples: int = 3) -> tuple[list[TableDef], list[tuple[str, str]]]:
        """Tables with a word in common (all if none has), best first, and up to `examples` similar examples."""
        q = self.expand(question)
        scored = [(-len(words(" ".join([t.name, t.description, *[f"{c.name} {c.description}" for c in t.columns]]).replace("_", " ")) & q), i, t) for i, t in enumerate(self.tables)]
        kept = [t for s, _, t in sorted(scored, key=lambda x: x[:2]) if s] or list(self.tables)
        shots = sorted((-len(words(a) & q), i, (a, b)) for i, (a, b) in enumerate(self.examples))
        return kept, [x for s, _, x in shots if s][:examples] or list(self.examples[:examples])

    def context(self, question: str) -> str:
        tables, shots = self.select(question)
        out = ["Tables"] + [f"- {t.name}: {t.description} ({', '.join(c.name for c in t.columns)})" for t in tables]
        out += ["Metrics"] + [f"- {k} = {v}" for k, v in self.metrics.items()] if self.metrics else []
        out += ["Synonyms"] + [f"- {k}: {v}" for k, v in self.synonyms.items()] if self.synonyms else []
        return "\n".join(out + (["Examples"] + [f"- {a} -> {b}" for a, b in shots] if shots else []))

    def governed(self, visible: Callable[[str, str], bool]) -> Layer:
        """Without tables and columns that aren't visible, and without any text that names them."""
        tables = tuple(TableDef(t.name, t.description, tuple(c for c in t.columns if visible(t.name, c.name))) for t in self.tables)
        tables = tuple(t for t in tables if t.columns)
        shown = {t.name for t in tables} | {c.name for t in tables for c in t.columns}
        hidden = ({t.name for t in self.tables} | {c.name for t in self.tables for c in t.columns}) - shown
        clean = lambda s: not any(re.search(rf"\b{re.escape(h)}\b", s, re.I) for h in hidden)
        return Layer(tables, {k: v for k, v in self.metrics.items() if clean(k) and clean(v)}, {k: v for k, v in self.synonyms.items() if clean(v)}, tuple(x for x in self.examples if clean(x[0]) and clean(x[1])))


def value_atoms(df: DataFrame, table: str, column: str, cap: int = 2000) -> DataFrame:
    """Distinct atoms of a categorical column: (table, column, value)."""
    v = df.select(F.col(column).alias("v")).where("v is not null").distinct().orderBy("v").limit(cap)
    return v.select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.explode(T.atoms(F.col("v"))).alias("value")).distinct()


def is_categorical(df: DataFrame, column: str, most: int = 50) -> bool:
    return df.select(F.count_distinct(column)).first()[0] <= most


def link_values(atoms: DataFrame, question: str) -> DataFrame:
    """Atoms of two characters or more whose words all occur in the question."""
    return atoms.where((F.length("value") >= 2) & (F.size(T.tokens(F.col("value"))) > 0) & (F.size(F.array_except(T.token_set(F.col("value")), T.token_set(F.lit(question)))) == 0))


def probe_entities(df: DataFrame, column: str, question: str, most: int = 5) -> list[str]:
    """Values that contain a capitalised phrase of the question."""
    out: list[str] = []
    for span in names_in(question):
        like = "%" + re.sub(r"([%_\\])", r"\\\1", span) + "%"
        out += [r[0] for r in df.where(F.col(column).ilike(like)).select(column).distinct().orderBy(column).limit(most).collect()]
    return list(dict.fromkeys(out))


def hint(column: str, value: str, multi: bool = False) -> str:
    v = value.replace("'", "''")
    return f"{column} LIKE '%{v}%'" if multi else f"{column} = '{v}'"


def route(question: str, has_graph: bool = True, names_entity: bool = False) -> str:
    """sql, graph or sql+graph."""
    q = words(question)
    s, g = len(q & SQL_HINTS), len(q & GRAPH_HINTS)
    if not has_graph:
        return "sql"
    if s and g:
        return "sql+graph"
    if s != g:
        return "sql" if s > g else "graph"
    return "graph" if names_entity else "sql"


@dataclass
class Answer:
    path: str
    result: DataFrame | None = None
    sql: str = ""
    narrative: str = ""
    chart: dict | None = None


def fuse(answers: list[Answer]) -> Answer:
    """One answer: the first with SQL and a result leads, narratives are marked with their path."""
    lead = next((a for a in answers if a.sql and a.result is not None), answers[0])
    return Answer("+".join(a.path for a in answers), lead.result, lead.sql, "\n".join(f"[{a.path}] {a.narrative}" for a in answers if a.narrative), lead.chart)


def chart(columns: list[str], rows: list[tuple]) -> dict | None:
    if len(columns) < 2 or not rows or isinstance(rows[0][-1], bool) or not isinstance(rows[0][-1], (int, float)):
        return None
    return {"kind": "bar", "x": columns[0], "y": columns[-1]}


def signature(df: DataFrame) -> DataFrame:
    """One row: a digest of the result as a multiset of rows; null differs from any text."""
    row = F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("{}")).alias(f"c{i}") for i, c in enumerate(df.columns)]))
    h = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"))
    s = h.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("a").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("a"), F.coalesce(F.bit_xor("b"), F.lit(0).cast("long")).alias("b"))
    return s.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("signature"))


def majority(signatures: list[str | None]) -> int | None:
    """Index of the first member of the largest group of equal signatures; failed candidates (None) don't vote."""
    good = [s for s in signatures if s is not None]
    if not good:
        return None
    best = max(good, key=lambda s: (good.count(s), -good.index(s)))
    return signatures.index(best)


def critique(question: str, found: Analysis | None, n_rows: int | None) -> list[str]:
    """What is wrong with a candidate; the plan is looked at, not the text."""
    out = []
    if n_rows is None:
        return ["no result"]
    if n_rows == 0:
        out.append("no rows")
    if RANKING.search(question) and found is not None:
        out += ["no order"] * (not found.sorted) + ["no limit"] * (not found.limited)
    return out


def extract_sql(reply: str) -> str:
    m = re.search(r"```(?:sql)?\s*(.*?)```", reply, re.S | re.I)
    return (m[1] if m else reply).strip().rstrip(";").strip()


class CannedModel:
    """A deterministic model: replies in turn, and the prompts it got."""

    def __init__(self, replies: list[str]):
        self.replies, self.prompts = replies, []

    def __call__(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.replies[(len(self.prompts) - 1) % len(self.replies)]


@dataclass
class Step:
    name: str
    detail: str = ""


def answer_sql(question: str, model: Callable[[str], str], run: Callable[[str], DataFrame], spark: SparkSession, context: str = "", candidates: int = 3, corrections: int = 2, links: Callable[[str], list[str]] | None = None, trace: list[Step] | None = None) -> Answer:
    """Link, classify, plan if hard, write candidates, vote, critique, correct.

    links gives conditions on stored values that the question names.  A
    question is hard if it asks for a ranking or names a stored value; only hard
    ones get a plan and several candidates.  A refusal by the policy ends the
    search, other errors are fed back.
    """
    steps = trace if trace is not None else []
    hints = links(question) if links else []
    steps.append(Step("link", "; ".join(hints)))
    hard = bool(RANKING.search(question)) or bool(hints)
    steps.append(Step("classify", "hard" if hard else "simple"))
    prompt = "\n".join([context, *(f"Hint: {h}" for h in hints), f"Question: {question}"])
    if hard:
        plan = model(f"{prompt}\nList the steps of a query, without SQL.").strip()
        steps.append(Step("plan", plan))
        prompt += f"\nPlan: {plan}"
    tries, feedback, last, error = candidates if hard else 1, "", None, ""
    sqls: list[str] = []
    for _ in range(corrections + 1):
        sqls = [extract_sql(model(f"{prompt}\n{feedback}")) for _ in range(tries)]
        steps.append(Step("write", f"{tries}"))
        got, marks = [], []
        for s in sqls:
            try:
                df = run(s)
                marks.append(signature(df).first()[0])
                got.append(df)
            except GuardError as e:
                if e.status == 403:
                    raise
                error = str(e)
                got.append(None)
                marks.append(None)
            except Exception as e:  # noqa: BLE001  any failure of a candidate is feedback
                error = str(e).split("\n")[0]
                got.append(None)
                marks.append(None)
        k, tries = majority(marks), 1
        if k is None:
            feedback = f"Failed: {error}"
            steps.append(Step("validate", error))
            continue
        problems = critique(question, analyze(spark, sqls[k]), got[k].limit(1).count())
        steps.append(Step("critic", ", ".join(problems)))
        last = Answer("sql", got[k], sqls[k], ", ".join(problems))
        if not problems:
            return last
        feedback = f"Problems: {', '.join(problems)}"
    return last or Answer("sql", None, sqls[-1], f"The question could not be answered: {error}")


def same_cell(a, b) -> bool:
    """Whole numbers exactly, other numbers to 0.1 %, anything else by equality."""
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if num(a) and num(b):
        if float(a).is_integer() and float(b).is_integer():
            return a == b
        return math.isclose(a, b, rel_tol=1e-3, abs_tol=1e-9)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def same_rows(a: list[tuple], b: list[tuple]) -> bool:
    """Equal as multisets under same_cell, by a full matching (greedy choices are revised)."""
    if len(a) != len(b):
        return False
    fits = [[j for j, y in enumerate(b) if len(x) == len(y) and all(map(same_cell, x, y))] for x in a]
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in fits[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(a)))


def score(run: Callable[[str], DataFrame], gold: str, candidate: str) -> tuple[bool, bool]:
    """(ran, right); a failing gold query raises."""
    want = [tuple(r) for r in run(gold).collect()]
    try:
        got = [tuple(r) for r in run(candidate).collect()]
    except Exception:  # noqa: BLE001
        return False, False
    return True, same_rows(got, want)


def multiset_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b, and whether the two are equal as multisets."""
    x, y = a.exceptAll(b).agg(F.count("*").alias("only_a")), b.exceptAll(a).agg(F.count("*").alias("only_b"))
    return x.join(y, F.lit(True)).select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))
