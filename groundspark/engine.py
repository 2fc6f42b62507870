"""The engine: query, export and ask, each behind the policy boundary and audited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import AuditLog, to_csv
from .observe import Trace
from .operators import graph as G
from .operators import narrative as N
from .operators import questions as Q
from .operators.policy import Policy
from .operators.roles import GovernedSql, Opener
from .operators.sqlguard import GuardError, Guardrails


class Engine:
    """sources: table -> (key column, prefixes of the sources that its rows stand for), for graph answers."""

    def __init__(self, spark: SparkSession, tables: dict[str, Opener], policy: Policy, triples: DataFrame | None = None, ontology: G.Ontology | None = None, layer: Q.Layer | None = None, audit: AuditLog | None = None, rails: Guardrails = Guardrails(), sources: dict[str, tuple[str, tuple[str, ...]]] | None = None, inferred: frozenset[str] = frozenset()):
        self.sql, self.policy, self.triples, self.ontology, self.layer, self.audit = GovernedSql(spark, tables, policy, rails), policy, triples, ontology, layer, audit
        self.sources, self.inferred = sources or {}, inferred

    def _audited(self, user: str, role: str, action: str, text: str, work: Callable):
        outcome = "failed"
        try:
            out = work()
            outcome = "allowed"
            return out
        except GuardError:
            outcome = "denied"
            raise
        finally:
            if self.audit:
                self.audit.write(user, role, action, outcome, text)

    def query(self, user: str, role: str, text: str) -> DataFrame:
        return self._audited(user, role, "query", text, lambda: self.sql.query(role, text))

    def export(self, user: str, role: str, text: str) -> str:
        return self._audited(user, role, "export", text, lambda: to_csv(self.sql.query(role, text, "export"), self.policy.role(role).max_rows))

    def visible(self, role: str) -> DataFrame:
        """The triples that the role may see: granted relations, cited, and not from a row that its policy hides."""
        t = self.triples
        known = [r.relation for r in t.select("relation").distinct().collect()]  # a few relations
        t = t.where(F.col("relation").isin(*[r for r in known if self.policy.may_relate(role, r)] or [""]) & (F.col("source") != ""))
        for table, (key, prefixes) in self.sources.items():
            t = t.join(self.sql.denied_sources(role, table, key, prefixes), "source", "left_anti").select(*G.TRIPLE)
        return t

    def graph(self, role: str, question: str, model: Callable[[str], str] | None = None) -> Q.Answer:
        """Permission first; seeds, degrees and facts come from visible triples alone."""
        r = self.policy.role(role)
        if not (self.policy.allows(role, "ask") or self.policy.allows(role, "graph")):
            raise GuardError("table_access_denied", "graph")
        _, found = G.retrieve(self.visible(role), question, self.ontology)
        got = N.answer(found.limit(r.max_triples), inferred=self.inferred, empty=self.ontology.empty_hint or N.EMPTY)
        return N.grounded(got, question, model) if model else got

    def links(self, role: str, question: str) -> list[str]:
        """Conditions on stored values of the role's views that the question names."""
        own, out = self.sql.session(role), []
        for t in self.layer.tables if self.layer else ():
            if not self.policy.may_read(role, t.name) or t.name not in self.sql.tables:
                continue
            for c in t.columns:
                if c.name not in own.table(t.name).columns:
                    continue
                if c.link == "categorical":
                    out += [Q.hint(c.name, r.value) for r in Q.link_values(Q.value_atoms(own.table(t.name), t.name, c.name), question).orderBy("value").limit(5).collect()]
                elif c.link == "entity":
                    out += [Q.hint(c.name, v) for v in Q.probe_entities(own.table(t.name), c.name, question)]
        return out

    def ask(self, user: str, role: str, question: str, model: Callable[[str], str], path: str = "auto", trace: Trace | None = None) -> Q.Answer:
        """path: auto (by the router), sql, graph or fusion."""
        trace = trace or Trace("")

        def work() -> Q.Answer:
            with trace.step("route") as line:
                way = {"auto": Q.route(question, self.triples is not None), "fusion": "sql+graph"}.get(path, path)
                if way not in ("sql", "graph", "sql+graph") or ("graph" in way and self.triples is None):
                    raise ValueError(f"no such path: {path}")
                line["detail"] = way
            answers = []
            if "sql" in way:
                with trace.step("sql") as line:
                    own, steps = self.sql.session(role), []
                    layer = self.layer.governed(lambda t, c: self.policy.may_read(role, t) and self.policy.column(role, t, c) == "allow") if self.layer else None
                    answers.append(Q.answer_sql(question, model, lambda s: self.sql.query(role, s, "ask"), own, layer.context(question) if layer else "", links=lambda q: self.links(role, q), trace=steps))
                    line |= {"sql": answers[-1].sql, "steps": [f"{s.name}: {s.detail}" for s in steps]}
            if "graph" in way:
                with trace.step("graph"):
                    answers.append(self.graph(role, question))
            return Q.fuse(answers)

        return self._audited(user, role, "ask", question, work)
