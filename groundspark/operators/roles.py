"""One session per role: temporary views that hold only what the policy grants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sql_session
from .graph import denied_sources as graph_denied
from .policy import ALLOW, DENY, MASK, Policy, PolicyError
from .sqlguard import Analysis, GuardError, Guardrails, analyze


#: Opens a table in the session it is given.
Opener = Callable[[SparkSession], DataFrame]


def parquet(path: str) -> Opener:
    return lambda spark: spark.read.parquet(path)


def role_session(spark: SparkSession, openers: dict[str, Opener], policy: Policy, role: str) -> SparkSession:
    """A session with the governed views of one role.

    Denied columns are absent, masked ones are typed nulls, row rules are
    filters over the base tables.  Any rule that does not fit the tables is an
    error now, not at query time.  Base names don't resolve in the session.
    """
    r, own = policy.role(role), sql_session(spark)
    tables = {t: read(own) for t, read in openers.items()}
    for t in policy.required:
        if t not in tables:
            raise PolicyError(f"required table {t} is missing")
    granted = [t for t in tables if policy.may_read(role, t)]
    if stale := (r.tables - {"*"}) - {t.lower() for t in tables}:
        raise PolicyError(f"granted tables don't exist: {sorted(stale)}")
    for rule in r.columns:
        t, c = rule.split(".")
        owners = [x for x in granted if c in [y.lower() for y in tables[x].columns]]
        if not owners or (t != "*" and t not in owners):
            raise PolicyError(f"column rule {rule} fits no granted column")
    if stale := set(r.rows) - set(granted):
        raise PolicyError(f"row rules for tables that are not granted: {sorted(stale)}")
    for t, df in tables.items():
        df.createOrReplaceTempView(t)  # predicates name base tables
    views = {}
    for t in granted:
        shown = []
        for c in tables[t].columns:
            how = policy.column(role, t, c)
            if how == MASK:
                shown.append(F.lit(None).cast(tables[t].schema[c].dataType).alias(c))
            elif how == ALLOW:
                shown.append(F.col(c))
            elif how != DENY:
                raise PolicyError(f"unknown effect {how}")
        if not shown:
            raise PolicyError(f"no visible column in {t}")
        df = own.sql(f"SELECT * FROM {t}" + (f" WHERE {r.rows[t]}" if t in r.rows else ""))
        views[t] = df.select(*shown)
    for t in tables:
        own.catalog.dropTempView(t)
    for t, df in views.items():
        df.createOrReplaceTempView(t)
    return own


class GovernedSql:
    """SQL text of a role: admitted, bound to the role's views, capped."""

    def __init__(self, spark: SparkSession, tables: dict[str, Opener], policy: Policy, rails: Guardrails = Guardrails()):
        self.spark, self.tables, self.policy, self.rails = spark, tables, policy, rails
        self._sessions: dict[str, SparkSession] = {}

    def session(self, role: str) -> SparkSession:
        if role not in self._sessions:
            self._sessions[role] = role_session(self.spark, self.tables, self.policy, role)
        return self._sessions[role]

    def before(self, role: str, sql: str, action: str = "query") -> Analysis:
        if role not in self.policy.roles:
            raise GuardError("unknown_role", role)
        if not self.policy.allows(role, action):
            raise GuardError("table_access_denied", action)
        found = analyze(self.session(role), sql, self.rails)
        for t in found.tables:
            if not self.policy.may_read(role, t) or t not in {x.lower() for x in self.tables}:
                raise GuardError("table_access_denied", t)
        return found

    def query(self, role: str, sql: str, action: str = "query") -> DataFrame:
        self.before(role, sql, action)
        r = self.policy.role(role)
        df = self.session(role).sql(sql.rstrip().rstrip(";"))
        for c, values in r.deny_values.items():
            if c in df.columns:
                df = df.where(~F.coalesce(F.col(c).cast("string").isin(*values), F.lit(False)))
        masked = [c for c in df.columns if r.columns.get(f"*.{c.lower()}") == MASK]
        if masked:
            df = df.select(*[F.lit("***").alias(c) if c in masked else F.col(c) for c in df.columns])
        return df.limit(r.max_rows)

    def list_tables(self, role: str) -> dict[str, list[tuple[str, str]]]:
        """What the role may name: its views with their columns and types."""
        own = self.session(role)
        return {t: [(f.name, f.dataType.simpleString()) for f in own.table(t).schema] for t in sorted(self.tables) if self.policy.may_read(role, t)}

    def obligations(self, role: str, sql: str, action: str = "query") -> list[tuple[str, str]]:
        return self.policy.obligations(self.before(role, sql, action).tables)

    def denied_sources(self, role: str, table: str, key: str, prefixes: tuple[str, ...]) -> DataFrame:
        """Sources of the rows of a table that the role can't see: all rows if the table isn't granted."""
        own = self.session(role)
        base = self.tables[table](own)
        view = own.table(table) if self.policy.may_read(role, table) and key in own.table(table).columns else base.limit(0)
        return graph_denied(base, view, key, prefixes)


class Passthrough:
    """The same calls without a policy, for data that needs none."""

    def __init__(self, spark: SparkSession, tables: dict[str, Opener]):
        self.own = sql_session(spark)
        for name, read in tables.items():
            read(self.own).createOrReplaceTempView(name)

    def session(self, role: str) -> SparkSession:
        return self.own

    def query(self, role: str, sql: str, action: str = "query") -> DataFrame:
        return self.own.sql(sql)

    def obligations(self, role: str, sql: str, action: str = "query") -> list[tuple[str, str]]:
        return []
