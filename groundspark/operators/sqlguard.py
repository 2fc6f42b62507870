"""Admission of SQL text: one bounded read-only query over plain table names.

The text is parsed by Catalyst's own parser, in the session that will run it,
and the unresolved tree is walked.  Only node kinds on a list are admitted;
anything unknown is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

READ_ROOTS = {"Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "UnresolvedHaving", "Union", "Except", "Intersect", "UnresolvedWith", "WithWindowDefinition", "SubqueryAlias"}
INNER = READ_ROOTS | {"Join", "AsOfJoin", "LateralJoin", "UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "Generate", "Pivot", "Unpivot", "UnresolvedSubqueryColumnAliases", "Window", "UnresolvedHint", "CTERelationRef", "UnresolvedOrdinal", "ResolvedInlineTable", "Expand"}
OUTSIDE = {"UnresolvedTableValuedFunction", "UnresolvedTableValuedFunctionWithAlias", "UnresolvedTVFAliases", "PlanWithUnresolvedIdentifier", "ScriptTransformation", "Range"}
#: Functions that reach outside the query's tables, and prefixes of such names.
FORBIDDEN = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_catalog current_database current_schema current_user session_user user version read_files uuid sleep".split())
PREFIXES = ("http_", "parquet_", "postgres_", "read_", "s3_", "sqlite_", "ai_")


class GuardError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code

    @property
    def status(self) -> int:
        return 403 if self.code in ("external_access_denied", "schema_access_denied", "statement_not_read_only", "table_access_denied", "unknown_role") else 400


@dataclass(frozen=True)
class Guardrails:
    max_length: int = 20_000
    max_tables: int = 8
    max_joins: int = 7
    require_limit: bool = False


@dataclass
class Analysis:
    tables: list[str] = field(default_factory=list)
    joins: int = 0
    sorted: bool = False
    limited: bool = False


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons outside quotes and comments."""
    out, cur, i, n = [], "", 0, len(sql)
    while i < n:
        c, two = sql[i], sql[i : i + 2]
        if c in "'\"`":
            j = i + 1
            while j < n and sql[j] != c:
                j += 2 if sql[j] == "\\" and c != "`" else 1
            cur, i = cur + sql[i : j + 1], j + 1
        elif two == "--":
            j = sql.find("\n", i)
            cur, i = cur + " ", n if j < 0 else j
        elif two == "/*":
            j = sql.find("*/", i + 2)
            cur, i = cur + " ", n if j < 0 else j + 2
        elif c == ";":
            out.append(cur)
            cur, i = "", i + 1
        else:
            cur, i = cur + c, i + 1
    return [s for s in [*out, cur] if s.strip()]


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def parse(spark: SparkSession, sql: str):
    """The unresolved plan, parsed under this session's settings (the parser reads the thread's active session)."""
    jvm = spark.sparkContext._jvm
    before = jvm.org.apache.spark.sql.classic.SparkSession.getActiveSession()
    jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError("invalid_sql", str(e).split("\n")[0][:200]) from None
    finally:
        if before.isDefined():
            jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(before.get())


def analyze(spark: SparkSession, sql: str, rails: Guardrails = Guardrails()) -> Analysis:
    """What the query reads; raises GuardError with a code if it is not admitted."""
    if not sql or not sql.strip():
        raise GuardError("invalid_sql", "empty")
    if len(sql) > rails.max_length:
        raise GuardError("query_too_large")
    if len(split_statements(sql)) != 1:
        raise GuardError("multiple_statements")
    plan, found = parse(spark, split_statements(sql)[0]), Analysis()
    root = plan
    while _kind(root) == "UnresolvedWith":
        if root.allowRecursion():
            raise GuardError("query_too_complex", "recursive")
        root = root.child()
    if _kind(root) in OUTSIDE:
        raise GuardError("external_access_denied", _kind(root))
    if _kind(root) not in READ_ROOTS:
        raise GuardError("statement_not_read_only", _kind(root))
    top = root
    while _kind(top) in ("GlobalLimit", "LocalLimit", "Sort", "Offset"):
        found.limited |= _kind(top) == "GlobalLimit"
        found.sorted |= _kind(top) == "Sort"
        top = top.child()
    _walk(plan, frozenset(), found)
    many = len(found.tables) > rails.max_tables  # every reference counts, also to one table
    found.tables = sorted(set(found.tables))
    if many or found.joins > rails.max_joins:
        raise GuardError("query_too_complex")
    if rails.require_limit and not found.limited:
        raise GuardError("result_limit_required")
    return found


def _walk(node, shadowed: frozenset, found: Analysis) -> None:
    kind = _kind(node)
    if kind in OUTSIDE:
        raise GuardError("external_access_denied", kind)
    if kind not in INNER:
        raise GuardError("statement_not_read_only", kind)
    if kind == "UnresolvedWith":
        if node.allowRecursion():
            raise GuardError("query_too_complex", "recursive")
        for entry in _seq(node.cteRelations()):  # a name hides outer tables only after its own definition
            _walk(entry._2(), shadowed, found)
            shadowed = shadowed | {entry._1().lower()}
        _walk(node.child(), shadowed, found)
        return
    if kind == "UnresolvedRelation":
        parts = _seq(node.multipartIdentifier())
        if len(parts) > 1:
            raise GuardError("schema_access_denied", ".".join(parts))
        if parts[0].lower() not in shadowed:
            found.tables.append(parts[0].lower())
    if kind in ("Join", "LateralJoin"):
        found.joins += 1
        how, condition = node.joinType().toString(), node.condition()
        if "Cross" in how or (not condition.isDefined() and how.startswith(("Inner", "LeftOuter", "RightOuter", "FullOuter"))):
            raise GuardError("cross_join_denied")
    if kind == "LateralJoin":
        _walk(node.right().plan(), shadowed, found)
    for e in _seq(node.expressions()):
        _expression(e, shadowed, found)
    for child in _seq(node.children()):
        _walk(child, shadowed, found)


def _expression(e, shadowed: frozenset, found: Analysis) -> None:
    kind = _kind(e)
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = (_seq(e.nameParts())[-1] if kind == "UnresolvedFunction" else e.name().funcName()).lower()
        if name in FORBIDDEN or name.startswith(PREFIXES):
            raise GuardError("external_access_denied", name)
    if "WithUnresolvedIdentifier" in kind:
        raise GuardError("external_access_denied", kind)
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):  # the query of IN is a child, too
        _walk(e.plan(), shadowed, found)
    for child in _seq(e.children()):
        if child.getClass().getName() != e.getClass().getName() or child is not e:
            _expression(child, shadowed, found)
