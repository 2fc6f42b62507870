"""The calls of a server, without a server: identity, request ids, traces, metrics and answers as plain values."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .engine import Engine
from .identity import AuthError, StaticTokens
from .observe import CountingModel, Metrics, NoMetrics, Trace
from .operators import questions as Q
from .operators.policy import PolicyError
from .operators.sqlguard import GuardError

REQUEST_ID = re.compile(r"[A-Za-z0-9._-]{1,128}")


@dataclass
class Reply:
    status: int
    body: object
    headers: dict[str, str] = field(default_factory=dict)


class Service:
    """Every call takes a bearer token and a request id (made if absent or unfit) and gives a Reply."""

    def __init__(self, engine: Engine, tokens: StaticTokens, model: Callable[[str], str] | None = None, info: dict | None = None, metrics: Metrics | None = None):
        self.engine, self.tokens, self.model, self.about, self.metrics = engine, tokens, model, info or {}, metrics or NoMetrics()

    def _call(self, name: str, token: str | None, request: str | None, work) -> Reply:
        headers = {"X-Request-ID": request if request and REQUEST_ID.fullmatch(request) else uuid.uuid4().hex}
        try:
            with self.metrics.span(name):
                caller = self.tokens.caller(token)
                body, more = work(caller, headers["X-Request-ID"])
            return Reply(200, body, headers | more)
        except AuthError as e:
            return Reply(e.status, {"code": e.code}, headers | {"WWW-Authenticate": "Bearer"})
        except GuardError as e:
            return Reply(e.status, {"code": e.code}, headers)
        except PolicyError as e:
            return Reply(403, {"code": str(e).split(":")[0]}, headers)

    def health(self) -> Reply:
        return Reply(200, {"status": "ok"})

    def info(self) -> Reply:
        return Reply(200, dict(self.about))

    def metrics_text(self) -> Reply:
        if isinstance(self.metrics, NoMetrics):
            return Reply(404, {"code": "no_metrics"})
        return Reply(200, self.metrics.text(), {"Content-Type": "text/plain; version=0.0.4"})

    def session(self, token: str | None = None, request: str | None = None) -> Reply:
        return self._call("session", token, request, lambda c, _: ({"user": c.user, "role": c.role, "access": self.engine.policy.access_profile(c.role)}, {"Cache-Control": "no-store"}))

    def query(self, sql: str, token: str | None = None, request: str | None = None) -> Reply:
        return self._call("query", token, request, lambda c, _: (_rows(self.engine.query(c.user, c.role, sql)), {}))

    def export(self, sql: str, token: str | None = None, request: str | None = None) -> Reply:
        def work(c, _):
            text, owed = self.engine.export(c.user, c.role, sql), self.engine.sql.obligations(c.role, sql, "export")
            more = {"Content-Type": "text/csv; charset=utf-8", "X-Role": c.role, "X-Policy-Version": self.engine.policy.version, "X-Licences": ",".join(x for x, _ in owed)}
            return text, more

        return self._call("export", token, request, work)

    def ask(self, question: str, token: str | None = None, request: str | None = None, path: str = "auto", model: Callable[[str], str] | None = None) -> Reply:
        """The answer with its trace and the licences it owes; path is auto, sql, graph or fusion; a caller may bring a model."""

        def work(c, rid):
            counted, trace = CountingModel(model or self.model or (lambda _: "")), Trace(rid)
            got = self.engine.ask(c.user, c.role, question, counted, path, trace)
            owed = self.engine.sql.obligations(c.role, got.sql, "ask") if got.sql else []
            body = {"path": got.path, "sql": got.sql, "narrative": got.narrative, "chart": got.chart, "licences": [{"id": x, "notice": n} for x, n in owed], "trace": trace.steps, "calls": counted.calls}
            return body | (_rows(got.result) if got.result is not None else {"columns": [], "rows": []}), {}

        return self._call("ask", token, request, work)


def _rows(df: DataFrame) -> dict:
    """Results are capped by the role, so they fit."""
    return {"columns": df.columns, "rows": [list(r) for r in df.collect()]}


__all__ = ["Reply", "Service", "Q"]
