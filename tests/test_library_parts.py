"""Settings, identity, observation, extraction, narratives, evaluation, enrichment and the service calls."""

import os
import subprocess
import sys
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from groundspark import config, evaluation, identity, observe
from groundspark.engine import Engine
from groundspark.etl import enrich
from groundspark.functions import text as T
from groundspark.operators import extraction as X
from groundspark.operators import graph as G
from groundspark.operators import narrative as N
from groundspark.operators import policy as P
from groundspark.operators import questions as Q
from groundspark.operators.roles import Passthrough
from groundspark.operators.sqlguard import GuardError, Guardrails, analyze
from groundspark.service import Service

LAYER = """
tables:
  - {name: films, description: Films, columns: [{name: title, link: entity}, {name: kind, link: categorical}, {name: year, type: int}]}
metrics: {hits: COUNT(*)}
synonyms: {movie: films}
few_shots: [{question: how many films, sql: SELECT COUNT(*) FROM films}]
"""
ONTOLOGY = """
entity_types: [Film, Person]
relation_types: [MADE_BY, HAS_KIND, HAS_THEME]
attribute_relations: [HAS_KIND]
connective_relations: [HAS_THEME]
intents: [{name: maker, shape: entity_lookup, triggers: [Maker], target_relations: [MADE_BY]}]
relation_roles: {MADE_BY: {subject: Film, object: Person}}
hint: Short themes.
empty_graph_hint: Nothing is known.
"""
CLASS = "{confidentiality: public, license: free, privacy: none, integrity: fact}"
POLICY = f"""
version: 2
default_effect: deny
anonymous_role: guest
roles:
  guest: {{actions: [ask, raw_sql, graph], tables: [films], columns: {{films.year: mask}}, row_security: {{films: "kind <> 'secret'"}}, graph_relations: [MADE_BY, HAS_KIND], max_rows: 2}}
  keeper: {{actions: [ask, raw_sql, export], tables: [films], graph_relations: [MADE_BY, HAS_KIND, HAS_THEME]}}
data: {{tables: {{films: {{classification: {CLASS}, required: true}}}}}}
graph: {{default_effect: deny, relations: {{MADE_BY: {{}}, HAS_KIND: {{}}, HAS_THEME: {{}}}}}}
licenses: {{free: Use it}}
query_guardrails: {{max_tables: 3}}
"""


def test_layer_and_ontology():
    layer, o = config.layer(LAYER), config.ontology(ONTOLOGY)
    assert layer.tables[0].columns[1].link == "categorical" and layer.examples == (("how many films", "SELECT COUNT(*) FROM films"),)
    assert o.resolve({"maker"}).shape == "lookup" and o.empty_hint == "Nothing is known." and o.attributes == {"HAS_KIND"}
    with pytest.raises(config.ConfigError):
        config.ontology(ONTOLOGY.replace("connective_relations: [HAS_THEME]", "connective_relations: [OTHER]"))
    with pytest.raises(config.ConfigError):
        config.layer("tabels: []")


def test_policy_documents():
    p, rails = config.policy(POLICY)
    assert rails.max_tables == 3 and p.anonymous == "guest" and p.obligations(["films"]) == [("free", "Use it")] and p.classes["films"]["privacy"] == "none"
    assert p.role("keeper").actions == {"ask", "query", "export"} and p.may_relate("keeper", "HAS_THEME") and not p.may_relate("guest", "HAS_THEME")
    for old, new in (("default_effect: deny", "default_effect: allow"), ("anonymous_role: guest", "anonymous_role: nobody"), ("license: free", "license: lost"), ("tables: [films]", "tables: [other]"), ("integrity: fact", "x: y"), ("max_rows: 2", "max_rows: 0"), ("graph_relations: [MADE_BY, HAS_KIND]", "graph_relations: [NEW]")):
        with pytest.raises(config.ConfigError):
            config.policy(POLICY.replace(old, new, 1))
    old, rails = config.policy("roles: {analyst: {pii: allow}, public: {pii: mask}}\npii_columns: [born]\nrow_security: {public: {films: 'year > 1'}}\nrow_filters: {public: [{column: kind, deny_values: [adult]}]}\ncost_guardrail: {require_limit: true}")
    assert rails.require_limit and old.column("public", "films", "born") == "mask" and old.column("analyst", "films", "born") == "allow"
    assert not old.allows("public", "export") and old.may_read("public", "anything") and old.may_relate("public", "ANY") and old.role("public").deny_values == {"kind": frozenset({"adult"})}


def test_tokens():
    token, mark = identity.new_token()
    text = f"version: 2\nallow_anonymous: true\nanonymous_role: guest\ncredentials:\n - {{id: a, token_sha256: {mark}, user: u, role: keeper, expires_at: '2030-01-01T00:00:00Z'}}\n - {{id: b, token_sha256: {identity.digest('old')}, user: v, role: keeper, disabled: true}}\n"
    s = identity.StaticTokens.load(text, {"guest", "keeper"})
    assert s.caller(token) == identity.Caller("u", "keeper", "a") and s.caller(None).role == "guest"
    for t in ("wrong", "old"):
        with pytest.raises(identity.AuthError, match="invalid"):
            s.caller(t)
    late = identity.StaticTokens.load(text, {"guest", "keeper"}, now=lambda: datetime(2031, 1, 1, tzinfo=UTC))
    with pytest.raises(identity.AuthError, match="expired"):
        late.caller(token)
    with pytest.raises(identity.AuthError, match="required"):
        identity.StaticTokens.load(text.replace("allow_anonymous: true", "allow_anonymous: false"), {"guest", "keeper"}).caller("")
    for bad in (text.replace("role: keeper", "role: none", 1), text.replace(mark, "12"), text.replace("00:00Z", "00:00")):
        with pytest.raises(config.ConfigError):
            identity.StaticTokens.load(bad, {"guest", "keeper"})


def test_metrics_and_traces():
    m = observe.Metrics()
    with pytest.raises(ZeroDivisionError):
        observe.observed(m, 'a"b', lambda: 1 / 0)()
    with m.span("ok"):
        pass
    assert 'groundspark_calls_total{name="a_b",outcome="error"} 1' in m.text() and 'seconds_count{name="ok"} 1' in m.text()
    n = observe.NoMetrics()
    with n.span("x"):
        pass
    assert not n.counts and not n.times
    t = observe.Trace("r")
    with pytest.raises(ValueError), t.step("one"):
        raise ValueError
    assert t.steps[0]["step"] == "one" and not t.steps[0]["ok"] and t.steps[0]["detail"] == "ValueError"


def test_extraction_and_store(spark, tmp_path):
    o = config.ontology(ONTOLOGY)
    docs = spark.createDataFrame([("d1", "alpha"), ("d2", "fails"), ("d3", None), ("d4", "beta")], "id string, text string")

    def model(prompt):
        if "fails" in prompt:
            raise RuntimeError
        return "- A | MADE_BY | B\nA | MADE_BY | B\nA | OTHER | B\nbad\n| MADE_BY | x" if "alpha" in prompt else "A | HAS_THEME | sea"

    got = sorted(map(tuple, X.extract(docs, o, model).collect()))
    assert got == [("A", "HAS_THEME", "sea", "d3"), ("A", "HAS_THEME", "sea", "d4"), ("A", "MADE_BY", "B", "d1")]
    themes = X.only(o, frozenset({"HAS_THEME"}))
    assert themes.relations == {"HAS_THEME"} and themes.intents == () and X.extract(docs, themes, model).count() == 2
    assert X.build(docs, o, model, f"{tmp_path}/t", most_calls=1) == 1 and G.read_triples(spark, f"{tmp_path}/t").count() == 1
    G.save_store(G.dedupe(X.extract(docs, o, model)), f"{tmp_path}/s")
    assert {r.entity: r.degree for r in G.store_nodes(spark, f"{tmp_path}/s").collect()} == {"A": 2, "B": 1, "sea": 1}
    assert G.open_store(spark, f"{tmp_path}/s").columns == list(G.TRIPLE)
    with pytest.raises(ValueError):
        G.safe_name("a/b")
    late = spark.createDataFrame([("a", "R", "b", "z", 1), ("a", "R", "b", "y", 2)], "subject string, relation string, object string, source string, pos int")
    assert G.dedupe(late, "pos").first().source == "y" and G.dedupe(late).first().source == "y"


def test_narratives(spark):
    t = spark.createDataFrame([("A", "MADE_BY", f"p{i:02}", "wiki:1" if i else "film:1") for i in range(50)], "subject string, relation string, object string, source string")
    o = config.ontology(ONTOLOGY)
    got = N.answer(t, 3, frozenset({"wiki"}))
    lines = got.narrative.split("\n")
    assert lines[0] == "A MADE_BY p00 [film:1]" and lines[1].endswith("[wiki:1] (model-inferred)") and lines[-1] == "(47 more facts are not shown)" and got.result.count() == 50
    model = observe.CountingModel(lambda p: "said " + str(p.count("MADE_BY")))
    assert N.grounded(got, "q", model).narrative == "said 40"
    none = N.answer(t.limit(0), empty="nothing")
    assert N.grounded(none, "q", model) is none and none.result is None and none.narrative == "nothing" and model.calls == 1
    assert N.can_handle(t, "who is p07", o) and N.can_handle(t, "anything related", o) and not N.can_handle(t, "why", o)


def films(spark):
    rows = [("Sea Story", "drama", 1), ("Dark Sea", "secret", 2), ("Ölberg", "drama", 3)]
    return lambda s: s.createDataFrame(rows, "title string, kind string, year int")


def service(spark, **more):
    p, rails = config.policy(POLICY)
    t = spark.createDataFrame([("Sea Story", "MADE_BY", "Ann", "film:Sea Story"), ("Dark Sea", "MADE_BY", "Ann", "film:Dark Sea"), ("Sea Story", "HAS_THEME", "sea", "film:Sea Story"), ("Sea Story", "HAS_KIND", "drama", "")], "subject string, relation string, object string, source string")
    engine = Engine(spark, {"films": films(spark)}, p, t, config.ontology(ONTOLOGY), config.layer(LAYER), rails=rails, sources={"films": ("title", ("film:",))})
    token, mark = identity.new_token()
    tokens = identity.StaticTokens([identity.Credential("k", mark, "kim", "keeper")], "guest")
    return Service(engine, tokens, **more), engine, token


def test_graph_answers_hide_what_rows_hide(spark):
    _, engine, _ = service(spark)
    assert [tuple(r) for r in engine.visible("guest").collect()] == [("Sea Story", "MADE_BY", "Ann", "film:Sea Story")]
    assert engine.visible("keeper").count() == 3
    got = engine.graph("guest", "maker of Dark Sea")
    assert got.result is None and got.narrative == "Nothing is known."
    assert "Dark Sea MADE_BY Ann" in engine.graph("keeper", "maker of Dark Sea").narrative
    with pytest.raises(P.PolicyError):
        engine.graph("nobody", "maker of Ann")


def test_service_calls(spark):
    model = Q.CannedModel(["plan", "SELECT title FROM films WHERE kind = 'drama' ORDER BY title LIMIT 1"])
    s, _, token = service(spark, model=model, info={"model": "canned"}, metrics=observe.Metrics())
    assert s.health().body == {"status": "ok"} and s.info().body == {"model": "canned"}
    assert s.session(request="r-1").headers == {"X-Request-ID": "r-1", "Cache-Control": "no-store"} and s.session(token).body["role"] == "keeper"
    assert len(s.session(request="bad id!").headers["X-Request-ID"]) == 32
    assert s.query("SELECT title, year FROM films ORDER BY title").body == {"columns": ["title", "year"], "rows": [["Sea Story", None], ["Ölberg", None]]}
    assert s.query("DROP TABLE films").status == 403 and s.query("SELECT 1", "wrong").status == 401 and s.export("SELECT title FROM films").status == 403
    got = s.export("SELECT title FROM films", token)
    assert got.headers["X-Licences"] == "free" and got.headers["X-Role"] == "keeper" and got.headers["X-Policy-Version"] == "2" and got.body.startswith("﻿title")
    asked = s.ask("top drama film", token, path="sql")
    assert asked.body["rows"] == [["Sea Story"]] and asked.body["licences"] == [{"id": "free", "notice": "Use it"}] and asked.body["calls"] == 4
    steps = asked.body["trace"][1]["steps"]
    assert steps[0] == "link: kind = 'drama'" and steps[1] == "classify: hard" and steps[2] == "plan: plan"
    assert s.ask("maker of Sea Story", path="graph").body["rows"][0][:3] == ["Sea Story", "MADE_BY", "Ann"]
    assert 'name="ask"' in s.metrics_text().body
    bare, _, _ = service(spark)
    assert bare.metrics_text().status == 404


def test_passthrough_and_role_tables(spark):
    free = Passthrough(spark, {"films": films(spark)})
    assert free.query("anyone", "SELECT COUNT(*) AS n FROM films").first().n == 3 and free.obligations("x", "SELECT 1") == []
    _, engine, _ = service(spark)
    assert engine.sql.list_tables("guest") == {"films": [("title", "string"), ("kind", "string"), ("year", "int")]}


def test_guard_counts_every_reference(spark):
    own = spark.newSession()
    own.range(3).createOrReplaceTempView("t")
    text = "SELECT 1 FROM t WHERE id IN (SELECT id FROM t WHERE id IN (SELECT id FROM t))"
    assert analyze(own, text, Guardrails(max_tables=3)).tables == ["t"]
    with pytest.raises(GuardError, match="query_too_complex"):
        analyze(own, text, Guardrails(max_tables=2))


def test_evaluation(spark):
    cases = [evaluation.Case("n", "how many films", "SELECT COUNT(*) FROM films", "agg"), evaluation.Case("t", "top film", "SELECT title FROM films ORDER BY year DESC LIMIT 1", "top")]
    data = evaluation.inline({"films": ("title string, year int", [("a", 1), ("b", 2)])})
    right = evaluation.evaluate(spark, "right", cases, data, lambda c, own: (c.gold, 1))
    broken = evaluation.evaluate(spark, "broken", cases, data, lambda c, own: ("SELECT nope FROM films", 2) if c.id == "n" else 1 / 0)
    got = {r.system: (r.n, r.valid_rate, r.accuracy, r.attempts) for r in evaluation.report(right.union(broken)).collect()}
    assert got == {"right": (2, 1.0, 1.0, 1.0), "broken": (2, 0.0, 0.0, 1.0)}
    # Self-correction: without it the first answer counts, with it the second.
    layer = Q.Layer((Q.TableDef("films", "Films", (Q.ColumnDef("title"), Q.ColumnDef("year"))),))
    made = lambda: lambda p: "SELECT title FROM films ORDER BY year DESC LIMIT 1" if "Failed" in p or "Problems" in p else ("steps" if "without SQL" in p else "SELECT title FROM films")
    rungs = evaluation.report(evaluation.ladder(spark, cases[1:], data, layer, made), "system", "tier").collect()
    assert {r.system: r.accuracy for r in rungs} == {"baseline": 0.0, "+semantic": 0.0, "+value-link": 0.0, "+plan/votes": 0.0, "grounded": 1.0}
    assert {r.system: r.calls for r in rungs}["grounded"] == 5
    assert evaluation.routing_accuracy([("how many films", "sql"), ("what is related to it", "graph"), ("count what both share", "sql+graph")]) == 1.0
    assert evaluation.dataset("crm")(spark).sql("SELECT COUNT(*) AS n FROM customers").first().n == 48
    with pytest.raises(ValueError):
        evaluation.dataset("other")


def test_enrichment(spark):
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise enrich.HttpError(503)
        return "ok"

    assert enrich.retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(enrich.HttpError):
        enrich.retry(lambda: (_ for _ in ()).throw(enrich.HttpError(404)), sleep=waits.append)
    assert len(waits) == 2

    def known(ids):
        if "t3" in ids:
            raise OSError
        return {i: i.upper() for i in ids if i != "t2"}

    ids = spark.createDataFrame([(f"t{i}",) for i in range(5)], "tconst string").coalesce(1)
    assert {tuple(r) for r in enrich.bridge(ids, known, 1).collect()} == {("t0", "T0"), ("t1", "T1"), ("t4", "T4")}
    pages = {"t1": "x\n== plot ==\nIt '''is'''.\n=== More ===\ny", "t2": "no section"}
    got = enrich.plots(enrich.fetch(spark.createDataFrame([(i, i) for i in ("t1", "t2", "t9")], "id string, page string"), pages.__getitem__))
    assert [tuple(r) for r in got.collect()] == [("t1", "It is.")]
    basics = spark.createDataFrame([("t1", "movie", "A"), ("t2", "movie", "B"), ("t3", "short", "C"), ("t4", "movie", "D")], "tconst string, titleType string, primaryTitle string")
    votes = spark.createDataFrame([("t1", 5), ("t2", 9), ("t3", 99), ("t4", 1)], "tconst string, numVotes long")
    assert {tuple(r) for r in enrich.select_documents(basics, votes, 2, pages.__getitem__).collect()} == {("t1", "A", pages["t1"]), ("t2", "B", "no section")}


@pytest.mark.parametrize(
    "markup, text",
    [
        ("{{a|{{b}}|[[c]]}}x", "x"), ("[[File:a.png|thumb|see [[b|c]]]]d", "d"), ("[[a|b [[c]]]]", "b c"), ("{| class=x\n|-\n| [[a]] || {{b}}\n|}\nz", "z"), ("a<ref>b [[c]]</ref>d<ref name=e/>f", "adf"),
        ("''a'' '''b'''", "a b"), ("[http://x.y label] [http://x.y]", "label"), ("open [[a|b", "open ab"), ("a }} b ]] c | d", "a  b  c | d"), ("{{a", "a"), ("a<!-- b -->c<br/>d", "acd"), ("a\n\n\n\nb", "a\n\nb"), ("", ""), (None, None),
    ],
)
def test_wiki_text(markup, text):
    assert T.wiki_text(markup) == text


def test_wiki_columns(spark):
    df = spark.createDataFrame([("{{x}}a",), (None,)], "c string").select(T.strip_wikitext(F.col("c")).alias("t"))
    assert [r.t for r in df.collect()] == ["a", None]
    heads = ["== Plot ==\na\n== B ==\nc", "=== plot===\na\n=== B ===\nc", "==SYNOPSIS==\na", "== Plots ==\na", "none"]
    df = spark.createDataFrame([(h,) for h in heads], "c string").select(T.section(F.col("c")).alias("t"))
    assert [r.t for r in df.collect()] == ["a", "a", "a", "", ""]


def test_names_in_questions():
    assert Q.names_in("Which films of Åsa Öberg star Émile?") == ["Åsa Öberg", "Émile"]
    assert Q.names_in("the Matrix 2, Alien") == ["Matrix 2", "Alien"] and Q.names_in("what is it") == []


def test_python_workers_find_the_package_from_any_folder(tmp_path):
    """The driver may be started elsewhere, with the repository on sys.path alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from groundspark.session import build
from groundspark.functions import text as T
spark = build("elsewhere", "local[1]", **{{"spark.ui.enabled": "false"}})
df = spark.createDataFrame([("[[a|b]]",)], "c string")
assert df.select(T.strip_wikitext(df.c)).first()[0] == "b"
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
