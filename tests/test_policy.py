import os
import stat

import pytest

from groundspark.audit import AuditLog, to_csv
from groundspark.engine import Engine
from groundspark.operators import policy as P
from groundspark.operators.roles import GovernedSql
from groundspark.operators.sqlguard import GuardError

TEXT = """
roles:
  public:
    actions: [query]
    tables: [people, notes]
    columns: {people.born: mask, people.secret: deny}
    rows: {notes: "owner IN (SELECT name FROM people WHERE born > 1950)"}
    max_rows: 2
  steward: {actions: [query, export], tables: ["*"], max_rows: 10}
licences: {people: [a], people.born: [b]}
notices: {a: Notice A, b: Notice B}
"""


def openers():
    return {
        "people": lambda s: s.createDataFrame([("Ann", 1940, "x"), ("Bob", 1960, "y"), ("Cy", 1970, "z")], "name string, born int, secret string"),
        "notes": lambda s: s.createDataFrame([("Ann", "=1+1"), ("Bob", "fine")], "owner string, note string"),
    }


@pytest.fixture()
def sql(spark):
    return GovernedSql(spark, openers(), P.load(TEXT))


def test_rows_masks_denials_and_caps(sql):
    assert [r.owner for r in sql.query("public", "SELECT * FROM notes").collect()] == ["Bob"]
    assert sql.query("public", "SELECT name, born AS b FROM people").where("b IS NOT NULL").count() == 0
    assert sql.query("public", "SELECT name FROM people WHERE born > 0").count() == 0
    assert "secret" not in sql.query("public", "SELECT * FROM people").columns
    assert sql.query("public", "SELECT name FROM people").count() == 2
    assert sql.query("steward", "SELECT secret FROM people").count() == 3


@pytest.mark.parametrize("role,text,code", [("nobody", "SELECT 1 FROM people", "unknown_role"), ("public", "SELECT 1 FROM other", "table_access_denied"), ("public", "SELECT a FROM db.people", "schema_access_denied")])
def test_refusals(sql, role, text, code):
    with pytest.raises(GuardError) as e:
        sql.query(role, text)
    assert e.value.code == code and e.value.status == 403


def test_denied_columns_and_base_names_dont_resolve(sql):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        sql.query("public", "SELECT secret FROM people")
    assert {t.name for t in sql.session("public").catalog.listTables()} == {"people", "notes"}


@pytest.mark.parametrize("change", [("people.born: mask", "people.gone: mask"), ("notes: \"owner", "other: \"owner"), ("1950", "nothing"), ("tables: [people, notes]", "tables: [people, notes, gone]")])
def test_rules_that_dont_fit_fail_at_build(spark, change):
    with pytest.raises(Exception):
        GovernedSql(spark, openers(), P.load(TEXT.replace(*change))).session("public")


def test_policy_text_is_strict():
    for bad in ("x: 1", "default_effect: allow", "roles: {a: {actoins: []}}", "roles: {a: {columns: {x: mask}}}", "licences: {t: [l]}"):
        with pytest.raises(P.PolicyError):
            P.load(bad)
    p = P.load(TEXT)
    assert p.obligations(["people"], {"people": ["born"]}) == [("a", "Notice A"), ("b", "Notice B")]
    assert "1950" not in str(p.access_profile("public"))


def test_export_and_audit(spark, tmp_path):
    log = AuditLog(str(tmp_path / "a.log"), most_bytes=400, keep=2)
    e = Engine(spark, openers(), P.load(TEXT), audit=log)
    text = e.export("u", "steward", "SELECT owner, note FROM notes ORDER BY owner")
    assert text.startswith("﻿owner,note") and "'=1+1" in text
    with pytest.raises(GuardError):
        e.export("u", "public", "SELECT owner FROM notes")
    for _ in range(6):
        e.query("u", "public", "SELECT owner FROM notes")
    assert stat.S_IMODE(os.stat(log.path).st_mode) == 0o600 and "SELECT" not in log.path.read_text()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.log", "a.log.1", "a.log.2"]
    assert to_csv(spark.createDataFrame([(1, "-x")], "a int, b string"), 5).endswith("1,'-x\r\n")
