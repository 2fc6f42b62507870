import pytest

from groundspark.operators.sqlguard import GuardError, Guardrails, analyze

GOOD = [
    ("SELECT a FROM t", ["t"]),
    ("SELECT a FROM t;", ["t"]),
    ("WITH x AS (SELECT a FROM t) SELECT * FROM x", ["t"]),
    ("WITH t AS (SELECT a FROM t) SELECT 1 FROM u WHERE EXISTS (SELECT 1 FROM t)", ["t", "u"]),
    ("SELECT * FROM (WITH t AS (SELECT 1 AS a FROM v) SELECT a FROM t) x JOIN t ON x.a = t.a", ["t", "v"]),
    ("SELECT a FROM t UNION ALL SELECT b FROM u ORDER BY 1 LIMIT 3", ["t", "u"]),
    ("SELECT explode(split(a, ';')) FROM t WHERE b IN (SELECT c FROM u)", ["t", "u"]),
    ("SELECT a, row_number() OVER (ORDER BY b) FROM t GROUP BY a, b HAVING count(*) > 1", ["t"]),
    ("SELECT (SELECT max(b) FROM u) AS m FROM t", ["t", "u"]),
]
BAD = [
    ("", "invalid_sql"),
    ("SELEC a", "invalid_sql"),
    ("SELECT 1 FROM t; SELECT 2 FROM t", "multiple_statements"),
    ("DROP TABLE t", "statement_not_read_only"),
    ("INSERT INTO t SELECT 1", "statement_not_read_only"),
    ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "statement_not_read_only"),
    ("EXPLAIN SELECT 1 FROM t", "statement_not_read_only"),
    ("SET a = 1", "statement_not_read_only"),
    ("TABLE t", "statement_not_read_only"),
    ("EXECUTE IMMEDIATE 'SELECT 1'", "statement_not_read_only"),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", "query_too_complex"),
    ("SELECT * FROM (WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r) x", "query_too_complex"),
    ("SELECT * FROM range(10)", "external_access_denied"),
    ("SELECT * FROM db.t", "schema_access_denied"),
    ("SELECT * FROM parquet.`/tmp/x`", "schema_access_denied"),
    ("SELECT * FROM IDENTIFIER('a.b')", "external_access_denied"),
    ("SELECT TRANSFORM (a) USING 'cat' FROM t", "external_access_denied"),
    ("SELECT reflect('java.lang.System', 'exit', 1) FROM t", "external_access_denied"),
    ("SELECT input_file_name() FROM t", "external_access_denied"),
    ("SELECT a FROM t WHERE a IN (SELECT java_method('x', 'y') FROM u)", "external_access_denied"),
    ("SELECT * FROM t, u", "cross_join_denied"),
    ("SELECT * FROM t CROSS JOIN u", "cross_join_denied"),
    ("SELECT * FROM a JOIN b ON 1=a.x JOIN c ON c.x=1 JOIN d ON d.x=1 JOIN e ON e.x=1 JOIN f ON f.x=1 JOIN g ON g.x=1 JOIN h ON h.x=1 JOIN i ON i.x=1", "query_too_complex"),
]


@pytest.mark.parametrize("sql,tables", GOOD)
def test_admitted(spark, sql, tables):
    assert analyze(spark, sql).tables == tables


@pytest.mark.parametrize("sql,code", BAD)
def test_refused(spark, sql, code):
    with pytest.raises(GuardError) as e:
        analyze(spark, sql)
    assert e.value.code == code


def test_limits(spark):
    with pytest.raises(GuardError, match="query_too_large"):
        analyze(spark, "SELECT 1 FROM t", Guardrails(max_length=5))
    with pytest.raises(GuardError, match="result_limit_required"):
        analyze(spark, "SELECT a FROM t", Guardrails(require_limit=True))
    found = analyze(spark, "SELECT a FROM t ORDER BY a LIMIT 3", Guardrails(require_limit=True))
    assert found.limited and found.sorted
