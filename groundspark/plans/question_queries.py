"""Questions over the sample tables: intents, value links, schema choice, votes and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import questions as Q

QUESTIONS = [
    (1, "how many orders per year"),
    (2, "which supplier is connected to NATION_1"),
    (3, "top customers and the supplier path between them"),
    (4, "tell me about BUILDING"),
    (5, "average price of parts similar to red widget"),
    (6, "parts common to both suppliers"),
]
LAYER = {"customer": "customer name account balance market segment", "orders": "orders total price date year priority status", "part": "parts name brand type size price", "supplier": "supplier name account balance"}


def _rows(pairs: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in p) + ")" for p in pairs)


def q44_intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame(QUESTIONS, "id int, question string").withColumn("t", T.token_set(F.col("question")))
    hits = lambda ws: F.size(F.array_intersect("t", F.array(*[F.lit(w) for w in sorted(ws)])))
    q = q.select("id", hits(Q.SQL_HINTS).alias("sql_hits"), hits(Q.GRAPH_HINTS).alias("graph_hits"))
    return q.withColumn("path", F.when((F.col("sql_hits") > 0) & (F.col("graph_hits") > 0), "sql+graph").when(F.col("graph_hits") > F.col("sql_hits"), "graph").otherwise("sql"))


def q45_value_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    return Q.value_atoms(c, "customer", "c_mktsegment").union(Q.value_atoms(p.withColumn("kinds", F.concat_ws(", ", "p_type", "p_brand")), "part", "kinds"))


def q45b_value_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return Q.link_values(Q.value_atoms(c, "customer", "c_mktsegment"), "orders of the building and machinery segments")


def q46_schema_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame(QUESTIONS, "id int, question string").withColumn("t", T.token_set(F.col("question")))
    s = spark.createDataFrame(list(LAYER.items()), "table string, words string").withColumn("w", T.token_set(F.col("words")))
    return q.join(F.broadcast(s), F.arrays_overlap("t", "w")).select("id", "table", F.size(F.array_intersect("t", "w")).alias("score"))  # a few tables


CANDIDATES = ["SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, COUNT(o_orderkey) AS n FROM orders GROUP BY o_orderpriority ORDER BY n", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority"]


def q47_self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import open_tables

    own = open_tables(spark, sf_dir, "orders")
    marks = [Q.signature(own.sql(c)).withColumn("candidate", F.lit(i)) for i, c in enumerate(CANDIDATES)]
    s = marks[0].union(marks[1]).union(marks[2])
    g = s.groupBy("signature").agg(F.count("*").alias("votes"), F.min("candidate").alias("first"))
    return g.orderBy(F.desc("votes"), "first").limit(1).select(F.col("first").alias("chosen"), "votes")


def q48_multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = o.select("o_custkey", "o_orderstatus")
    return Q.multiset_match(a.where("o_orderstatus <> 'P'"), a.where("o_custkey % 10 <> 3"))


def q69_entity_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.probe_entities(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_name", "What does Supplier#00000000 ship?")
    return spark.createDataFrame([(v,) for v in found], "value string")


def q70_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = [(i, G.SAMPLE.resolve(Q.words(q))) for i, q in QUESTIONS]
    return spark.createDataFrame([(i, x.name, x.shape) for i, x in got], "id int, intent string, shape string")


QUERIES = {f.__name__: f for f in (q69_entity_probe, q70_intents, q44_intent_route, q45_value_atoms, q45b_value_links, q46_schema_select, q47_self_consistency, q48_multiset_match)}
_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(ws)) + "]"
SQL = {
    "q44_intent_route": f"""WITH q AS (SELECT id, {_TOK.format('question')} AS t FROM (VALUES {_rows(QUESTIONS)}) v(id, question)),
h AS (SELECT id, CAST(len(list_intersect(t, {_LIST(Q.SQL_HINTS)})) AS INT) AS sql_hits, CAST(len(list_intersect(t, {_LIST(Q.GRAPH_HINTS)})) AS INT) AS graph_hits FROM q)
SELECT *, CASE WHEN sql_hits > 0 AND graph_hits > 0 THEN 'sql+graph' WHEN graph_hits > sql_hits THEN 'graph' ELSE 'sql' END AS path FROM h""",
    "q45_value_atoms": "SELECT DISTINCT 'customer' AS \"table\", 'c_mktsegment' AS \"column\", c_mktsegment AS value FROM customer UNION SELECT DISTINCT 'part', 'kinds', unnest([p_type, p_brand]) FROM part",
    "q45b_value_links": "SELECT DISTINCT 'customer' AS \"table\", 'c_mktsegment' AS \"column\", c_mktsegment AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "q46_schema_select": f"""SELECT id, "table", CAST(len(list_intersect({_TOK.format('question')}, {_TOK.format('words')})) AS INT) AS score FROM (VALUES {_rows(QUESTIONS)}) q(id, question), (VALUES {_rows(list(LAYER.items()))}) s("table", words)
WHERE len(list_intersect({_TOK.format('question')}, {_TOK.format('words')})) > 0""",
    "q47_self_consistency": f"""WITH c0 AS ({CANDIDATES[0]}), c1 AS ({CANDIDATES[1]}), c2 AS ({CANDIDATES[2]}),
d AS (SELECT (SELECT count(*) FROM (SELECT * FROM c0 EXCEPT ALL SELECT * FROM c1)) + (SELECT count(*) FROM (SELECT * FROM c1 EXCEPT ALL SELECT * FROM c0)) AS d01,
(SELECT count(*) FROM (SELECT * FROM c0 EXCEPT ALL SELECT * FROM c2)) + (SELECT count(*) FROM (SELECT * FROM c2 EXCEPT ALL SELECT * FROM c0)) AS d02,
(SELECT count(*) FROM (SELECT * FROM c1 EXCEPT ALL SELECT * FROM c2)) + (SELECT count(*) FROM (SELECT * FROM c2 EXCEPT ALL SELECT * FROM c1)) AS d12),
v AS (SELECT 0 AS chosen, 1 + CAST(d01 = 0 AS INT) + CAST(d02 = 0 AS INT) AS votes FROM d UNION ALL SELECT 1, 1 + CAST(d01 = 0 AS INT) + CAST(d12 = 0 AS INT) FROM d UNION ALL SELECT 2, 1 + CAST(d02 = 0 AS INT) + CAST(d12 = 0 AS INT) FROM d)
SELECT CAST(chosen AS INT) AS chosen, CAST(votes AS BIGINT) AS votes FROM v ORDER BY votes DESC, chosen LIMIT 1""",
    "q69_entity_probe": "SELECT DISTINCT s_name AS value FROM supplier WHERE s_name ILIKE '%Supplier#00000000%' ORDER BY value LIMIT 5",
    "q70_intents": f"""WITH i AS (SELECT * FROM (VALUES {_rows([(k, i.name, i.shape, ' '.join(sorted(i.triggers))) for k, i in enumerate(G.SAMPLE.intents)])}) v(k, intent, shape, triggers)),
s AS (SELECT q.id, i.intent, i.shape, row_number() OVER (PARTITION BY q.id ORDER BY len(list_intersect({_TOK.format('question')}, string_split(triggers, ' '))) DESC, shape <> 'pairwise', k) AS n
FROM (VALUES {_rows(QUESTIONS)}) q(id, question), i WHERE len(list_intersect({_TOK.format('question')}, string_split(triggers, ' '))) > 0)
SELECT q.id, coalesce(s.intent, 'open') AS intent, coalesce(s.shape, 'open') AS shape FROM (VALUES {_rows(QUESTIONS)}) q(id, question) LEFT JOIN s ON s.id = q.id AND s.n = 1""",
    "q48_multiset_match": """WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 <> 3),
x AS (SELECT count(*) AS only_a FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), y AS (SELECT count(*) AS only_b FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM x, y""",
}
