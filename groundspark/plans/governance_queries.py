"""Queries through the policy boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import policy
from ..operators.roles import GovernedSql, parquet

TABLES = ("customer", "orders", "nation", "region", "lineitem", "part", "supplier")
PUBLIC_ORDERS = "SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)"


def boundary(spark: SparkSession, sf_dir: str) -> GovernedSql:
    return GovernedSql(spark, {t: parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}, policy.load(policy.SAMPLE))


def governed(role: str, text: str, action: str = "query"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boundary(spark, sf_dir).query(role, text, action)

    return run


FLAGSHIP = "SELECT c_custkey, c_name, c_acctbal, n_name, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY value DESC, c_custkey LIMIT 5"
flagship = governed("public", FLAGSHIP)

ROLE_ROWS = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"
ROLE_MASK = "SELECT c_nationkey, COUNT(*) AS n, COUNT(c_acctbal) AS shown FROM customer GROUP BY c_nationkey"
CAPPED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def q32_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.concat(F.when(F.col("p_size") % 3 == 0, "=").when(F.col("p_size") % 3 == 1, "-").otherwise(""), F.col("p_name"))
    return d.select("p_partkey", T.csv_safe(raw).alias("cell"))


def q33_licence_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boundary(spark, sf_dir)
    rows = [(role, x, notice) for role in ("public", "analyst", "steward") for x, notice in b.obligations(role, "SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey")]
    return spark.createDataFrame(rows, "role string, licence string, notice string")


def q51_audit_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return d.select("item_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_chars"))


QUOTED = "SELECT \"r_name\" AS \"name\", COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE \"r_name\" <> 'r_name' AND \"n_name\" > 'N' GROUP BY \"r_name\""


def q68_denied_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary(spark, sf_dir).denied_sources("public", "orders", "o_orderkey", ("order:", "invoice:"))


QUERIES = {
    "q00_flagship": flagship,
    "q29_role_view_rows": governed("public", ROLE_ROWS),
    "q30_role_view_mask": governed("public", ROLE_MASK),
    "q31_row_cap": governed("public", CAPPED),
    "q32_csv_safe": q32_csv_safe,
    "q33_licence_obligations": q33_licence_obligations,
    "q51_audit_digest": q51_audit_digest,
    "q67_quoted_identifiers": governed("steward", QUOTED),
    "q68_denied_sources": q68_denied_sources,
}
SQL = {
    "q00_flagship": f"WITH orders AS ({PUBLIC_ORDERS}), customer AS (SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer) {FLAGSHIP}",
    "q29_role_view_rows": f"WITH orders AS ({PUBLIC_ORDERS}) {ROLE_ROWS}",
    "q30_role_view_mask": """WITH rule AS (SELECT * FROM (VALUES ('public', 'mask'), ('steward', 'allow')) r(role, effect))
SELECT c_nationkey, COUNT(*) AS n, COUNT(CASE WHEN effect = 'allow' THEN c_acctbal END) AS shown FROM customer CROSS JOIN rule WHERE role = 'public' GROUP BY c_nationkey""",
    "q31_row_cap": f"WITH orders AS ({PUBLIC_ORDERS}) {CAPPED} LIMIT 100",
    "q32_csv_safe": "SELECT p_partkey, CASE WHEN c LIKE '=%' OR c LIKE '-%' OR c LIKE '+%' OR c LIKE '@%' THEN '''' || c ELSE c END AS cell FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '=' WHEN p_size % 3 = 1 THEN '-' ELSE '' END || p_name AS c FROM part)",
    "q33_licence_obligations": """WITH owed AS (SELECT * FROM (VALUES ('customer', 'crm'), ('orders', 'sales'), ('customer.c_acctbal', 'finance'), ('nation', 'open')) o(what, licence)),
notices AS (SELECT * FROM (VALUES ('crm', 'Customer data terms'), ('sales', 'Sales data terms'), ('finance', 'Restricted figures'), ('open', 'Open data')) n(licence, notice)),
used AS (SELECT table_name AS what FROM information_schema.tables WHERE table_name IN ('customer', 'orders') GROUP BY table_name)
SELECT DISTINCT role, licence, notice FROM (VALUES ('public'), ('analyst'), ('steward')) r(role), used JOIN owed USING (what) JOIN notices USING (licence)""",
    "q67_quoted_identifiers": QUOTED,
    "q68_denied_sources": f"WITH hidden AS (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM ({PUBLIC_ORDERS}) v) SELECT unnest(['order:' || o_orderkey, 'invoice:' || o_orderkey]) AS source FROM hidden",
    "q51_audit_digest": "SELECT item_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark",
}
