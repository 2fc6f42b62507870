"""The SQL surface: scans, predicates, joins, aggregation, top-k, set operations, scalar functions.

Each query is Spark SQL over views of the tables it names.  The same text runs
on DuckDB unless a second one is given.  Sums of doubles go through exact
decimals, and every top-k has a total order, so results don't depend on the
order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.numbering import row_numbers
from ..session import open_tables

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, tables: str, text: str, duck: str | None = None, deal=None) -> None:
    """deal (session) lays out views anew where the text alone gives too few tasks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = open_tables(spark, sf_dir, *tables.split())
        if deal:
            deal(own)
        return own.sql(text)

    QUERIES[name], SQL[name] = run, duck or text


def exact_sum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def exact_avg(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({x})"


register("q01_scan_project", "customer", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer")
register("q02_like_and", "part", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%widget%' AND p_type LIKE 'S%' AND p_size <> 7 AND p_retailprice >= 901 AND 1 = 1")
register("q03_between_in", "orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IS NOT NULL")
register("q04_ilike_probe", "customer", "SELECT DISTINCT c_name FROM customer WHERE c_name ILIKE '%CUSTOMER#00000012%' ORDER BY c_name LIMIT 5")
register("q05_coalesce_case", "orders", """
SELECT o_orderkey, NOT COALESCE(CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END, false) AS is_open,
  CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS bucket,
  (o_orderstatus = 'P') AS pending FROM orders""")
register("q06_inner_equi", "orders customer", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
register("q07_using", "customer nation", "SELECT k, c_name, n_name FROM (SELECT c_nationkey AS k, c_name FROM customer) a JOIN (SELECT n_nationkey AS k, n_name FROM nation) b USING (k)")
register("q08_star_join", "lineitem orders customer nation", f"""
SELECT n_name, COUNT(*) AS n, {exact_sum('l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY n_name""")
register("q09_self_join_pairs", "lineitem supplier nation", """
SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, COUNT(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
JOIN supplier sa ON a.l_suppkey = sa.s_suppkey JOIN supplier sb ON b.l_suppkey = sb.s_suppkey JOIN nation na ON sa.s_nationkey = na.n_nationkey JOIN nation nb ON sb.s_nationkey = nb.n_nationkey
WHERE na.n_regionkey = nb.n_regionkey GROUP BY a.l_suppkey, b.l_suppkey ORDER BY n DESC, s1, s2 LIMIT 20""")
register("q10_theta_range_join", "customer", "SELECT c_custkey, explode(sequence(1L, c_custkey % 3 + 1)) AS k FROM customer", "SELECT c_custkey, g.k FROM customer JOIN range(1, 4) g(k) ON g.k <= c_custkey % 3 + 1")
register("q11_semi_in", "customer orders lineitem nation", """
SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey IN
(SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45))""")
register("q12_anti_except", "customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 0")
register("q13_exists_cte_shadow", "customer orders", "WITH orders AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
register("q14_global_agg", "orders", f"SELECT COUNT(*) AS n, {exact_sum('o_totalprice')} AS total, {exact_avg('o_totalprice')} AS mean, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders")
register("q15_group_count", "orders", "SELECT CAST(year(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders GROUP BY y")
register("q16_group_avg_count", "orders", f"SELECT CAST(year(o_orderdate) AS INT) AS y, {exact_avg('o_totalprice')} AS mean, COUNT(*) AS n FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY y")
register("q17_decade_bin", "part", "SELECT CAST(p_size div 10 * 10 AS INT) AS decade, COUNT(*) AS n FROM part GROUP BY decade", "SELECT CAST(p_size // 10 * 10 AS INT) AS decade, COUNT(*) AS n FROM part GROUP BY decade")
register("q18_having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
register("q19_count_distinct", "lineitem", "SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey")
register("q20_union_all_scalars", "orders part customer", f"SELECT 'orders' AS t, {exact_avg('o_totalprice')} AS mean FROM orders UNION ALL SELECT 'part', {exact_avg('p_retailprice')} FROM part UNION ALL SELECT 'customer', {exact_avg('c_acctbal')} FROM customer")
register("q21_union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
register("q22_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
register("q22b_top1", "customer orders", "SELECT c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name ORDER BY n DESC, c_name LIMIT 1")
register("q23_tie_probe", "orders", """
SELECT MIN(v) AS last_in, MIN(w) AS first_out, MIN(v) > MIN(w) AS safe FROM (SELECT CASE WHEN k <= 10 THEN o_totalprice END AS v, CASE WHEN k = 11 THEN o_totalprice END AS w
FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM (SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 11) t) u) z""")


def q24_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = open_tables(spark, sf_dir, "customer").sql("SELECT c_custkey AS id, explode(sequence(1L, c_custkey % 3 + 1)) AS k FROM customer")
    return row_numbers(each, "ticket", "id", "k")


QUERIES["q24_row_number"] = q24_row_number
SQL["q24_row_number"] = "SELECT row_number() OVER (ORDER BY c_custkey, k) AS ticket, c_custkey AS id, g.k FROM customer JOIN range(1, 4) g(k) ON g.k <= c_custkey % 3 + 1"
register("q25_split_explode_group", "part", "SELECT w, COUNT(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS w FROM part) t GROUP BY w", "SELECT w, COUNT(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) t GROUP BY w")
register("q26_try_cast", "part", "SELECT p_partkey, try_cast(substr(p_brand, 7) AS INT) AS brand_no, try_cast(p_name AS DOUBLE) AS bad, try_cast('0' AS BOOLEAN) AS flag FROM part", "SELECT p_partkey, try_cast(substr(p_brand, 7) AS INT) AS brand_no, try_cast(p_name AS DOUBLE) AS bad, try_cast('0' AS BOOLEAN) AS flag FROM part")
register("q27_json_props", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
register("q53_left_outer", "customer orders", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
register("q54_full_outer", "nation region", "SELECT r_name, n_name FROM nation FULL OUTER JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 10")
register("q55_window_rank", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k <= 2")
register("q56_nulls_last", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS k FROM customer ORDER BY k ASC NULLS LAST, c_custkey LIMIT 15")
register("q57_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
register("q58_safe_division", "part", "SELECT p_partkey, p_retailprice / nullif(p_size - 5, 0) AS ratio, p_partkey % 7 AS m, p_name || '/' || CAST(p_partkey AS STRING) AS label FROM part", "SELECT p_partkey, p_retailprice / nullif(p_size - 5, 0) AS ratio, p_partkey % 7 AS m, p_name || '/' || CAST(p_partkey AS VARCHAR) AS label FROM part")


#: Pairs of customer and supplier that one task of q60 looks at; about a million rows come of them.
PAIRS = 250_000_000


def _deal_pairs(own: SparkSession) -> None:
    """25 nations make 25 keys, and the rows grow with the product of the tables: customers are dealt by key into tasks of equal output.

    Suppliers are sent to all: the product is out of reach long before they are too many for that.
    """
    c, s = own.table("customer"), own.table("supplier")
    n = max(1, -(-c.count() * s.count() // PAIRS))
    c.repartition(n, "c_custkey").createOrReplaceTempView("customer")
    F.broadcast(s).createOrReplaceTempView("supplier")


register("q60_natural_join", "customer nation supplier", "SELECT k, c_name, s_name FROM (SELECT c_nationkey AS k, c_name FROM customer WHERE c_custkey % 10 = 0) c NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier) s", deal=_deal_pairs)
register("q61_explode_join", "part lineitem", """
SELECT w, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM (SELECT p_partkey, explode(split(p_name, ' ')) AS w FROM part) x JOIN lineitem ON l_partkey = p_partkey GROUP BY w""",
"SELECT w, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) x JOIN lineitem ON l_partkey = p_partkey GROUP BY w")
register("q62_counts_without_nulls", "orders", "SELECT o_orderpriority, COUNT(*) AS n, COUNT(x) AS known, CAST(SUM(x) AS BIGINT) AS total FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS x FROM orders) t GROUP BY o_orderpriority")


def _part_text(spark: SparkSession, sf_dir: str, made: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(made).alias("x"))


def q63_wiki_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "concat('{{Box|a={{b|c}}}}', repeat(chr(39), 3), p_name, repeat(chr(39), 3), ' [[', p_brand, '|', p_type, ']]<ref name=x>y</ref> [[File:a.png|thumb|z]]<!-- c -->')"
    return _part_text(spark, sf_dir, made).select("p_partkey", T.strip_wikitext(F.col("x")).alias("text"))


def q64_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "concat('lead', chr(10), '== Cast ==', chr(10), p_brand, chr(10), CASE p_size % 3 WHEN 0 THEN '=== plot ===' WHEN 1 THEN '==SYNOPSIS==' ELSE '== Other ==' END, chr(10), p_name, chr(10), '== End ==', chr(10), 'x')"
    return _part_text(spark, sf_dir, made).select("p_partkey", T.section(F.col("x")).alias("text"))


def q65_json_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "CASE WHEN p_size % 5 = 0 THEN 'no json' ELSE to_json(array(p_brand, '', p_type)) END"
    return _part_text(spark, sf_dir, made).select("p_partkey", F.explode(T.json_names(F.col("x"))).alias("name"))


def q66_triple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "concat(p_name, ' | HAS_BRAND | ', p_brand, chr(10), 'no triple', chr(10), p_name, ' | UNKNOWN | x', chr(10), p_name, '|HAS_TYPE|', p_type, chr(10), p_name, ' | HAS_TYPE | ')"
    return _part_text(spark, sf_dir, made).select("p_partkey", F.explode(T.triple_lines(F.col("x"), ("HAS_BRAND", "HAS_TYPE"))).alias("t")).select("p_partkey", "t.*")


for _q, _sql in (
    (q63_wiki_text, "SELECT p_partkey, p_name || ' ' || p_type AS text FROM part"),
    (q64_section, "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_name ELSE '' END AS text FROM part"),
    (q65_json_names, "SELECT p_partkey, unnest([p_brand, p_type]) AS name FROM part WHERE p_size % 5 <> 0"),
    (q66_triple_lines, "SELECT p_partkey, p_name AS subject, 'HAS_BRAND' AS relation, p_brand AS object FROM part UNION ALL SELECT p_partkey, p_name, 'HAS_TYPE', p_type FROM part"),
):
    QUERIES[_q.__name__], SQL[_q.__name__] = _q, _sql


def q28_markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.strip_tags(F.col("html")).alias("text"))


QUERIES["q28_markup_clean"] = q28_markup_clean
SQL["q28_markup_clean"] = r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages"


def q59_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return d.select("conv_id", "turn", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(T.token_set(F.col("text"))).alias("n_distinct"))


QUERIES["q59_tokenize"] = q59_tokenize
SQL["q59_tokenize"] = "SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS n_tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS INT) AS n_distinct FROM conversations"
