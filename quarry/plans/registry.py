"""The registry of queries with the SQL that must give the same rows.

Most entries are statements of the dialect, run through the engine; where DuckDB says the
same in other words, the second text is its own.  Others build DataFrames or the JSON form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kv import KeyValue, list_range
from ..session import Engine
from ..sources.catalog import Catalog
from ..streaming import events as streaming

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    """An engine that reads the folder's tables; a file is opened when a query names it."""
    out = Engine(spark, **options)
    out.sources = _Folder(spark, sf_dir)
    return out


class _Folder(dict):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(dict.fromkeys(TABLES))
        self.spark, self.path = spark, path

    def __getitem__(self, name: str) -> DataFrame:
        if super().__getitem__(name) is None:
            self[name] = table(self.spark, self.path, name)
        return super().__getitem__(name)


def sql(key: str, text: str, oracle: str | None = None, params: list | None = None) -> None:
    """A statement of the dialect; the same text is DuckDB's unless another is given ("": none)."""
    _queries[key] = lambda spark, sf_dir: engine(spark, sf_dir).sql(text, params)
    if oracle != "":
        _oracles[key] = oracle or text


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if oracle:
            _oracles[fn.__name__] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    from . import registry_catalog  # noqa: F401  adds its queries

    return dict(_queries)


def oracles() -> dict[str, str]:
    queries()
    return dict(_oracles)


FLAGSHIP = """
SELECT c_custkey, c_mktsegment, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, COUNT(DISTINCT o_orderkey) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_acctbal > 0 GROUP BY c_custkey, c_mktsegment HAVING COUNT(DISTINCT o_orderkey) >= 2
ORDER BY revenue DESC, c_custkey LIMIT 100"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' revenue of several orders: joins, filter, group, having, order, limit."""
    return engine(spark, sf_dir).sql(FLAGSHIP)


sql("flagship", FLAGSHIP)

# Scans and projections
sql("scan_all", "SELECT * FROM region")
sql("project_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
sql("alias_project", "SELECT n.n_name AS nation, n.n_regionkey region FROM nation n")
sql("dual_select", "SELECT 1 AS one, 'a' AS letter, 2.5 AS number", "SELECT 1 AS one, 'a' AS letter, CAST(2.5 AS DECIMAL(2,1)) AS number")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
sql("arith_mul_div", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, round(-l_tax * 100 + 1, 4) AS t FROM lineitem")
sql("int_div", "SELECT p_partkey, p_partkey DIV 7 AS q FROM part", "SELECT p_partkey, CAST(p_partkey // 7 AS BIGINT) AS q FROM part")
sql("modulo", "SELECT p_partkey, p_partkey % 7 AS r FROM part")
sql("literals", "SELECT r_regionkey, TRUE AS t, FALSE AS f, NULL IS NULL AS n, 1e3 AS e, 'it''s' AS s FROM region", "SELECT r_regionkey, TRUE AS t, FALSE AS f, NULL IS NULL AS n, CAST(1e3 AS DOUBLE) AS e, 'it''s' AS s FROM region")

# Predicates
sql("where_and_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 OR o_orderpriority = '1-URGENT'")
sql("where_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000)")
sql("where_cmp_all", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 40 AND p_size <> 20 AND p_size != 21 AND p_retailprice > 900 AND p_retailprice < 1800 AND p_size = p_size")
sql("where_is_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000 WHERE o_orderkey IS NULL")
sql("where_is_not_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 WHERE o_orderkey IS NOT NULL")
sql("where_is_true", "SELECT p_partkey FROM part WHERE (nullif(p_size, 5) > 25) IS TRUE")
sql("where_like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%r%'")
sql("where_like_suffix", "SELECT p_partkey FROM part WHERE p_name LIKE '%ring'")
sql("where_like_contains", "SELECT p_partkey FROM part WHERE p_type LIKE '%CON_M%' OR p_name LIKE '%l_e w%'")
sql("where_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
sql("where_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
sql("where_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql("where_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
sql("where_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
sql("where_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("param_query", "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000", ["O", 200000])
sql("param_query_numbered", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN $1 AND $2 AND o_orderkey > $1 / 1000", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_orderkey > 100", [100000, 150000])

# Joins
sql("join_inner", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000")
sql("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_using", "SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id)")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql(
    "join_multiway",
    """SELECT n_name, r_name, COUNT(*) AS n, round(SUM(l_extendedprice), 2) AS total FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
sql("join_theta_range", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_retailprice < b.p_retailprice AND b.p_retailprice - a.p_retailprice < 5")
sql("join_semi", "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey AND l_quantity > 45)")
sql("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE p_partkey = l_partkey AND l_quantity > 49)")
sql("join_cte", "WITH big AS (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_name, top FROM customer JOIN big ON c_custkey = o_custkey WHERE top > 200000")

# Aggregates
sql("agg_global", "SELECT COUNT(*) AS n, round(SUM(l_quantity), 2) AS q, round(AVG(l_extendedprice), 2) AS p FROM lineitem")
sql("agg_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_shipdate) AS d FROM lineitem WHERE l_quantity < 0")
sql("agg_count_star_vs_col", "SELECT c_nationkey, COUNT(*) AS n, COUNT(o_orderkey) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
sql("agg_sum_avg_min_max", "SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS s, round(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, MAX(l_returnflag) AS f FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("group_by_multi", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("group_by_expr", "SELECT p_size % 5 AS k, COUNT(*) AS n FROM part GROUP BY p_size % 5")
sql("group_plain_column", "SELECT n_nationkey, n_name, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey", "SELECT n_nationkey, any_value(n_name) AS n_name, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
sql("having_agg", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 100000")
sql("having_no_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10")
sql("having_subquery", "SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > (SELECT 1.8 * AVG(o_totalprice) FROM orders)")
sql("distinct_groups", "SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey")
sql("group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name) AS names, GROUP_CONCAT(n_nationkey, '|') AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY n_nationkey) AS ks FROM nation GROUP BY n_regionkey")
sql("json_arrayagg", "SELECT n_regionkey, JSON_ARRAYAGG(nullif(n_nationkey, 5)) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(nullif(n_nationkey, 5) ORDER BY nullif(n_nationkey, 5) NULLS FIRST)) AS VARCHAR) AS ks FROM nation GROUP BY n_regionkey")
sql("json_objectagg", "SELECT n_regionkey, JSON_OBJECTAGG(n_name, n_nationkey) AS o FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(map_from_entries(list((n_name, n_nationkey) ORDER BY n_name))) AS VARCHAR) AS o FROM nation GROUP BY n_regionkey")
sql("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_nested", "SELECT l_returnflag, round(SUM(l_extendedprice) / SUM(l_quantity) + 1, 4) AS v FROM lineitem GROUP BY l_returnflag")

# Windows
_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
sql("win_row_number", f"SELECT o_orderkey, CAST(ROW_NUMBER() {_W} AS BIGINT) AS v FROM orders")
sql("win_rank", "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS v FROM orders")
sql("win_dense_rank", "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS BIGINT) AS v FROM orders")
sql("win_ntile", f"SELECT o_orderkey, CAST(NTILE(4) {_W} AS BIGINT) AS v FROM orders")
sql("win_percent_rank", f"SELECT o_orderkey, round(PERCENT_RANK() {_W}, 6) AS v FROM orders")
sql("win_cume_dist", f"SELECT o_orderkey, round(CUME_DIST() {_W}, 6) AS v FROM orders")
sql("win_first_value", f"SELECT o_orderkey, FIRST_VALUE(o_orderkey) {_W} AS v FROM orders")
sql("win_last_value", f"SELECT o_orderkey, LAST_VALUE(o_orderkey) {_W} AS v FROM orders")
sql("win_nth_value", "SELECT o_orderkey, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
sql("win_lag", f"SELECT o_orderkey, LAG(o_totalprice) {_W} AS v FROM orders")
sql("win_lead", f"SELECT o_orderkey, LEAD(o_totalprice) {_W} AS v FROM orders")
sql("win_lag_offset", f"SELECT o_orderkey, LAG(o_orderkey, 3) {_W} AS v, LEAD(o_orderkey, 2) {_W} AS w FROM orders")
sql("win_rows_frame", "SELECT o_orderkey, round(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS v FROM orders")
sql("win_range_frame", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM part")
sql("win_running_sum", "SELECT l_orderkey, l_linenumber, round(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS v FROM lineitem")
sql("win_topn_per_group", f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() {_W} AS rn FROM orders) t WHERE rn <= 2")
sql("win_after_limit", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS v FROM orders ORDER BY o_orderkey LIMIT 50")
sql("win_many_specs", f"SELECT o_orderkey, CAST(ROW_NUMBER() {_W} AS BIGINT) AS a, CAST(RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS b, COUNT(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders")

# Order and limit
sql("order_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey ASC LIMIT 200")
sql("order_expr", "SELECT p_partkey, p_retailprice * p_size AS v FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 50")
sql("order_nulls", "SELECT p_partkey, nullif(p_size, 10) AS s FROM part ORDER BY s NULLS LAST, p_partkey LIMIT 300", "SELECT p_partkey, nullif(p_size, 10) AS s FROM part ORDER BY s NULLS LAST, p_partkey LIMIT 300")
sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 15")
sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
sql("distinct_before_limit", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 7")

# Set operations
_N, _C, _S = "SELECT n_nationkey AS k FROM nation", "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
sql("union_distinct", f"{_C} UNION {_S}")
sql("union_all", f"{_N} UNION ALL {_S}")
sql("intersect", f"{_C} INTERSECT {_S}")
sql("except", f"{_N} EXCEPT {_S} WHERE s_acctbal > 5000 AND s_nationkey > 12")
sql("setop_chain", f"({_N} EXCEPT {_S}) UNION ALL (SELECT r_regionkey AS k FROM region)")
sql("setop_order_limit", f"{_C} UNION {_N} ORDER BY k DESC LIMIT 5")
sql("intersect_all", f"{_C} INTERSECT ALL {_S}")
sql("except_all", f"{_C} EXCEPT ALL {_S}")

# Common table expressions and subqueries
sql("cte_single", "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM t GROUP BY n")
sql("cte_multi", "WITH a AS (SELECT r_regionkey, r_name FROM region), b AS (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey) SELECT r_name, n FROM a JOIN b ON r_regionkey = n_regionkey")
sql("cte_chained", "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT AVG(t) AS m FROM a) SELECT o_custkey FROM a, b WHERE t > 1.5 * m")
sql("cte_recursive", "WITH RECURSIVE s(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")
sql("scalar_subquery", "SELECT p_partkey, p_retailprice - (SELECT MIN(p_retailprice) FROM part) AS above FROM part")
sql("corr_scalar_eq", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
sql("corr_scalar_noneq", "SELECT n_nationkey, (SELECT COUNT(*) FROM nation b WHERE b.n_nationkey <= a.n_nationkey) AS rnk FROM nation a")
sql("derived_table", "SELECT band, COUNT(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS band FROM customer) x GROUP BY band")

# Functions
sql("fn_lower", "SELECT p_partkey, LOWER(p_type) AS v FROM part")
sql("fn_upper", "SELECT p_partkey, UPPER(p_name) AS v FROM part")
sql("fn_length_bytes", "SELECT doc_id, LENGTH(text) AS v FROM documents", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS v FROM documents")
sql("fn_abs", "SELECT c_custkey, ABS(c_acctbal) AS v FROM customer")
sql("fn_concat", "SELECT c_custkey, CONCAT(c_name, ':', c_mktsegment) AS v, CONCAT('a', nullif(c_mktsegment, 'BUILDING')) AS w FROM customer", "SELECT c_custkey, c_name || ':' || c_mktsegment AS v, 'a' || nullif(c_mktsegment, 'BUILDING') AS w FROM customer")
sql("fn_coalesce", "SELECT c_custkey, COALESCE(nullif(c_mktsegment, 'BUILDING'), nullif(c_mktsegment, 'x'), '?') AS v FROM customer")
sql("fn_replace", "SELECT p_partkey, REPLACE(p_name, 'a', 'oo') AS v FROM part")
sql("fn_ifnull", "SELECT p_partkey, IFNULL(nullif(p_size, 10), -1) AS v FROM part")
sql("fn_if", "SELECT p_partkey, IF(p_size > 25, 'large', 'small') AS v FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS v FROM part")
sql("fn_datediff", "SELECT o_orderkey, CAST(DATEDIFF(o_orderdate, '1995-01-01') AS BIGINT) AS v FROM orders", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS v FROM orders")
sql("fn_date_format", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y-%m-%d %H:%M:%S') AS v, DATE_FORMAT(o_orderdate, '%d/%m/%yT%j') AS w FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS v, strftime(o_orderdate, '%d/%m/%yT%j') AS w FROM orders")
sql("fn_md5", "SELECT p_partkey, MD5(p_name) AS v FROM part")
sql("fn_sha2", "SELECT p_partkey, SHA2(p_name, 256) AS v FROM part", "SELECT p_partkey, sha256(p_name) AS v FROM part")
sql("fn_now", "SELECT r_regionkey, NOW() > TIMESTAMP '2020-01-01 00:00:00' AS v FROM region")
sql("fn_substring", "SELECT p_partkey, SUBSTRING(p_name, 2, 5) AS v, LEFT(p_name, 3) AS l, RIGHT(p_name, 3) AS r FROM part")
sql("fn_trim", "SELECT r_regionkey, TRIM(CONCAT('  ', r_name, ' ')) AS v, LTRIM('  x ') AS l, RTRIM(' x  ') AS r FROM region", "SELECT r_regionkey, TRIM('  ' || r_name || ' ') AS v, LTRIM('  x ') AS l, RTRIM(' x  ') AS r FROM region")
sql("fn_lpad", "SELECT r_regionkey, LPAD(r_name, 12, '*') AS v, RPAD(r_name, 12, '-') AS r FROM region")
sql("fn_round", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice / 7, 2) AS v FROM lineitem")
sql("fn_ceil_floor", "SELECT c_custkey, CAST(CEIL(c_acctbal) AS BIGINT) AS c, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, SIGN(c_acctbal) AS s FROM customer", "SELECT c_custkey, CAST(CEIL(c_acctbal) AS BIGINT) AS c, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, CAST(SIGN(c_acctbal) AS DOUBLE) AS s FROM customer")
sql("fn_pow_sqrt", "SELECT p_partkey, round(POWER(p_size, 2), 4) AS p, round(SQRT(p_size), 6) AS s, round(EXP(p_size / 50.0), 6) AS e, round(LN(p_size), 6) AS l FROM part", "SELECT p_partkey, round(POWER(p_size, 2), 4) AS p, round(SQRT(p_size), 6) AS s, round(EXP(CAST(p_size AS DOUBLE) / 50.0), 6) AS e, round(LN(p_size), 6) AS l FROM part")
sql("fn_greatest_least", "SELECT p_partkey, GREATEST(p_size, 20) AS g, LEAST(p_size, 20) AS l FROM part")
sql("fn_nullif", "SELECT p_partkey, NULLIF(p_size, 10) AS v FROM part")
sql("fn_year_month_day", "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(MONTH(o_orderdate) AS BIGINT) AS m, CAST(DAY(o_orderdate) AS BIGINT) AS d FROM orders")
sql("fn_date_add", "SELECT o_orderkey, DATE_FORMAT(DATE_ADD(CAST(o_orderdate AS DATE), 30), '%Y-%m-%d') AS v FROM orders", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%Y-%m-%d') AS v FROM orders")
sql("fn_extract", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS q FROM orders")
sql("fn_reverse_instr", "SELECT p_partkey, REVERSE(p_name) AS v, CAST(INSTR(p_name, 'a') AS BIGINT) AS i FROM part")

# JSON paths
sql("json_path", "SELECT event_id, CAST(props.k AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("json_path_filter", "SELECT e.event_id FROM events e WHERE e.props.k > 50", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
sql("json_path_group", "SELECT props.k AS k, COUNT(*) AS n FROM events GROUP BY props.k", "SELECT json_extract_string(props, '$.k') AS k, COUNT(*) AS n FROM events GROUP BY 1")
sql("json_path_missing", "SELECT event_id, props.none.deeper AS v FROM events", "SELECT event_id, CAST(NULL AS VARCHAR) AS v FROM events")
sql("variables", "SELECT @unset IS NULL AS u, @@autocommit AS a FROM region", "SELECT TRUE AS u, 1 AS a FROM region")


# Views and materialized views
@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE VIEW places AS SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    return e.sql("SELECT n_name, r_name FROM places WHERE r_name <> 'ASIA'")


@query("SELECT o_orderstatus, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def mview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE MATERIALIZED VIEW totals AS SELECT o_orderstatus, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
    return e.sql("SELECT * FROM totals")


@query("SELECT n_regionkey, COUNT(*) AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT 4 UNION ALL SELECT 9) GROUP BY n_regionkey")
def mview_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("CREATE MATERIALIZED VIEW per_region AS SELECT region, COUNT(*) AS n FROM places GROUP BY region")
    e.sql("INSERT INTO places VALUES (100, 'X', 4), (101, 'Y', 9)")
    return e.sql("SELECT region AS n_regionkey, n FROM per_region")


# Writing: the final rows of a table
def _with_nations(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE places (id INT PRIMARY KEY, name TEXT NOT NULL, region INT DEFAULT 7)")
    e.sql("INSERT INTO places SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return e


_ALL = "SELECT id, name, region FROM places"
_PLACES = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"


@query(f"{_PLACES} UNION ALL SELECT 100, 'X', 7 UNION ALL SELECT 101, 'Y', NULL")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("INSERT INTO places (id, name) VALUES (100, 'X')")
    e.sql("INSERT INTO places VALUES (?, ?, NULL)", [101, "Y"])
    return e.sql(_ALL)


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS region FROM nation")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("UPDATE places SET name = CONCAT(UPPER(name), '!'), region = region + 10 WHERE region = 1")
    return e.sql(_ALL)


@query(f"SELECT * FROM ({_PLACES}) WHERE NOT (region = 2 AND id > 8) AND id NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("DELETE FROM places WHERE region = 2 AND id > 8")
    e.sql("DELETE FROM places WHERE id IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
    return e.sql(_ALL)


@query(f"SELECT * FROM ({_PLACES}) WHERE id NOT IN (3, 4) UNION ALL SELECT 3, 'three', 0 UNION ALL SELECT 4, 'four', 0 UNION ALL SELECT 200, 'new', 0")
def dml_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("REPLACE INTO places VALUES (3, 'three', 0), (4, 'lost', 1), (4, 'four', 0), (200, 'new', 0)")
    return e.sql(_ALL)


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 5 THEN 'five' ELSE n_name END AS name, CASE WHEN n_nationkey = 5 THEN n_regionkey + 50 ELSE n_regionkey END AS region FROM nation UNION ALL SELECT 300, 'n', 1")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("INSERT INTO places VALUES (5, 'five', 50), (300, 'n', 1) ON DUPLICATE KEY UPDATE name = VALUES(name), region = region + VALUES(region)")
    return e.sql(_ALL)


@query(f"{_PLACES} UNION ALL SELECT 400, 'kept', 1")
def dml_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("INSERT IGNORE INTO places VALUES (5, 'x', 1), (400, 'kept', 1), (400, 'late', 2)")
    return e.sql(_ALL)


@query("SELECT CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS id, n_name AS name FROM nation UNION ALL SELECT 26, 'last'")
def dml_autoinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE seq (id INT AUTO_INCREMENT PRIMARY KEY, name TEXT)")
    e.sql("INSERT INTO seq (name) SELECT n_name FROM nation ORDER BY n_name")
    e.sql("INSERT INTO seq VALUES (NULL, 'last')")
    return e.sql("SELECT id, name FROM seq")


@query(_PLACES)
def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    for s in ("BEGIN", "DELETE FROM places", "INSERT INTO places VALUES (1, 'a', 1)", "ROLLBACK"):
        e.sql(s)
    return e.sql(_ALL)


@query(f"SELECT * FROM ({_PLACES}) WHERE region <> 3 UNION ALL SELECT 500, 'a', 1")
def tx_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    for s in ("BEGIN", "DELETE FROM places WHERE region = 3", "SAVEPOINT s", "DELETE FROM places", "ROLLBACK TO SAVEPOINT s", "INSERT INTO places VALUES (500, 'a', 1)", "COMMIT"):
        e.sql(s)
    return e.sql(_ALL)


@query("SELECT n_nationkey AS id, n_name AS title, CAST(n_regionkey AS BIGINT) AS region, 'none' AS note FROM nation")
def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.execute_batch("ALTER TABLE places ADD COLUMN note TEXT DEFAULT 'none'; ALTER TABLE places RENAME COLUMN name TO title; ALTER TABLE places MODIFY COLUMN region BIGINT; ALTER TABLE places RENAME TO sites;")
    return e.sql("SELECT * FROM sites")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 50000")
def prepared_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute_batch("PREPARE q FROM 'SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?'; SET @s = 'P'")
    return e.sql("EXECUTE q USING @s, 50000")


@query("SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def function_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE OR REPLACE FUNCTION twice_and_one(x INT) RETURNS INT RETURN x * 2 + 1")
    return e.sql("SELECT p_partkey, twice_and_one(p_size) AS v FROM part")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def procedure_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE PROCEDURE of_region(IN k INT) BEGIN SELECT n_name FROM nation WHERE n_regionkey = k; END")
    return e.sql("CALL of_region(2)")


# The JSON form
_col = lambda n: {"Column": n}
_int = lambda n: {"Literal": {"Int": n}}
_cmp = lambda a, op, b: {"Comparison": [a, op, b]}
_out = lambda e, n=None: {"expr": e, "alias": n}
_agg = lambda f, *a: {"FunctionCall": {"name": f, "args": list(a)}}


def json_form(key: str, body: dict, oracle: str) -> None:
    _queries[key] = lambda spark, sf_dir: engine(spark, sf_dir).ir({"Select": body})
    _oracles[key] = oracle


json_form("ir_filter_project", {"table": "part", "table_alias": "p", "columns": [_out(_col("p.p_partkey")), _out({"ScalarFunc": {"name": "Upper", "args": [_col("p_name")]}}, "u"), _out({"BinaryOp": [_col("p_size"), "Add", _int(1)]}, "s")], "where_clause": {"And": [{"Between": [_col("p_size"), _int(5), _int(30)]}, {"Or": [{"Like": [_col("p_name"), "%1%"]}, {"In": [_col("p_size"), [_int(7), _int(9)]]}]}]}}, "SELECT p_partkey, upper(p_name) AS u, p_size + 1 AS s FROM part WHERE p_size BETWEEN 5 AND 30 AND (p_name LIKE '%1%' OR p_size IN (7, 9))")
json_form("ir_group_having", {"table": "orders", "columns": [_out(_col("o_custkey")), _out(_agg("Count", "Star"), "n"), _out(_agg("Max", _col("o_totalprice")), "top")], "group_by": [_col("o_custkey")], "having": _cmp(_agg("Count", "Star"), "Gt", _int(10)), "order_by": [{"expr": _col("n"), "order": "Desc"}, {"expr": _col("o_custkey"), "order": "Asc"}], "limit": {"count": 30, "offset": 2}}, "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 ORDER BY n DESC, o_custkey LIMIT 30 OFFSET 2")
json_form("ir_window", {"table": "orders", "columns": [_out(_col("o_orderkey")), _out({"WindowFunc": {"func_type": "Rank", "args": [], "partition_by": [_col("o_custkey")], "order_by": [{"expr": _col("o_orderpriority"), "order": "Asc"}]}}, "r"), _out({"WindowFunc": {"func_type": "Lag", "args": [_col("o_orderkey"), _int(2)], "partition_by": [_col("o_custkey")], "order_by": [{"expr": _col("o_orderkey"), "order": "Asc"}]}}, "l")]}, "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, LAG(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders")
json_form("ir_join_order_limit", {"table": "customer", "table_alias": "c", "columns": [_out(_col("c.c_name"), "name"), _out(_col("o.o_orderkey"), "k")], "joins": [{"table": "orders", "table_alias": "o", "join_type": "Left", "on": _cmp(_col("c.c_custkey"), "Eq", _col("o.o_custkey"))}], "where_clause": {"Not": {"Is": [_col("o.o_orderkey"), "Null"]}}, "order_by": [{"expr": _col("o.o_totalprice"), "order": "Desc"}, {"expr": _col("k"), "order": "Asc"}], "limit": {"count": 40}}, "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
json_form("ir_setops_cte", {"with_clause": {"recursive": False, "ctes": [{"name": "t", "query": {"table": "nation", "columns": [_out(_col("n_regionkey"), "k")], "where_clause": _cmp(_col("n_nationkey"), "Lt", _int(9))}}]}, "table": "t", "columns": [_out(_col("k"))], "set_operations": [{"operator": "Union", "select": {"table": "region", "columns": [_out(_col("r_regionkey"), "k")]}}, {"operator": "Except", "select": {"table": "region", "columns": [_out(_col("r_regionkey"), "k")], "where_clause": _cmp(_col("r_name"), "Eq", {"Literal": {"Text": "ASIA"}})}}], "order_by": [{"expr": _col("k"), "order": "Desc"}], "limit": {"count": 3}}, "(SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 9 UNION SELECT r_regionkey FROM region) EXCEPT SELECT r_regionkey FROM region WHERE r_name = 'ASIA' ORDER BY k DESC LIMIT 3")
json_form("ir_subqueries", {"table": "customer", "table_alias": "c", "columns": [_out(_col("c.c_custkey"), "k"), _out({"Subquery": {"table": "orders", "table_alias": "o", "columns": [_out(_agg("Max", _col("o.o_totalprice")), "m")], "where_clause": _cmp(_col("o.o_custkey"), "Eq", _col("c.c_custkey"))}}, "top")], "where_clause": {"And": [{"InSubquery": [_col("c.c_nationkey"), {"table": "supplier", "columns": [_out(_col("s_nationkey"))]}]}, {"Exists": {"table": "orders", "table_alias": "x", "columns": [_out(_int(1), "one")], "where_clause": {"And": [_cmp(_col("x.o_custkey"), "Eq", _col("c.c_custkey")), _cmp(_col("x.o_totalprice"), "Gt", _int(100000))]}}}]}}, "SELECT c_custkey AS k, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
json_form("ir_case_json", {"table": "events", "columns": [_out(_col("event_id")), _out({"CaseWhen": {"conditions": [[_cmp(_col("value"), "Gt", _int(50)), {"Literal": {"Text": "high"}}]], "else_expr": {"Literal": {"Text": "low"}}}}, "band"), _out(_col("props.k"), "k")]}, "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, json_extract_string(props, '$.k') AS k FROM events")


# Search
_TOKENS = "regexp_extract_all(lower(coalesce(CAST(doc_id AS VARCHAR) || ' ' || text, CAST(doc_id AS VARCHAR))), '[\\p{L}\\p{N}]+')"
#: BM25 of two words over a table of numbers and texts, k1 = 1.2, b = 0.75.
_BM25 = f"""
WITH d AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents),
     x AS (SELECT doc_id, text, greatest(len(w), 1) AS n, len(list_filter(w, lambda t: t = 'worthless')) AS a, len(list_filter(w, lambda t: t = 'license')) AS b FROM d),
     c AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM x)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 4) AS score
FROM x, c WHERE a + b > 0 ORDER BY 2 DESC, doc_id LIMIT 100"""


@query(_BM25)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("texts", table(spark, sf_dir, "documents").select("doc_id", "text"))
    return e.sql("SEARCH texts 'worthless license'").select("doc_id", F.round("_score", 4).alias("score"))


@query(_BM25)
def search_index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a table's index, of which a part was added and a part changed later."""
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE texts (doc_id BIGINT, text TEXT)")
    e.sql("INSERT INTO texts SELECT doc_id, text FROM documents WHERE doc_id % 3 > 0")
    e.sql("SEARCH texts 'license'")
    e.sql("INSERT INTO texts SELECT doc_id, CONCAT('license ', text) FROM documents WHERE doc_id % 3 = 0")
    e.sql("SEARCH texts 'license'")
    e.sql("UPDATE texts SET text = SUBSTRING(text, 9) WHERE doc_id % 3 = 0")
    e.sql("INSERT INTO texts VALUES (-1, 'worthless license')")
    e.sql("DELETE FROM texts WHERE doc_id = -1")
    return e.sql("SEARCH texts 'worthless license'").select("doc_id", F.round("_score", 4).alias("score"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])license($|[^\\p{L}\\p{N}])') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])apache($|[^\\p{L}\\p{N}])') AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])idiot($|[^\\p{L}\\p{N}])')")
def search_must_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), "+license +apache -idiot", top=None).select("doc_id")


# Key-value structures
def _kv(spark: SparkSession) -> KeyValue:
    return KeyValue(Catalog(spark))


@query("SELECT 'c:' || c_custkey AS key, 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT 'c:' || c_custkey, 'name', c_name FROM customer")
def kv_hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key")
    e.kv.load("kv_hash", c.select(key, F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")).union(c.select(key, F.lit("name"), "c_name")))
    return e.sql("SELECT * FROM information_schema.kv_hash")


@query("SELECT key, score, member FROM (SELECT 'n:' || s_nationkey AS key, s_acctbal AS score, s_name AS member, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_name) AS rn FROM supplier) WHERE rn <= 3")
def kv_zset_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark)
    s = table(spark, sf_dir, "supplier")
    kv.load("kv_zset", s.select(F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("key"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("member")))
    rows = list_range(kv.table("kv_zset"), "key", 0, 2, ["score", "member"], F.struct("score", "member").alias("v"))
    return rows.select("key", "v.score", "v.member")


@query("SELECT key, index, value FROM (SELECT 'o:' || o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index, CAST(o_orderkey AS VARCHAR) AS value, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE index BETWEEN greatest(n - 2, 0) AND n - 1")
def kv_list_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark)
    o = table(spark, sf_dir, "orders")
    kv.load("kv_list", o.select(F.concat(F.lit("o:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("index"), F.col("o_orderkey").cast("string").alias("value")))
    return list_range(kv.table("kv_list"), "key", -2, -1, ["index"], "value")


@query("SELECT event_type AS key, event_id AS id, json_extract_string(props, '$.k') AS value FROM events WHERE event_id BETWEEN 100 AND 400")
def kv_stream_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark)
    ev = table(spark, sf_dir, "events")
    kv.load("kv_stream", ev.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.lit("k").alias("field"), F.get_json_object("props", "$.k").alias("value")))
    return kv.table("kv_stream").filter(F.col("id").between(100, 400)).select("key", "id", "value")


@query("SELECT DISTINCT c_mktsegment AS key, CAST(c_nationkey AS VARCHAR) AS member FROM customer")
def kv_set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark)
    kv.load("kv_set", table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("member")).distinct())
    return kv.table("kv_set")


# Windows over event time, as a batch
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n, round(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.tumbling(table(spark, sf_dir, "events"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS session_start, COUNT(*) AS n FROM y GROUP BY user_id, s")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sessions(table(spark, sf_dir, "events").filter("user_id is not null"), gap="6 hours")


# The catalog
@query("SELECT * FROM (VALUES ('default', 'places', 'id', 'INT', 1, FALSE), ('default', 'places', 'name', 'TEXT', 2, FALSE), ('default', 'places', 'region', 'INT', 3, FALSE)) t(table_schema, table_name, column_name, data_type, ordinal_position, is_auto_increment)")
def infoschema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir).sql("SELECT * FROM information_schema.columns")


@query("SELECT 'places' AS table_name, 'BASE TABLE' AS table_type, COUNT(*) AS row_count FROM nation")
def infoschema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir).sql("SELECT table_name, table_type, row_count FROM information_schema.tables")


@query("SELECT * FROM (VALUES ('SCAN', 'Relation', 2), ('FILTER', 'WHERE', 2), ('PROJECT', 'Project', 3), ('JOIN', 'Inner', 1), ('AGGREGATE', 'Aggregate', 1), ('FILTER', 'HAVING', 1), ('ORDER', 'Sort', 1), ('LIMIT', 'GlobalLimit', 1)) t(stage, operation, n)")
def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).sql("EXPLAIN SELECT o_custkey, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING COUNT(*) > 3 ORDER BY n LIMIT 5")
    return rows.groupBy("stage", "operation").agg(F.count(F.lit(1)).alias("n"))


@query(_PLACES)
def dump_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _with_nations(spark, sf_dir)
    second = engine(spark, sf_dir)
    second.restore(first.dump())
    return second.sql(_ALL)
