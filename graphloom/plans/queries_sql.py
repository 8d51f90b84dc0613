"""The delegated SQL surface: each statement passes the guard and runs as it stands.

The same text is the oracle, so these queries check dialect and semantics of
the engine's SQL against another engine.
"""

from __future__ import annotations

from graphloom.plans import sqlguard, views
from graphloom.plans.base import ORACLES, QUERIES

STATEMENTS = {
    "sql_join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "sql_join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "sql_join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "sql_join_full": "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation AS a FULL OUTER JOIN supplier AS b ON a.n_nationkey = b.s_nationkey AND b.s_acctbal > 0",
    "sql_join_cross": "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n",
    "sql_join_range": "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_acctbal >= n_nationkey * 400 AND s_acctbal < n_nationkey * 400 + 500",
    "sql_join_interval": "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND b.l_shipdate >= a.l_shipdate - INTERVAL 20 DAY AND b.l_shipdate <= a.l_shipdate + INTERVAL 20 DAY",
    "sql_join_asof": "SELECT e.event_id, max_by(p.event_id, p.event_id) AS last_purchase FROM events AS e LEFT JOIN events AS p ON p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'purchase' GROUP BY e.event_id",
    "sql_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "sql_anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_scalar_subquery": "SELECT p_partkey, (SELECT max(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS most FROM part",
    "sql_agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "sql_agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "sql_agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_agg_grouping_sets": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS n FROM orders",
    "sql_window_lag": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "sql_window_rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
    "sql_window_range_frame": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS near FROM lineitem",
    "sql_window_ntile": "SELECT p_partkey, CAST(ntile(4) OVER (ORDER BY p_retailprice, p_partkey) AS BIGINT) AS quarter FROM part",
    "sql_set_union": "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer",
    "sql_set_union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "sql_set_intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0",
    "sql_set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE total > 1500000",
    "sql_recursive_cte": "WITH RECURSIVE walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT node * 2, depth + 1 FROM walk WHERE depth < 5) SELECT node, depth FROM walk",
    "sql_order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "sql_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand NOT LIKE '%3'",
    "sql_in_between": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 100000 AND 150000",
    "sql_case": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'mid' ELSE 'low' END AS size FROM lineitem",
    "sql_strings": "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS BIGINT) AS n, substr(n_name, 2, 3) AS s, replace(n_name, 'A', '_') AS r, concat(n_name, '!') AS c, trim(concat(' ', n_name)) AS t FROM nation",
    "sql_dates": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders",
    "sql_math": "SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(sqrt(abs(s_acctbal)), 6) AS q, round(ln(1 + abs(s_acctbal)), 6) AS l FROM supplier",
    "sql_nulls": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer WHERE c_name IS NOT NULL",
}


def _register(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        for t in views.TABLES:
            views.table(spark, sf_dir, t).createOrReplaceTempView(t)
        return sqlguard.run(spark, sql, limit=None)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


for _name, _sql in STATEMENTS.items():
    _register(_name, _sql)
