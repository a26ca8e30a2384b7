"""The SQL surface: queries given as text."""

from .registry import query

TEXTS = {
    "sql_cte_having": (
        ("orders",),
        "WITH per AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 10) SELECT o_custkey, n, total FROM per WHERE total > 1000",
    ),
    "sql_exists": (("customer", "orders"), "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"),
    "sql_not_exists": (("part", "lineitem"), "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)"),
    "sql_in_subquery": (("supplier", "nation", "region"), "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))"),
    "sql_scalar_subquery": (("orders",), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)"),
    "sql_correlated_scalar": (("orders",), "SELECT o_orderkey FROM orders a WHERE o_totalprice > (SELECT avg(b.o_totalprice) * 1.8 FROM orders b WHERE b.o_custkey = a.o_custkey)"),
    "sql_rollup_rank": (
        ("lineitem",),
        "SELECT l_returnflag, l_linestatus, g, n, CAST(rank() OVER (PARTITION BY g ORDER BY n DESC) AS BIGINT) AS place FROM (SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) x",
    ),
    "sql_union_intersect_except": (
        ("customer", "supplier", "nation"),
        "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 UNION ALL (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0)",
    ),
    "sql_case_coalesce": (("events",), "SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS kind, CASE WHEN value BETWEEN 10 AND 20 THEN 'low' WHEN value > 90 THEN 'high' END AS band FROM events"),
    "sql_full_join": (
        ("customer", "supplier"),
        "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 7000 GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9800 GROUP BY c_nationkey) b ON a.k = b.k",
    ),
    "sql_stddev_distinct": (("lineitem",), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY l_returnflag"),
    "sql_rows_frame": (("orders",), "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders"),
    "sql_substr_cast": (("customer",), "SELECT substr(c_name, 10, 3) AS part, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY substr(c_name, 10, 3)"),
    "sql_rollup_rank_in_parent": (
        ("lineitem", "supplier", "nation"),
        "SELECT level, n_regionkey, n_name, revenue, CAST(rank() OVER (PARTITION BY level, CASE WHEN level = 0 THEN n_regionkey END ORDER BY revenue DESC) AS BIGINT) AS place FROM (SELECT CAST(grouping(n_regionkey) + grouping(n_name) AS BIGINT) AS level, n_regionkey, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)) x",
    ),
    "sql_cumulative_full_join": (
        ("events",),
        "WITH a AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY CAST(ts AS DATE)), b AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY CAST(ts AS DATE)) SELECT d, CAST(sum(clicks) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS clicks, CAST(sum(buys) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS buys FROM (SELECT coalesce(a.d, b.d) AS d, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS buys FROM a FULL OUTER JOIN b ON a.d = b.d) x",
    ),
    "sql_overlap_counts": (
        ("events",),
        "WITH a AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'error' AND value > 50) SELECT CAST(sum(CASE WHEN a.u IS NOT NULL AND b.u IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a.u IS NULL AND b.u IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN a.u IS NOT NULL AND b.u IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both FROM a FULL OUTER JOIN b ON a.u = b.u",
    ),
    "sql_case_of_subqueries": (
        ("lineitem", "region"),
        "SELECT r_name, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 100 THEN (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_tax), 6) FROM lineitem) END AS chosen FROM region",
    ),
    "sql_best_and_worst": (
        ("lineitem",),
        "WITH m AS (SELECT l_suppkey AS s, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_suppkey) SELECT a.place, a.s AS best, b.s AS worst FROM (SELECT s, CAST(row_number() OVER (ORDER BY price DESC, s) AS BIGINT) AS place FROM m) a JOIN (SELECT s, CAST(row_number() OVER (ORDER BY price, s) AS BIGINT) AS place FROM m) b ON a.place = b.place WHERE a.place <= 10",
    ),
    "sql_neighbour_months": (
        ("orders",),
        "WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, month(o_orderdate) AS m, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority, year(o_orderdate), month(o_orderdate)) SELECT p, CAST(y AS BIGINT) AS y, CAST(m AS BIGINT) AS m, total, lag(total) OVER (PARTITION BY p ORDER BY y, m) AS before, lead(total) OVER (PARTITION BY p ORDER BY y, m) AS after, round(avg(total) OVER (PARTITION BY p, y), 4) AS mean FROM m",
    ),
    "sql_spread_over_mean": (
        ("lineitem",),
        "SELECT l_suppkey, n, round(sd / mean, 6) AS spread FROM (SELECT l_suppkey, count(*) AS n, stddev_samp(l_quantity) AS sd, avg(l_quantity) AS mean FROM lineitem GROUP BY l_suppkey) x WHERE CASE mean WHEN 0 THEN 0 ELSE sd / mean END > 0.5",
    ),
    "sql_frequent_then_joined": (
        ("lineitem", "orders", "customer"),
        "WITH often AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 32), best AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 1.2 * avg(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) y)) SELECT c_mktsegment, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_partkey IN (SELECT l_partkey FROM often) AND o_custkey IN (SELECT o_custkey FROM best) GROUP BY c_mktsegment",
    ),
    "sql_common_in_three": (
        ("events",),
        "SELECT count(*) AS n FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view' INTERSECT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click' INTERSECT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase') x",
    ),
    "sql_in_one_only": (
        ("events",),
        "SELECT count(*) AS n FROM ((SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view') EXCEPT (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click')) x",
    ),
    "sql_buckets_side_by_side": (
        ("lineitem",),
        "SELECT * FROM (SELECT round(avg(l_extendedprice), 4) AS a, count(l_extendedprice) AS an, count(DISTINCT l_extendedprice) AS ad FROM lineitem WHERE l_quantity BETWEEN 0 AND 10 AND (l_discount BETWEEN 0.02 AND 0.05 OR l_tax > 0.06)) x, (SELECT round(avg(l_extendedprice), 4) AS b, count(l_extendedprice) AS bn, count(DISTINCT l_extendedprice) AS bd FROM lineitem WHERE l_quantity BETWEEN 11 AND 20 AND (l_discount BETWEEN 0.05 AND 0.09 OR l_tax < 0.02)) y",
    ),
    "sql_union_of_channels": (
        ("supplier", "customer"),
        "SELECT channel, k, n FROM (SELECT 'supplier' AS channel, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'customer' AS channel, c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) x WHERE n >= 2",
    ),
    "sql_not_in_and_or": (
        ("part", "lineitem"),
        "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND (p_size < 10 OR p_type LIKE '%A%') GROUP BY p_brand",
    ),
    "sql_order_by_aggregate": (("nation",), "SELECT n_regionkey, count(*) AS n, min(n_name) AS first, CAST(max(length(n_name)) - min(length(n_name)) AS BIGINT) AS spread FROM nation GROUP BY n_regionkey ORDER BY n DESC, n_regionkey"),
    "sql_year_over_year": (
        ("customer", "orders"),
        "WITH y AS (SELECT c_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, year(o_orderdate)) SELECT a.k, CAST(a.y AS BIGINT) AS y, round(b.total / a.total, 6) AS growth FROM y a JOIN y b ON a.k = b.k AND b.y = a.y + 1 WHERE b.total > a.total",
    ),
    "sql_channels_year_over_year": (
        ("customer", "orders", "lineitem"),
        "WITH y AS (SELECT 'order' AS channel, o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey, year(o_orderdate) UNION ALL SELECT 'line' AS channel, o_custkey AS k, year(l_shipdate) AS y, sum(l_extendedprice) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, year(l_shipdate)) SELECT o1.k, c_name, CAST(o1.y AS BIGINT) AS y FROM y o1 JOIN y o2 ON o1.k = o2.k AND o2.y = o1.y + 1 JOIN y l1 ON l1.k = o1.k AND l1.y = o1.y JOIN y l2 ON l2.k = o1.k AND l2.y = o1.y + 1 JOIN customer ON c_custkey = o1.k WHERE o1.channel = 'order' AND o2.channel = 'order' AND l1.channel = 'line' AND l2.channel = 'line' AND l2.total / l1.total > o2.total / o1.total",
    ),
    "sql_channels_rollup": (
        ("orders", "lineitem", "supplier", "customer"),
        "WITH gains AS (SELECT s_nationkey AS k, sum(l_extendedprice) AS sales, CAST(0 AS DOUBLE) AS back FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'R' GROUP BY s_nationkey UNION ALL SELECT s_nationkey AS k, CAST(0 AS DOUBLE) AS sales, sum(l_extendedprice) AS back FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY s_nationkey), x AS (SELECT 'supplier' AS channel, k, sum(sales) AS sales, sum(back) AS back FROM gains GROUP BY k UNION ALL SELECT 'customer' AS channel, c_nationkey AS k, sum(o_totalprice) AS sales, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS back FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) SELECT channel, k, round(sum(sales), 2) AS sales, round(sum(back), 2) AS back FROM x GROUP BY ROLLUP(channel, k)",
    ),
    "sql_share_of_class": (
        ("lineitem", "part"),
        "SELECT p_brand, p_type, round(revenue, 2) AS revenue, round(revenue * 100 / sum(revenue) OVER (PARTITION BY p_type), 8) AS share FROM (SELECT p_brand, p_type, sum(l_extendedprice) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-07-01' GROUP BY p_brand, p_type) x",
    ),
    "sql_returned_above_mean": (
        ("lineitem", "orders", "customer"),
        "WITH back AS (SELECT o_custkey AS k, l_suppkey AS s, sum(l_extendedprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_custkey, l_suppkey) SELECT c_name, a.s FROM back a JOIN customer ON c_custkey = a.k WHERE a.total > (SELECT avg(b.total) * 1.2 FROM back b WHERE a.s = b.s) AND c_acctbal > 0",
    ),
    "sql_days_to_ship": (
        ("lineitem", "orders"),
        "SELECT o_orderpriority, CAST(sum(CASE WHEN s <= d + 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(sum(CASE WHEN s > d + 30 AND s <= d + 60 THEN 1 ELSE 0 END) AS BIGINT) AS d60, CAST(sum(CASE WHEN s > d + 60 THEN 1 ELSE 0 END) AS BIGINT) AS more, CAST(sum(CASE WHEN s < d THEN 1 ELSE 0 END) AS BIGINT) AS early FROM (SELECT o_orderpriority, CAST(l_shipdate AS DATE) AS s, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY o_orderpriority",
    ),
    "sql_or_of_exists": (
        ("customer", "orders", "nation"),
        "SELECT n_name, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS most FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'O') AND (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 450000) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')) GROUP BY n_name, c_mktsegment",
    ),
    "sql_above_half_of_month": (
        ("orders",),
        "SELECT p, m, round(total, 2) AS total, round(mean, 4) AS mean FROM (SELECT o_orderpriority AS p, CAST(month(o_orderdate) AS BIGINT) AS m, sum(o_totalprice) AS total, avg(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS mean FROM orders GROUP BY o_orderpriority, month(o_orderdate)) x WHERE abs(total - mean) / mean > 0.05",
    ),
    "tpch_q1": (
        ("lineitem",),
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    ),
    "tpch_q3": (
        ("customer", "orders", "lineitem"),
        "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    ),
    "tpch_q4": (("orders", "lineitem"), "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority"),
    "tpch_q5": (
        ("customer", "orders", "lineitem", "supplier", "nation", "region"),
        "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    ),
    "tpch_q6": (("lineitem",), "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
    "tpch_q10": (
        ("customer", "orders", "lineitem", "nation"),
        "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    ),
    "tpch_q12": (
        ("orders", "lineitem"),
        "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_linestatus",
    ),
    "tpch_q13": (("customer", "orders"), "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) x GROUP BY c_count"),
    "tpch_q14": (("lineitem", "part"), "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey"),
    "tpch_q18": (
        ("customer", "orders", "lineitem"),
        "SELECT c_custkey, o_orderkey, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_custkey, o_orderkey",
    ),
    "tpch_q22": (
        ("customer", "orders"),
        "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
    ),
}

for _name, (_tables, _text) in TEXTS.items():
    query(_text, _name)(lambda t, tables=_tables, text=_text: t.views(*tables).sql(text))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000.0 AND o_orderstatus = 'F'")
def sql_parameters(t):
    return t.views("orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 300000.0, "status": "F"})
