"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins
from .registry import query


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def join_left(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000")
def join_right(t):
    return t.supplier.where("s_acctbal > 8000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_nationkey", "n_name")


@query("SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT s_nationkey AS k, count(*) AS x FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS y FROM customer WHERE c_acctbal > 9500 GROUP BY 1) b ON a.k = b.k")
def join_full_using(t):
    a = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("x"))
    b = t.customer.where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("y"))
    return a.join(b, "k", "full_outer")


@query("SELECT a.k, x, y FROM (SELECT s_nationkey AS k, s_suppkey AS x FROM supplier) a JOIN (SELECT c_nationkey AS k, c_custkey AS y FROM customer WHERE c_acctbal > 9000) b USING (k)")
def join_using(t):
    a = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("x"))
    return a.join(t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("y")), ["k"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def join_anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 350000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    # 5 by 25 rows: the tables are fixed in size.
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def join_self(t):
    a, b = t.orders.alias("a"), t.orders.alias("b")
    same = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderdate") == F.col("b.o_orderdate"))
    return a.join(b, [same, F.col("a.o_orderkey") < F.col("b.o_orderkey")]).select(F.col("a.o_orderkey").alias("first"), F.col("b.o_orderkey").alias("second"))


@query("SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_three_way(t):
    frame = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(joins.small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return frame.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(t):
    return t.customer.join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000")
def join_hints(t):
    orders = t.orders.where("o_totalprice > 300000")
    return t.lineitem.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).hint("rebalance").select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, count(*) AS n FROM events e JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') p USING (user_id) GROUP BY user_id")
def join_salted(t):
    buyers = t.events.where("event_type = 'purchase'").select("user_id").distinct()
    return joins.salted_join(t.events.select("event_id", "user_id"), buyers, ["user_id"], 4).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, band FROM part JOIN (SELECT * FROM (VALUES (0, 900.0, 1000.0), (1, 1000.0, 1250.0), (2, 1200.0, 2500.0)) v(band, low, high)) b ON p_retailprice >= low AND p_retailprice < high")
def join_range(t):
    bands = t.spark.createDataFrame([(0, 900.0, 1000.0), (1, 1000.0, 1250.0), (2, 1200.0, 2500.0)], "band int, low double, high double")
    return joins.range_join(t.part, bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "band")


@query("SELECT e.event_id, p.value AS value_asof FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_as_of(t):
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = t.events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.as_of_join(clicks, buys, "ts", ["user_id"], ["value"], width=86400.0).select("event_id", "value_asof")


@query("SELECT n_nationkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")
def join_natural(t):
    return t.views("nation", "region").sql("SELECT n_nationkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")


@query("SELECT r_name, n_name, n FROM region, LATERAL (SELECT max(n_name) AS n_name, count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")
def join_lateral(t):
    """A subquery that sees the row beside it; Catalyst makes a join of it."""
    return t.views("nation", "region").sql("SELECT r_name, n_name, n FROM region, LATERAL (SELECT max(n_name) AS n_name, count(*) AS n FROM nation WHERE n_regionkey = r_regionkey)")
