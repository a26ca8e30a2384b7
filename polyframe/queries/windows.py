"""Window functions and time windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query

SQL_CUSTOMER = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query(f"SELECT o_orderkey, row_number() OVER {SQL_CUSTOMER} AS n FROM orders")
def row_number(t):
    return t.orders.select("o_orderkey", F.row_number().over(by_customer()).cast("bigint").alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def rank_dense(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"))


@query("SELECT o_orderkey, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
def percent_cume(t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.percent_rank().over(w), 8).alias("p"), F.round(F.cume_dist().over(w), 8).alias("c"))


@query(f"SELECT o_orderkey, CAST(ntile(3) OVER {SQL_CUSTOMER} AS BIGINT) AS t FROM orders")
def ntile(t):
    return t.orders.select("o_orderkey", F.ntile(3).over(by_customer()).cast("bigint").alias("t"))


@query(f"SELECT o_orderkey, lag(o_totalprice) OVER {SQL_CUSTOMER} AS before, lead(o_totalprice, 2, -1.0) OVER {SQL_CUSTOMER} AS after FROM orders")
def lag_lead(t):
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(by_customer()).alias("before"), F.lead("o_totalprice", 2, -1.0).over(by_customer()).alias("after"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders")
def running_sum(t):
    w = by_customer().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS mean FROM orders")
def moving_avg_rows(t):
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(by_customer().rowsBetween(-2, 1)), 4).alias("mean"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
def range_frame(t):
    return t.part.select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)).alias("near"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n, first_value(o_orderkey) OVER w AS f2, last_value(o_orderkey) OVER w AS l2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last_nth(t):
    w = by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = "o_orderkey"
    return t.orders.select(c, F.first(c).over(w).alias("f"), F.last(c).over(w).alias("l"), F.nth_value(c, 2).over(w).alias("n"), F.first_value(c).over(w).alias("f2"), F.last_value(c).over(w).alias("l2"))


@query("SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM (SELECT *, nullif(event_type, 'view') AS kind FROM events)")
def last_ignore_nulls(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.nullif("event_type", F.lit("view")), ignorenulls=True).over(w).alias("kind"))


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
def share_of_group(t):
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(w), 8).alias("share"), F.max("o_totalprice").over(w).alias("most"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def window_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT CAST(start AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1")
def window_sliding(t):
    return t.events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked) SELECT user_id, min(ts) AS start, count(*) AS n FROM numbered GROUP BY user_id, s")
def window_session(t):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT CAST(date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS TIMESTAMP) AS moment, count(*) AS n FROM events GROUP BY 1")
def window_time(t):
    counted = t.events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.window_time("w").alias("moment"), "n")
