"""Scans, projections, filters, sorting, sets, missing values."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rows
from ..operators.joins import small
from .registry import query


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def select_cols(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def with_columns(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    frame = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    frame = frame.withColumn("net", net).withColumns({"gross": net * (1 + F.col("l_tax"))})
    return frame.drop("l_extendedprice", "l_discount", "l_tax")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_drop(t):
    frame = t.customer.withColumnRenamed("c_custkey", "id").withColumnsRenamed({"c_name": "name", "c_acctbal": "balance", "absent": "x"})
    return frame.drop("c_nationkey", "absent")


@query("SELECT r_regionkey AS k, r_name AS n FROM region")
def to_df(t):
    return t.region.toDF("k", "n")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 OR l_discount >= 0.09) AND NOT l_returnflag = 'R'")
def filter_and_or(t):
    c = t.lineitem
    return c.where((c.l_quantity > 45) | (c["l_discount"] >= 0.09)).filter(~(F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size IN (11, 13, 17, 19)")
def filter_isin_between(t):
    return t.part.where(F.col("p_size").between(10, 20) & F.col("p_size").isin(11, 13, 17, 19)).select("p_partkey", "p_size")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1' OR c_name ILIKE '%CUSTOMER%22%' OR regexp_matches(c_name, '33[0-9]$')")
def like_ilike_rlike(t):
    c = F.col("c_name")
    return t.customer.where(c.like("%1") | c.ilike("%CUSTOMER%22%") | c.rlike("33[0-9]$")).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'A') OR ends_with(c_mktsegment, 'G') OR contains(c_mktsegment, 'HOUSE')")
def starts_ends_contains(t):
    c = F.col("c_mktsegment")
    return t.customer.where(c.startswith("A") | c.endswith("G") | c.contains("HOUSE")).select("c_custkey")


@query("SELECT e1.event_id, (nullif(event_type, 'click') IS NOT DISTINCT FROM NULL) AS same, nullif(event_type, 'click') IS NULL AS missing, nullif(event_type, 'click') IS NOT NULL AS present FROM events e1")
def null_safe_eq(t):
    c = F.nullif("event_type", F.lit("click"))
    return t.events.select("event_id", c.eqNullSafe(F.lit(None)).alias("same"), c.isNull().alias("missing"), c.isNotNull().alias("present"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS class FROM orders")
def case_when(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "middle").otherwise("low").alias("class"))


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS price, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey AS VARCHAR) AS text, CAST('2020-02-03' AS DATE) AS day, TRY_CAST(p_name AS INTEGER) AS none FROM part")
def cast_types(t):
    return t.part.select(
        "p_partkey",
        F.col("p_retailprice").cast("bigint").alias("price"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_partkey").cast("string").alias("text"),
        F.lit("2020-02-03").cast("date").alias("day"),
        F.col("p_name").try_cast("int").alias("none"),
    )


@query("SELECT o_orderkey, round(o_totalprice + 1.5, 4) AS a, round(o_totalprice - o_orderkey, 4) AS b, round(o_totalprice * 2, 4) AS c, round(o_totalprice / 3, 6) AS d, o_orderkey % 7 AS e, -o_orderkey AS f, round(100 - o_totalprice, 4) AS g, round(1000000.0 / o_totalprice, 8) AS h, power(o_orderkey % 5, 2) AS i, power(2, o_orderkey % 5) AS j FROM orders")
def column_arithmetic(t):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.round(p + 1.5, 4).alias("a"),
        F.round(p - k, 4).alias("b"),
        F.round(p * 2, 4).alias("c"),
        F.round(p / 3, 6).alias("d"),
        (k % 7).alias("e"),
        (-k).alias("f"),
        F.round(100 - p, 4).alias("g"),
        F.round(1000000.0 / p, 8).alias("h"),
        ((k % 5) ** 2).alias("i"),
        (2 ** (k % 5)).alias("j"),
    )


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS head, substr(o_orderpriority, 3, 4) AS part FROM orders")
def column_substr(t):
    c = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", c.substr(1, 1).alias("head"), c.substr(3, 4).alias("part"))


@query("SELECT a.c_custkey, a.c_name FROM customer a WHERE a.c_acctbal < 0")
def alias_qualified(t):
    return t.customer.alias("a").where(F.col("a.c_acctbal") < 0).select("a.c_custkey", F.col("a.c_name"))


@query("SELECT c_custkey, upper(c_name) AS name FROM customer")
def transform_frame(t):
    return t.customer.transform(lambda f: f.select("c_custkey", F.upper("c_name").alias("name")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM events) ORDER BY kind DESC NULLS LAST, event_id DESC LIMIT 40", name="order_nulls")
def order_nulls(t):
    frame = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return frame.orderBy(F.desc_nulls_last("kind"), F.col("event_id").desc()).limit(40)


@query("SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM events) ORDER BY kind ASC NULLS FIRST, event_id LIMIT 40")
def order_nulls_first(t):
    frame = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return frame.sort(F.asc_nulls_first("kind"), "event_id", ascending=[True, True]).limit(40)


@query("(SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM events) ORDER BY kind ASC NULLS LAST, event_id LIMIT 30) UNION ALL (SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM events) ORDER BY kind DESC NULLS FIRST, event_id LIMIT 30)")
def order_nulls_both_ways(t):
    frame = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    last = frame.orderBy(F.asc_nulls_last("kind"), F.asc("event_id")).limit(30)
    return last.union(frame.orderBy(F.desc_nulls_first("kind"), "event_id").limit(30))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")
def limit_chain(t):
    return t.customer.select("c_custkey").orderBy("c_custkey").limit(20).limit(7)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def drop_duplicates(t):
    frame = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").count().groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return frame.dropDuplicates(["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def dedup_latest(t):
    return rows.first_of_each(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_rows_of_groups(t):
    frame = rows.first_of_each(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return frame.drop("o_totalprice")


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).union(t.customer.select("c_nationkey"))


@query("SELECT c_custkey, c_name, NULL::INTEGER AS extra FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def union_by_name_missing(t):
    left = t.customer.select("c_custkey", "c_name")
    return left.unionByName(t.supplier.select(F.col("s_nationkey").alias("extra"), F.col("s_suppkey").alias("c_custkey")), allowMissingColumns=True)


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0")
def intersect(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_nationkey"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect_all(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersectAll(t.customer.where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def subtract(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


GAPS = "SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN value < 50 THEN value END AS low, CASE WHEN user_id % 3 = 0 THEN user_id END AS third FROM events"


def gaps(t):
    return t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(F.col("value") < 50, F.col("value")).alias("low"),
        F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("third"),
    )


@query(f"SELECT * FROM ({GAPS}) WHERE kind IS NOT NULL AND low IS NOT NULL AND third IS NOT NULL")
def dropna_any(t):
    return gaps(t).dropna()


@query(f"SELECT * FROM ({GAPS}) WHERE kind IS NOT NULL OR low IS NOT NULL OR third IS NOT NULL")
def dropna_all(t):
    return gaps(t).dropna("all", subset=["kind", "low", "third"])


@query(f"SELECT * FROM ({GAPS}) WHERE (kind IS NOT NULL)::INT + (low IS NOT NULL)::INT + (third IS NOT NULL)::INT >= 2")
def dropna_thresh(t):
    return gaps(t).na.drop(thresh=2, subset=["kind", "low", "third"])


@query(f"SELECT event_id, coalesce(kind, 'none') AS kind, coalesce(low, -1) AS low, coalesce(third, 0) AS third FROM ({GAPS})")
def fillna(t):
    return gaps(t).fillna({"kind": "none", "low": -1.0, "third": 0})


@query(f"SELECT event_id, kind, coalesce(low, 7) AS low, coalesce(third, 7) AS third FROM ({GAPS})")
def fillna_scalar(t):
    return gaps(t).na.fill(7)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_map(t):
    return t.orders.select("o_orderkey", "o_orderstatus").replace({"F": "finished", "O": "open"})


@query("SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE n_regionkey END AS n_regionkey FROM nation")
def replace_lists(t):
    return t.nation.select("n_nationkey", "n_regionkey").na.replace([1, 2], [10, 20], ["n_regionkey"])


@query("""
WITH sold AS (
  SELECT n_name, p_brand, sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY n_name, p_brand),
ranked AS (SELECT n_name, p_brand, round(revenue, 2) AS revenue, CAST(row_number() OVER (PARTITION BY n_name ORDER BY revenue DESC, p_brand) AS BIGINT) AS place FROM sold)
SELECT * FROM ranked WHERE place <= 3 ORDER BY revenue DESC, n_name LIMIT 50""")
def flagship(t):
    """The best brands of each nation: filter, joins, aggregation, window, top-k."""
    lines = t.lineitem.where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    sold = (
        lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("n_name", "p_brand")
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    )
    best = Window.partitionBy("n_name").orderBy(F.desc("revenue"), "p_brand")
    ranked = sold.withColumn("place", F.row_number().over(best).cast("bigint")).where("place <= 3")
    return ranked.select("n_name", "p_brand", F.round("revenue", 2).alias("revenue"), "place").orderBy(F.desc("revenue"), "n_name").limit(50)


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).unionAll(t.region.select("r_regionkey"))


@query("SELECT r_regionkey, r_name FROM region")
def global_temp_view(t):
    name = f"region_{uuid.uuid4().hex[:8]}"
    t.region.createGlobalTempView(name)
    return t.spark.table(f"global_temp.{name}").select("r_regionkey", "r_name")
