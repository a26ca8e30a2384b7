"""User functions, caching, partitioning, sources, sinks, session, catalog, lineage."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .. import sources
from ..plans import lineage
from ..session import temporary
from .registry import query


@query("SELECT c_custkey, upper(substr(c_name, 1, 1)) || '!' AS mark FROM customer")
def python_udf(t):
    mark = F.udf(lambda name: name[:1].upper() + "!", StringType())
    return t.customer.select("c_custkey", mark("c_name").alias("mark"))


@query("SELECT c_custkey, round(c_acctbal * 1.1, 6) AS raised FROM customer")
def pandas_udf(t):
    def raised(balance):
        return balance * 1.1

    return t.customer.select("c_custkey", F.round(F.pandas_udf(raised, DoubleType(), F.PandasUDFType.SCALAR)("c_acctbal"), 6).alias("raised"))


@query("SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n FROM customer")
def sql_udf(t):
    t.spark.udf.register("chars_of", lambda x: len(x), "bigint")
    return t.views("customer").sql("SELECT c_custkey, chars_of(c_name) AS n FROM customer")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def cache_persist(t):
    """A cached table is read while another is written, then released: nothing stays in memory after the query."""
    path = temporary(t.spark, "cached")
    frame = t.orders.select("o_orderkey", "o_orderstatus").cache()
    try:
        assert frame.is_cached
        frame.write.parquet(path)
    finally:
        frame.unpersist()
    return t.spark.read.parquet(path)


@query("SELECT o_orderkey FROM orders")
def repartition_coalesce(t):
    return t.orders.select("o_orderkey").repartition(4, "o_orderkey").coalesce(2).hint("rebalance")


@query("SELECT CAST(range AS BIGINT) AS id FROM range(5, 100, 5)")
def session_range(t):
    return t.spark.range(5, 100, 5)


@query("SELECT a, b, c::DOUBLE AS c FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.5)) v(a, b, c)", name="create_dataframe")
def create_dataframe(t):
    return t.spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "a int, b string, c double")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_round_trip(t):
    path = temporary(t.spark, "parquet")
    sources.save(t.nation, path, "parquet", "overwrite", partition_by="n_regionkey")
    return sources.read(t.spark, path, "parquet", schema="n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t):
    path = temporary(t.spark, "csv") + "/nation.csv"
    sources.save(t.nation, path, header=True)
    return sources.read(t.spark, path, header=True, schema="n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(t):
    path = temporary(t.spark, "json") + "/nation.json"
    sources.save(t.nation, path, mode="error")
    return sources.read(t.spark, path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey, n_name, true AS known FROM nation")
def orc_with_file_names(t):
    path = temporary(t.spark, "orc")
    sources.save(t.nation, path, "orc")
    frame = sources.read(t.spark, path, "orc", filename="file")
    return frame.select("n_nationkey", "n_name", F.col("file").contains(".orc").alias("known"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def table_round_trip(t):
    """Creates a table, extends it by name, replaces some rows, and reads it."""
    name = f"nation_{uuid.uuid4().hex[:12]}"
    base = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    sources.save_as_table(base.where("n_regionkey < 3"), name)
    sources.insert_into(base.where("n_regionkey >= 3").select("n_name", "n_regionkey", "n_nationkey"), name, named=True)
    sources.replace_where(base.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100), name, "n_regionkey = 1")
    path = temporary(t.spark, "table")
    t.spark.table(name).select("n_nationkey", "n_name").write.parquet(path)
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.read.parquet(path)


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
def temp_views(t):
    t.customer.createOrReplaceTempView("rich_customers")
    t.spark.table("rich_customers").where("c_acctbal > 9000").createOrReplaceTempView("rich_customers_now")
    return t.spark.sql("SELECT c_custkey, c_name FROM rich_customers_now")


@query("SELECT * FROM (VALUES ('revenue', 'l_discount'), ('revenue', 'l_extendedprice')) v(result, source)")
def column_lineage(t):
    frame = t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).groupBy("l_returnflag").agg(F.sum("net").alias("revenue"))
    found = sorted({leaf.name for leaf in lineage(frame, "revenue").leaves()})
    return t.spark.createDataFrame([("revenue", name) for name in found], "result string, source string")
