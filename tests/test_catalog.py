"""Catalog, views and session."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from polyframe.session import session


@pytest.fixture
def table(spark, employees):
    employees.write.mode("overwrite").saveAsTable("catalog_staff")
    yield "catalog_staff"
    spark.sql("DROP TABLE IF EXISTS catalog_staff")


def test_databases(spark):
    c = spark.catalog
    spark.sql("CREATE DATABASE IF NOT EXISTS db1")
    assert c.databaseExists("db1") and c.getDatabase("db1").name == "db1"
    assert {"db1", "default"} <= {d.name for d in c.listDatabases()} and [d.name for d in c.listDatabases("db*")] == ["db1"]
    c.setCurrentDatabase("db1")
    assert c.currentDatabase() == "db1"
    c.setCurrentDatabase("default")
    assert c.currentCatalog() == "spark_catalog" and "spark_catalog" in {x.name for x in c.listCatalogs()}
    c.setCurrentCatalog("spark_catalog")
    spark.sql("DROP DATABASE db1")
    assert not c.databaseExists("db1")


def test_tables_and_columns(spark, table):
    c = spark.catalog
    assert c.tableExists(table) and c.getTable(table).tableType == "MANAGED"
    assert table in {t.name for t in c.listTables()} and [t.name for t in c.listTables(pattern="catalog_*")] == [table]
    assert [(x.name, x.dataType) for x in c.listColumns(table)][:2] == [("employee_id", "int"), ("fname", "string")]
    c.refreshTable(table)
    assert spark.table(table).count() == 5


def test_created_tables(spark, employees, tmp_path):
    c = spark.catalog
    made = c.createTable("catalog_made", schema=employees.schema, source="parquet")
    assert made.count() == 0 and made.columns == employees.columns
    path = str(tmp_path / "external")
    employees.write.partitionBy("store_id").parquet(path)
    outside = c.createTable("catalog_outside", path=path, source="parquet")
    assert c.getTable("catalog_outside").tableType == "EXTERNAL"
    c.recoverPartitions("catalog_outside")
    assert outside.count() == 5 or spark.table("catalog_outside").count() == 5
    c.refreshByPath(path)
    for name in ("catalog_made", "catalog_outside"):
        spark.sql(f"DROP TABLE {name}")


def test_views(spark, employees):
    c = spark.catalog
    employees.createOrReplaceTempView("catalog_view")
    employees.where("age > 30").createOrReplaceGlobalTempView("catalog_global")
    assert spark.table("catalog_view").count() == 5 and spark.table("global_temp.catalog_global").count() == 3
    employees.limit(1).createOrReplaceTempView("catalog_view")
    assert spark.read.table("catalog_view").count() == 1
    assert c.dropTempView("catalog_view") and c.dropGlobalTempView("catalog_global")
    assert not c.dropTempView("catalog_view")


def test_functions(spark):
    c = spark.catalog
    spark.udf.register("catalog_add", lambda x, y: x + y, "int")
    assert c.functionExists("catalog_add") and c.functionExists("abs") and not c.functionExists("catalog_absent")
    assert c.getFunction("abs").name == "abs" and "catalog_add" in {f.name for f in c.listFunctions()}
    assert spark.range(1).select(F.call_function("catalog_add", F.lit(1), F.lit(2))).first()[0] == 3
    assert spark.sql("SELECT catalog_add(2, 3)").first()[0] == 5


def test_caching(spark, table):
    c = spark.catalog
    c.cacheTable(table)
    assert c.isCached(table)
    c.uncacheTable(table)
    assert not c.isCached(table)
    c.cacheTable(table)
    c.clearCache()
    assert not c.isCached(table)
    frame = spark.table(table).persist()
    assert frame.is_cached
    frame.unpersist()


def test_session(spark):
    assert SparkSession.getActiveSession() is not None and session().sparkContext is spark.sparkContext
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert [r[0] for r in spark.range(3).collect()] == [0, 1, 2] and spark.range(0).count() == 0
    assert [r[0] for r in spark.range(1, 7, 3).collect()] == [1, 4]
    assert spark.sql("SELECT 1 AS a UNION ALL SELECT 2").count() == 2


@pytest.mark.parametrize(
    ("data", "schema", "types"),
    [
        ([(1, "a")], ["x", "y"], ["bigint", "string"]),
        ([{"x": 1, "y": 1.5}], None, ["bigint", "double"]),
        ([(1, None)], "x int, y decimal(10,2)", ["int", "decimal(10,2)"]),
        ([5, 6], "int", ["int"]),
        ([], "x int", ["int"]),
        ([([1], {"k": 2})], "a array<int>, m map<string,int>", ["array<int>", "map<string,int>"]),
    ],
)
def test_created_frames(spark, data, schema, types):
    frame = spark.createDataFrame(data, schema)
    assert [t for _, t in frame.dtypes] == types and frame.count() == len(data)


def test_partition_transforms():
    for name in ("years", "months", "days", "hours"):
        assert name in str(getattr(F.partitioning, name)("ts"))
    assert "bucket" in str(F.partitioning.bucket(4, "id"))


def test_external_table_and_registered_function(spark, tmp_path):
    path = str(tmp_path / "outside")
    spark.range(3).write.parquet(path)
    with pytest.warns(FutureWarning):
        spark.catalog.createExternalTable("outside", path=path, source="parquet")
        spark.catalog.registerFunction("half_of", lambda x: x // 2, "bigint")
    assert spark.sql("SELECT half_of(id) AS h FROM outside ORDER BY id").collect()[2]["h"] == 1
    spark.sql("DROP TABLE outside")
    assert spark.read.parquet(path).count() == 3  # dropping leaves the files


def test_java_functions_must_exist(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        spark.udf.registerJavaFunction("nothing", "org.example.Nothing", "int")
    with pytest.raises(AnalysisException):
        spark.udf.registerJavaUDAF("nothing", "org.example.Nothing")
