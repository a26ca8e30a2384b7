"""Frame behaviour: joins, duplicates, actions, plans, streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from polyframe import streaming
from polyframe.operators import aggregates, joins
from polyframe.operators.rows import first_of_each
from polyframe.plans import lineage, pushed_filters, read_schema
from polyframe.testing import assertDataFrameEqual, assertSchemaEqual, rows


def test_join_kinds(employees, stores):
    assert employees.join(stores, "store_id").count() == 4
    assert employees.join(stores, "store_id", "left").where("store_name is null").count() == 1
    assert employees.join(stores, "store_id", "left_anti").select("fname").collect()[0][0] == "Hugo"
    assert employees.join(stores, "store_id", "full").columns[0] == "store_id"
    assert joins.salted_join(employees, stores, ["store_id"], 3).count() == 4
    with pytest.raises(ValueError, match="salted"):
        joins.salted_join(employees, stores, ["store_id"], 3, "full")


def test_small_sides_are_broadcast_by_size(spark, stores):
    nation, customer = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("nation", "customer"))
    assert "Broadcast" in customer.join(joins.small(nation), F.col("c_nationkey") == F.col("n_nationkey"))._jdf.queryExecution().executedPlan().toString()
    assert joins.small(nation, most=1) is nation
    assert joins.small(stores) is stores  # made from local rows: nothing is known of its size


def test_as_of_join_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 7, 70)], "k string, t int, v int")
    out = joins.as_of_join(left, right, "t", ["k"], ["v"])
    assert rows(out.select("id", "v_asof")) == [(1, 50), (2, None), (3, None), (4, 50)]


def test_range_join_is_half_open(spark):
    points = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.5)], "id int, p double")
    spans = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 100.0), ("c", 3.0, 3.0)], "n string, low double, high double")
    assert rows(joins.range_join(points, spans, "p", "low", "high", 4.0).select("id", "n")) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]


def test_as_of_join_in_slices_equals_brute_force(spark):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    time = lambda: rng.choice([None, *range(-40, 400)])
    asks = [(n, key(), time(), {"m": "x"}) for n in range(300)]
    seen = [(key(), time(), rng.choice([None, 1, 2, 3])) for _ in range(120)]
    left = spark.createDataFrame(asks, "id int, k string, t int, extra map<string,string>")
    right = spark.createDataFrame(seen, "k string, t int, v int")
    want = []
    for n, k, t, _ in asks:
        fit = [(u, (v is not None, v or 0), v) for j, u, v in seen if k is not None and t is not None and j == k and u is not None and u <= t]
        want.append((n, max(fit)[2] if fit else None))
    for width in (None, 7.0, 1000.0):
        assert rows(joins.as_of_join(left, right, "t", ["k"], ["v"], width=width).select("id", "v_asof")) == sorted(want, key=str), width
    alone = joins.as_of_join(left, right.limit(0), "t", [], ["v"], width=50.0)
    assert alone.count() == 300 and alone.where("v_asof is not null").isEmpty()


def test_as_of_join_of_times_in_any_zone(spark):
    at = lambda h, m=0: datetime.datetime(2024, 3, 10, h, m)
    left = spark.createDataFrame([(1, at(2, 30)), (2, at(3, 0)), (3, at(0, 5))], "id int, t timestamp_ntz")
    right = spark.createDataFrame([(at(2, 45), "x"), (at(1, 59), "y")], "t timestamp_ntz, v string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert rows(joins.as_of_join(left, right, "t", [], ["v"], width=600.0).select("id", "v_asof")) == [(1, "y"), (2, "x"), (3, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_range_join_of_intervals_of_all_lengths(spark):
    rng = random.Random(6)
    inf = float("inf")
    points = [(n, rng.choice("ab"), rng.choice([None, inf, rng.uniform(-1e6, 1e6), rng.uniform(-5, 5)])) for n in range(150)]
    spans = []
    for n in range(120):
        low = rng.choice([None, -inf, rng.uniform(-1e6, 1e6), rng.uniform(-5, 5)])
        spans.append((n, rng.choice(["a", "b", None]), low, rng.choice([None, inf, (low or 0.0) + 10 ** rng.uniform(-3, 7)])))
    left = spark.createDataFrame(points, "id int, k string, p double")
    right = spark.createDataFrame(spans, "n int, k string, low double, high double")
    fits = lambda p, low, high: None not in (p, low, high) and low <= p < high
    want = sorted(((i, n) for i, k, p in points for n, j, low, high in spans if j == k and fits(p, low, high)), key=str)
    assert want and rows(joins.range_join(left, right, "p", "low", "high", 1.0, ["k"]).select("id", "n")) == want
    want = sorted(((i, n) for i, k, p in points for n, j, low, high in spans if fits(p, low, high)), key=str)
    assert rows(joins.range_join(left.drop("k"), right, "p", "low", "high", 0.01).select("id", "n")) == want
    assert joins.range_join(left, right.limit(0), "p", "low", "high", 1.0, ["k"]).count() == 0


def test_range_join_repeats_no_interval_for_its_length(spark, monkeypatch):
    seen, explode = [], F.explode
    days = spark.sql("SELECT explode(sequence(DATE'2000-01-01', DATE'2000-12-31')) AS d")
    spans = spark.sql("SELECT DATE'0001-01-01' AS low, DATE'9999-12-31' AS high, 1 AS n UNION ALL SELECT DATE'2000-02-01', DATE'2000-02-03', 2")
    joined = joins.range_join(days, spans, "d", "low", "high", 1.0)
    assert joined.groupBy("n").count().orderBy("n").collect() == [(1, 366), (2, 2)]
    monkeypatch.setattr(joins.F, "explode", lambda c: seen.append(c) or explode(c))
    joins.range_join(days, spans, "d", "low", "high", 1.0)
    assert max(r[0] for r in spans.select(F.size(seen[0])).collect()) <= 2


def test_first_of_each_is_deterministic(spark):
    frame = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("b", 2, "z")], "k string, rank int, v string")
    assert rows(first_of_each(frame, ["k"], ["rank"])) == [("a", 1, "x"), ("b", 2, "z")]


def test_null_order(spark):
    frame = spark.createDataFrame([(None,), (1,), (2,)], "a int")
    assert [r[0] for r in frame.orderBy("a").collect()] == [None, 1, 2]
    assert [r[0] for r in frame.orderBy(F.asc_nulls_last("a")).collect()] == [1, 2, None]
    assert [r[0] for r in frame.orderBy("a", ascending=False).collect()] == [2, 1, None]


def test_actions(employees, capsys):
    frame = employees.orderBy("employee_id")
    assert frame.head().fname == "Jack" and frame.first()["age"] == 37 and len(frame.head(2)) == 2 and not frame.isEmpty()
    assert frame.count() == 5 and frame.toArrow().num_rows == 5 and list(frame.toPandas().columns) == frame.columns
    frame.show(2)
    frame.printSchema()
    frame.explain("formatted")
    printed = capsys.readouterr().out
    assert "Shephard" in printed and "employee_id: integer" in printed and "Physical Plan" in printed
    assert frame.first().asDict()["lname"] == "Shephard"


def test_statistics(employees):
    assert aggregates.quantiles(employees, "age", [0.5]) == [37.0]
    assert aggregates.quantiles(employees, ["age", "store_id"], [0.0, 1.0]) == [[27.0, 65.0], [1.0, 100.0]]
    assert aggregates.correlation(employees, "age", "age") == pytest.approx(1.0)
    assert aggregates.covariance(employees, "age", "age") == pytest.approx(232.0)


def test_pivot_refuses_too_many_values(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PIVOT_VALUES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        aggregates.pivot(spark.range(5), [], "id", [F.count(F.lit(1))])


def test_comparison_helpers(employees):
    assertDataFrameEqual(employees, employees.orderBy(F.desc("age")))
    assertSchemaEqual(employees.schema, employees.schema)
    with pytest.raises(AssertionError):
        assertDataFrameEqual(employees, employees.limit(2))


def test_lineage(employees, stores):
    frame = employees.join(stores, "store_id").withColumn("n", F.concat("fname", "store_name")).groupBy("district_id").agg(F.max("n").alias("top"))
    tree = lineage(frame, "top")
    assert sorted({leaf.name for leaf in tree.leaves()}) == ["fname", "store_name"]
    assert {leaf.name for leaf in lineage(frame, "district_id").leaves()} == {"district_id"}
    assert {leaf.name for leaf in lineage(employees.select("age").union(stores.select("num_sales")), "age").leaves()} == {"age", "num_sales"}
    with pytest.raises(ValueError, match="no column"):
        lineage(frame, "absent")


def test_pushdown_reaches_the_scan(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    assert any("l_quantity" in f for f in pushed_filters(frame))
    assert sorted(read_schema(frame)) == ["l_orderkey", "l_quantity"]


def test_catalog(spark, employees):
    employees.createOrReplaceTempView("staff")
    assert spark.catalog.tableExists("staff") and spark.catalog.currentDatabase() == "default"
    assert [c.name for c in spark.catalog.listColumns("staff")] == employees.columns
    spark.catalog.cacheTable("staff")
    assert spark.catalog.isCached("staff")
    spark.catalog.uncacheTable("staff")
    spark.udf.register("plus", lambda a, b: a + b, "int")
    assert spark.catalog.functionExists("plus")
    assert spark.sql("SELECT plus(age, 1) FROM staff WHERE employee_id = 1").first()[0] == 38
    assert spark.catalog.dropTempView("staff")


def test_stream_appends_closed_windows(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    events = spark.createDataFrame([(at(1), "a", 1.0), (at(2), "a", 2.0), (at(40), "b", 3.0)], "ts timestamp_ntz, kind string, value double")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(source)
    for late in (59,):
        spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5, late), "z", 0.0)], events.schema).write.mode("append").parquet(source)
    stream = streaming.read_folder(spark, source, events.schema, files_per_trigger=1)
    counted = streaming.tumbling(stream, "ts", "10 minutes", ["kind"], F.sum("value").alias("total"))
    streaming.run_once(counted, sink, str(tmp_path / "checkpoint"))
    out = spark.read.parquet(sink)
    assert rows(out.select("kind", "total"))[0] == ("a", 3.0)
    assert "z" not in {r[0] for r in rows(out.select("kind"))}


def test_sessions_and_sliding_windows(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    events = spark.createDataFrame([(at(1), "a"), (at(3), "a"), (at(30), "a")], "ts timestamp, kind string")
    counted = streaming.sessions(events, "ts", "5 minutes", ["kind"], F.count("*").alias("n"))
    assert sorted(r[0] for r in counted.select("n").collect()) == [1, 2]
    assert streaming.sliding(events, "ts", "10 minutes", "5 minutes", [], F.count("*").alias("n")).count() == 4
