"""Row-level statements on the employee table."""

import uuid

import pytest
from pyspark.sql import functions as F

from polyframe.operators.dml import ReplaceFailed, Table, WhenMatched, WhenNotMatched, WhenNotMatchedBySource, deleted, merged, updated
from polyframe.testing import rows


@pytest.fixture
def table(spark, employees):
    name = f"employee_{uuid.uuid4().hex[:8]}"
    employees.write.saveAsTable(name)
    yield Table(spark, name)
    spark.sql(f"DROP TABLE {name}")


def test_update(spark, table):
    statement = table.update({"age": table["age"] + 1, "fname": "X"}, where=table["employee_id"] == 1)
    assert spark.table(table.name).where("fname = 'X'").isEmpty()  # nothing runs before execute()
    assert statement.execute() == 5
    assert rows(spark.table(table.name).where("employee_id = 1")) == [(1, "X", "Shephard", 38, 1)]
    assert spark.table(table.name).where("fname = 'X'").count() == 1


def test_update_sees_old_values(employees):
    out = updated(employees, {"age": F.col("store_id"), "store_id": F.col("age")}, "employee_id = 5")
    assert (5, "Hugo", "Reyes", 100, 29) in rows(out)


def test_update_without_condition_warns(employees):
    with pytest.warns(UserWarning):
        assert {r[3] for r in rows(updated(employees, {"age": 1}))} == {1}


def test_update_of_unknown_column(employees):
    with pytest.raises(ValueError, match="no column"):
        updated(employees, {"nothing": 1}, "age > 1")


def test_delete(spark, table):
    assert table.delete(where=["age > 30", F.col("store_id") == 1]).execute() == 3
    assert sorted(r[0] for r in rows(spark.table(table.name))) == [3, 4, 5]


def test_delete_keeps_rows_of_null_conditions(spark):
    frame = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    assert rows(deleted(frame, "b > 1")) == [(1, None)]


@pytest.fixture
def parted(spark):
    name = f"parted_{uuid.uuid4().hex[:8]}"
    rows_ = [(n, n * 10, d, k) for n, (d, k) in enumerate([("x", 1), ("x", 1), ("x", 2), ("it's", 2), ("it's", 2), ("z", 3)])]
    spark.createDataFrame(rows_, "id int, v int, d string, k int").write.partitionBy("d", "k").saveAsTable(name)
    yield Table(spark, name)
    spark.sql(f"DROP TABLE {name}")


def files(spark, name):
    """The files of each partition."""
    out = {}
    for d, k, file in spark.table(name).select("d", "k", F.input_file_name()).collect():
        out.setdefault(d + str(k), set()).add(file)
    return out


def test_only_touched_partitions_are_rewritten(spark, parted):
    before, mode = files(spark, parted.name), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert parted.update({"v": parted["v"] + 1}, "id IN (0, 4)").execute() == 6
    after = files(spark, parted.name)
    assert {p for p in before if before[p] != after[p]} == {"x1", "it's2"}
    assert rows(spark.table(parted.name).select("id", "v")) == [(0, 1), (1, 10), (2, 20), (3, 30), (4, 41), (5, 50)]
    assert Table(spark, parted.name).update({"v": 9}, "d = 'z'").execute() == 6  # a whole partition
    before, after = after, files(spark, parted.name)
    assert {p for p in before if before[p] != after[p]} == {"z3"}
    parted = Table(spark, parted.name)
    assert parted.delete(parted["id"] == 3).execute() == 5
    last = files(spark, parted.name)
    assert {p for p in after if after[p] != last.get(p)} == {"it's2"}
    assert rows(spark.table(parted.name).select("id")) == [(0,), (1,), (2,), (4,), (5,)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_statements_that_rewrite_all_partitions(spark, parted):
    assert parted.delete("id = 5 OR id = 0").execute() == 4  # empties z
    assert rows(spark.table(parted.name).select("id", "d")) == [(1, "x"), (2, "x"), (3, "it's"), (4, "it's")]
    assert Table(spark, parted.name).update({"d": "new"}, "id = 1").execute() == 4
    assert rows(spark.table(parted.name).select("id", "d")) == [(1, "new"), (2, "x"), (3, "it's"), (4, "it's")]
    assert Table(spark, parted.name).update({"v": 0, "d": None}, "id = 2").execute() == 4
    assert Table(spark, parted.name).update({"v": 7}, "d IS NULL OR id = 4").execute() == 4
    assert rows(spark.table(parted.name).select("id", "v", "d")) == [(1, 10, "new"), (2, 7, None), (3, 30, "it's"), (4, 7, "it's")]


def test_statements_that_change_nothing(spark, parted):
    before = files(spark, parted.name)
    assert parted.update({"v": 0}, "id = 99").execute() == 6 and parted.delete("v < 0").execute() == 6
    assert files(spark, parted.name) == before


def test_emptied_table(spark, table):
    assert table.delete(where="true").execute() == 0
    assert Table(spark, table.name).update({"age": 1}, where="age > 0").execute() == 0
    assert spark.table(table.name).isEmpty()


def test_failed_staging_leaves_the_table(spark, table):
    with pytest.raises(Exception, match="(?i)raise|stop"):
        table.update({"age": F.raise_error(F.lit("stop")).cast("int")}, where="employee_id = 3").execute()
    assert spark.table(table.name).count() == 5
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{table.name}__")] == []


def test_failed_overwrite_keeps_the_new_rows(spark, table, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    def broken(self, *_):
        raise OSError("no space left")

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "insertInto", broken)
        with pytest.raises(ReplaceFailed) as caught:
            table.delete(where="employee_id < 4").execute()
    assert caught.value.name == table.name
    assert sorted(r[0] for r in rows(spark.table(caught.value.staging))) == [4, 5]
    spark.sql(f"DROP TABLE {caught.value.staging}")


def test_merge_simple(spark, table):
    source = spark.createDataFrame([(1, "Jack", "Shephard", 38, 2), (6, "Mary", "Sue", 21, 45)], ["employee_id", "fname", "lname", "age", "store_id"])
    table.merge(
        source,
        table["employee_id"] == source["employee_id"],
        [
            WhenMatched(table["fname"] == source["fname"]).update({"lname": source["lname"], "age": source["age"], "store_id": source["store_id"]}),
            WhenNotMatched().insert({c: source[c] for c in source.columns}),
        ],
    ).execute()
    assert rows(spark.table(table.name)) == [
        (1, "Jack", "Shephard", 38, 2),
        (2, "John", "Locke", 65, 1),
        (3, "Kate", "Austen", 37, 2),
        (4, "Claire", "Littleton", 27, 2),
        (5, "Hugo", "Reyes", 29, 100),
        (6, "Mary", "Sue", 21, 45),
    ]


def test_merge_first_true_clause_wins(spark, employees):
    source = spark.createDataFrame([(1, 10), (2, 20), (9, 90)], "k int, v int")
    out = merged(
        employees.select("employee_id", "age"),
        source,
        F.col("employee_id") == F.col("k"),
        [
            WhenMatched(F.col("v") > 15).delete(),
            WhenMatched().update({"age": F.col("v")}),
            WhenNotMatched(F.col("v") > 100).insert({"employee_id": F.col("k")}),
            WhenNotMatchedBySource(F.col("age") < 28).delete(),
            WhenNotMatchedBySource(F.col("age") < 30).update({"age": 0}),
        ],
    )
    assert rows(out) == [(1, 10), (3, 37), (5, 0)]


def test_merge_update_all_and_insert_all(spark, employees):
    source = spark.createDataFrame([(1, 99), (7, 7)], "employee_id int, age int")
    target = employees.select("employee_id", "age").alias("tg")
    out = merged(target, source.alias("st"), F.col("tg.employee_id") == F.col("st.employee_id"), [WhenMatched().update_all(), WhenNotMatched().insert_all()])
    assert (1, 99) in rows(out) and (7, 7) in rows(out) and out.count() == 6


def test_merge_slowly_changing_dimension(spark):
    target = spark.createDataFrame([("a", 1, "Jack", "2020-01-01", "2900-01-01"), ("b", 2, "John", "2020-01-01", "2900-01-01")], "s_id string, id int, name string, start_date string, end_date string")
    fresh = spark.createDataFrame([("c", 1, "Jake"), ("d", 6, "Mary")], "s_id string, id int, name string")
    changed = fresh.join(target.select(F.col("id").alias("tid"), F.col("name").alias("tname")), F.col("id") == F.col("tid")).where("name != tname").select(F.lit(0).alias("key"), "s_id", "id", "name")
    staging = changed.union(fresh.select(F.lit(1).alias("key"), "s_id", "id", "name"))
    out = merged(
        target.alias("tg"),
        staging.alias("st"),
        (F.col("st.id") == F.col("tg.id")) & (F.col("st.key") == 1),
        [
            WhenMatched(F.col("st.name") != F.col("tg.name")).update({"end_date": "2024-01-01"}),
            WhenNotMatched().insert({"s_id": F.col("st.s_id"), "id": F.col("st.id"), "name": F.col("st.name"), "start_date": "2024-01-01", "end_date": "2900-01-01"}),
        ],
    )
    assert rows(out) == [("a", 1, "Jack", "2020-01-01", "2024-01-01"), ("b", 2, "John", "2020-01-01", "2900-01-01"), ("c", 1, "Jake", "2024-01-01", "2900-01-01"), ("d", 6, "Mary", "2024-01-01", "2900-01-01")]


def test_merge_rejects_several_matches(spark, table):
    source = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    statement = table.merge(source, F.col("employee_id") == F.col("k"), [WhenMatched().update({"age": F.col("v")})])
    with pytest.raises(ValueError, match="several rows"):
        statement.execute()


def test_merge_needs_actions(employees, stores):
    with pytest.raises(ValueError, match="action"):
        merged(employees, stores, F.lit(True), [WhenMatched()])
