"""Readers and writers."""

import pytest

from polyframe import sources
from polyframe.testing import rows

SCHEMA = "employee_id int, fname string, lname string, age int, store_id int"


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_round_trip_by_ending(spark, employees, tmp_path, kind):
    path = str(tmp_path / f"employee.{kind}")
    sources.save(employees, path, **({"header": True} if kind == "csv" else {}))
    back = sources.read(spark, path, schema=SCHEMA, **({"header": True} if kind == "csv" else {}))
    assert rows(back) == rows(employees)


def test_modes(spark, employees, tmp_path):
    path = str(tmp_path / "x.parquet")
    sources.save(employees, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sources.save(employees, path)
    sources.save(employees, path, mode="ignore")
    sources.save(employees, path, mode="append")
    assert sources.read(spark, path).count() == 10
    sources.save(employees, path, mode="overwrite")
    assert sources.read(spark, path).count() == 5
    with pytest.raises(ValueError, match="mode"):
        sources.save(employees, path, mode="upsert")


def test_several_paths_and_file_names(spark, employees, tmp_path):
    for k in (1, 2):
        sources.save(employees.where(f"store_id = {k}"), str(tmp_path / f"{k}.json"))
    frame = sources.read(spark, [str(tmp_path / "1.json"), str(tmp_path / "2.json")], filename="file")
    assert frame.count() == 4
    assert {r[0].split("/")[-2] for r in frame.select("file").collect()} == {"1.json", "2.json"}


def test_leading_lines_are_skipped(spark, tmp_path):
    file = tmp_path / "extra.csv"
    file.write_text("junk\nid,name\n1,a\n2,b\n")
    assert rows(sources.read(spark, str(file), skip=1, header=True, inferSchema=True)) == [(1, "a"), (2, "b")]


def test_leading_lines_with_file_names(spark, tmp_path):
    for name, junk in (("a", "note\nnote two"), ("b", "x,y,z\n")):
        (tmp_path / f"{name}.csv").write_text(f"{junk}\nid,name,at\n1,{name}1,2024-01-02\n2,\"{name},2\",\n")
    frame = sources.read(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], skip=2, filename="file", header=True, schema="id int, name string, at date")
    got = sorted((r["id"], r["name"], str(r["at"]), r["file"].rsplit("/", 1)[-1]) for r in frame.collect())
    assert got == [(1, "a1", "2024-01-02", "a.csv"), (1, "b1", "2024-01-02", "b.csv"), (2, "a,2", "None", "a.csv"), (2, "b,2", "None", "b.csv")]


def test_short_and_broken_rows(spark, tmp_path):
    file = tmp_path / "x.csv"
    file.write_text("id,price,name\n1,2.5,a\n2\nx,1,b\n3,4,c\n")
    read = lambda **how: rows(sources.read(spark, str(file), header=True, schema="id int, price double, name string", **how))
    assert read(null_padding=True) == [(None, 1.0, "b"), (1, 2.5, "a"), (2, None, None), (3, 4.0, "c")] or read(null_padding=True) == [(1, 2.5, "a"), (2, None, None), (3, 4.0, "c"), (None, 1.0, "b")]
    assert read(null_padding=True, ignore_errors=True) == [(1, 2.5, "a"), (2, None, None), (3, 4.0, "c")]
    assert read(ignore_errors=True) == [(1, 2.5, "a"), (3, 4.0, "c")]
    named = sources.read(spark, str(file), header=True, inferSchema=True, null_padding=True, filename="file")
    assert named.columns == ["id", "price", "name", "file"] and named.count() == 4


def test_skipped_lines_split_files(spark, tmp_path):
    """A file of several splits loses its own leading lines only."""
    file = tmp_path / "long.csv"
    file.write_text("junk\n" + "".join(f"{k},{'x' * 50}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = sources.read(spark, str(file), skip=1, schema="k int, x string")
        assert frame.rdd.getNumPartitions() > 3
        assert sorted(r["k"] for r in frame.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_unknown_ending(spark):
    with pytest.raises(ValueError, match="ending"):
        sources.read(spark, "/x/y.bin")
    assert sources.format_of("/a/b.csv.gz") == "csv"


def test_partitioned_write(spark, employees, tmp_path):
    path = str(tmp_path / "p")
    sources.save(employees, path, "parquet", partition_by="store_id")
    frame = sources.read(spark, path, "parquet").where("store_id = 2")
    assert frame.count() == 2
    assert "PartitionFilters: [isnotnull(store_id" in frame._jdf.queryExecution().executedPlan().toString()


def test_tables(spark, employees):
    sources.save_as_table(employees, "t_sources", mode="overwrite")
    sources.insert_into(employees.select("store_id", "age", "lname", "fname", "employee_id"), "t_sources", named=True)
    assert spark.table("t_sources").count() == 10
    assert {r[1] for r in rows(spark.table("t_sources"))} == {"Jack", "John", "Kate", "Claire", "Hugo"}
    sources.save_as_table(employees, "t_sources", mode="append")
    assert spark.table("t_sources").count() == 15
    sources.replace_where(employees.where("store_id = 1"), "t_sources", "store_id = 1")
    assert spark.table("t_sources").count() == 11
    with pytest.raises(ValueError, match="columns"):
        sources.insert_into(employees.select("age"), "t_sources", named=True)
    sources.insert_into(employees, "t_sources", overwrite=True)
    assert spark.table("t_sources").count() == 5
    spark.sql("DROP TABLE t_sources")


def test_bucketed_tables_join_without_shuffle(spark, employees, stores):
    from polyframe.plans import exchanges

    sources.save_as_table(employees, "b_left", mode="overwrite", cluster_by=(4, ["store_id"]))
    sources.save_as_table(stores, "b_right", mode="overwrite", cluster_by=(4, ["store_id"]))
    joined = spark.table("b_left").join(spark.table("b_right").hint("merge"), "store_id")
    assert joined.count() == 4
    assert exchanges(joined) == 0
    for name in ("b_left", "b_right"):
        spark.sql(f"DROP TABLE {name}")
