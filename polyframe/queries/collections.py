"""Arrays, maps, structs, generators, JSON, CSV, XML, variants."""

from pyspark.sql import functions as F

from .deferred import E, EP
from .registry import family, query

big = "CAST({} AS BIGINT)".format
j = lambda c: E.array_join(c, ",")
s = "array_to_string({}, ',')".format
A = E.array(E.col("n_nationkey") % 3, E.col("n_regionkey"), E.lit(2), E.col("n_nationkey") % 3)
SA = "[n_nationkey % 3, n_regionkey, 2, n_nationkey % 3]"
B = E.array(E.lit(1), E.lit(2), E.lit(5))
SB = "[1, 2, 5]"
N = E.array(E.lit(1), E.lit(None).cast("int"), E.lit(3))

family("array_build_sort", "nation", "n_nationkey", {
    "c_array": (j(A), s(SA)), "c_append": (j(E.array_append(A, 9)), s(f"list_append({SA}, 9)")), "c_prepend": (j(E.array_prepend(A, 9)), s(f"list_prepend(9, {SA})")),
    "c_insert": (j(E.array_insert(A, 2, 9)), s("[n_nationkey % 3, 9, n_regionkey, 2, n_nationkey % 3]")), "c_compact": (j(E.array_compact(N)), "'1,3'"),
    "c_sort": (j(E.sort_array(A)), s(f"list_sort({SA})")), "c_sort_desc": (j(E.sort_array(A, False)), s(f"list_reverse_sort({SA})")), "c_array_sort": (j(E.array_sort(A)), s(f"list_sort({SA})")),
    "c_sort_by": (j(E.array_sort(A, lambda a, b: b - a)), s(f"list_reverse_sort({SA})")), "c_reverse": (j(EP.array_reverse(A)), s(f"list_reverse({SA})")),
    "c_repeat": (j(E.array_repeat("n_regionkey", 3)), s("[n_regionkey, n_regionkey, n_regionkey]")), "c_sequence": (j(E.sequence(E.lit(1), E.col("n_regionkey") + 1)), s("generate_series(1, n_regionkey + 1)")),
    "c_flatten": (j(E.flatten(E.array(A, B))), s(f"list_concat({SA}, {SB})")), "c_slice": (j(E.slice(A, 2, 2)), s(f"list_slice({SA}, 2, 3)")), "c_lit": (j(EP.lit([1, 2])), "'1,2'"),
})

family("array_set_ops", "nation", "n_nationkey", {
    "c_distinct": (j(E.array_sort(E.array_distinct(A))), s(f"list_sort(list_distinct({SA}))")), "c_union": (j(E.array_sort(E.array_union(A, B))), s(f"list_sort(list_distinct(list_concat({SA}, {SB})))")),
    "c_intersect": (j(E.array_sort(E.array_intersect(A, B))), s(f"list_sort(list_distinct(list_intersect({SA}, {SB})))")),
    "c_except": (j(E.array_sort(E.array_except(A, B))), s(f"list_sort(list_distinct(list_filter({SA}, lambda x: NOT list_contains({SB}, x))))")),
    "c_remove": (j(E.array_remove(A, 2)), s(f"list_filter({SA}, lambda x: x <> 2)")), "c_overlap": (E.arrays_overlap(A, B), f"list_has_any({SA}, {SB})"), "c_contains": (E.array_contains(A, 1), f"list_contains({SA}, 1)"),
    "c_position": (E.array_position(A, 2), big(f"coalesce(list_position({SA}, 2), 0)")),
})

family("array_measures", "nation", "n_nationkey", {
    "c_size": (E.size(A).cast("bigint"), "4::BIGINT"), "c_array_size": (E.array_size(A).cast("bigint"), "4::BIGINT"), "c_cardinality": (E.cardinality(A).cast("bigint"), "4::BIGINT"),
    "c_min": (E.array_min(A), f"list_min({SA})"), "c_max": (E.array_max(A), f"list_max({SA})"), "c_element": (E.element_at(A, 2), "n_regionkey"), "c_try_element": (E.try_element_at(A, E.lit(9)), "NULL::INTEGER"), "c_get": (E.get(A, E.lit(1)), "n_regionkey"), "c_item": (A.getItem(1), "n_regionkey"), "c_bracket": (A[2], "2"),
    "c_join": (E.array_join(N, "-", "none"), "'1-none-3'"),
})

family("higher_order", "nation", "n_nationkey", {
    "c_transform": (j(E.transform(A, lambda x: x * 2)), s(f"list_transform({SA}, lambda x: x * 2)")), "c_indexed": (j(E.transform(B, lambda x, i: x * i)), "'0,2,10'"),
    "c_filter": (j(E.filter(A, lambda x: x > 0)), s(f"list_filter({SA}, lambda x: x > 0)")), "c_exists": (E.exists(A, lambda x: x == 4), f"list_contains({SA}, 4)"), "c_forall": (E.forall(A, lambda x: x >= 1), f"list_min({SA}) >= 1"),
    "c_aggregate": (E.aggregate(A, E.lit(0), lambda a, x: a + x).cast("bigint"), big(f"list_sum({SA})")), "c_reduce": (E.reduce(A, E.lit(0), lambda a, x: a + x, lambda a: a * 10).cast("bigint"), big(f"list_sum({SA}) * 10")),
    "c_zip_with": (j(E.zip_with(B, B, lambda a, b: a + b)), "'2,4,10'"), "c_arrays_zip": (E.arrays_zip(B, A)[1]["0"], "2"),
})

M = E.create_map(E.lit("a"), E.col("n_regionkey"), E.lit("b"), E.col("n_nationkey"))
family("map_ops", "nation", "n_nationkey", {
    "c_a": (M["a"], "n_regionkey"), "c_key": (M.getItem("b"), "n_nationkey"), "c_element": (E.element_at(M, "a"), "n_regionkey"), "c_keys": (j(E.map_keys(M)), "'a,b'"), "c_values": (j(E.map_values(M)), s("[n_regionkey, n_nationkey]")),
    "c_entries": (E.map_entries(M)[0]["key"], "'a'"), "c_from_arrays": (E.map_from_arrays(E.array(E.lit("x")), E.array("n_regionkey"))["x"], "n_regionkey"), "c_from_entries": (E.map_from_entries(E.array(E.struct(E.lit("x"), "n_regionkey")))["x"], "n_regionkey"),
    "c_concat": (E.map_concat(M, E.create_map(E.lit("z"), E.lit(7)))["z"], "7"), "c_contains": (E.map_contains_key(M, "a"), "true"), "c_filter": (j(E.map_keys(E.map_filter(M, lambda k, v: k == "b"))), "'b'"),
    "c_keys_up": (j(E.map_keys(E.transform_keys(M, lambda k, v: E.upper(k)))), "'A,B'"), "c_values_up": (j(E.map_values(E.transform_values(M, lambda k, v: v + 1))), s("[n_regionkey + 1, n_nationkey + 1]")),
    "c_zip": (E.map_zip_with(M, M, lambda k, a, b: a + b)["a"], "n_regionkey * 2"), "c_str": (E.str_to_map(E.lit("k:1,l:2"), E.lit(","), E.lit(":"))["l"], "'2'"), "c_lit": (EP.lit({"q": 3})["q"], "3"),
})


@query("SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation")
def explode(t):
    return t.nation.select("n_nationkey", F.explode(F.array("n_nationkey", "n_regionkey")).alias("x"))


@query("SELECT n_nationkey, unnest([0, 1]) AS pos, unnest([n_nationkey, n_regionkey]) AS col FROM nation")
def posexplode(t):
    return t.nation.select("n_nationkey", F.posexplode(F.array("n_nationkey", "n_regionkey")))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS x FROM nation")
def explode_outer(t):
    return t.nation.select("n_nationkey", F.explode_outer(F.when(F.col("n_regionkey") > 0, F.array("n_regionkey"))).alias("x"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE 0 END AS pos, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS x FROM nation")
def posexplode_outer(t):
    return t.nation.select("n_nationkey", F.posexplode_outer(F.when(F.col("n_regionkey") > 0, F.array("n_regionkey"))).alias("pos", "x"))


@query("SELECT n_nationkey, n_regionkey AS a, n_name AS b FROM nation UNION ALL SELECT n_nationkey, -1, 'x' FROM nation")
def inline(t):
    return t.nation.select("n_nationkey", F.inline(F.array(F.struct(F.col("n_regionkey").alias("a"), F.col("n_name").alias("b")), F.struct(F.lit(-1).alias("a"), F.lit("x").alias("b")))))


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS a FROM nation")
def inline_outer(t):
    return t.nation.select("n_nationkey", F.inline_outer(F.when(F.col("n_regionkey") > 0, F.array(F.struct(F.col("n_regionkey").alias("a"))))))


@query("SELECT n_nationkey, n_regionkey AS a FROM nation UNION ALL SELECT n_nationkey, 100 FROM nation")
def stack(t):
    return t.nation.select("n_nationkey", F.stack(F.lit(2), "n_regionkey", F.lit(100)).alias("a"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_tuple(t):
    return t.events.select("event_id", F.json_tuple("props", "k").alias("k"))


family("json_functions", "events", "event_id", {
    "c_get": (E.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')"), "c_from": (E.from_json("props", "k int")["k"].cast("bigint"), big("json_extract(props, '$.k')")),
    "c_to": (E.to_json(E.struct(E.col("user_id").alias("u"))), "'{\"u\":' || user_id || '}'"), "c_schema": (E.schema_of_json(E.lit('{"a": 1}')), "'STRUCT<a: BIGINT>'"),
    "c_length": (E.json_array_length(E.lit("[1, 2, 3]")).cast("bigint"), "3::BIGINT"), "c_keys": (j(E.json_object_keys("props")), "array_to_string(json_keys(props), ',')"),
})

family("csv_xml_functions", "events", "event_id", {
    "c_from_csv": (E.from_csv(E.concat_ws(",", "event_id", "event_type"), "a bigint, b string")["b"], "event_type"), "c_to_csv": (E.to_csv(E.struct("event_id", "event_type")), "event_id || ',' || event_type"), "c_csv_schema": (E.schema_of_csv(E.lit("1,a")), "'STRUCT<_c0: INT, _c1: STRING>'"),
    "c_from_xml": (E.from_xml(E.concat(E.lit("<r><a>"), "event_type", E.lit("</a></r>")), "a string")["a"], "event_type"), "c_to_xml": (E.to_xml(E.struct(E.col("event_type").alias("a"))).contains("<a>"), "true"), "c_xml_schema": (E.schema_of_xml(E.lit("<r><a>1</a></r>")), "'STRUCT<a: BIGINT>'"),
    "c_xpath": (j(E.xpath(E.lit("<a><b>1</b><b>2</b></a>"), E.lit("a/b/text()"))), "'1,2'"), "c_bool": (E.xpath_boolean(E.lit("<a><b>1</b></a>"), E.lit("a/b")), "true"), "c_double": (E.xpath_double(E.lit("<a><b>1</b></a>"), E.lit("sum(a/b)")), "1::DOUBLE"), "c_number": (E.xpath_number(E.lit("<a><b>1</b></a>"), E.lit("sum(a/b)")), "1::DOUBLE"), "c_float": (E.xpath_float(E.lit("<a><b>1</b></a>"), E.lit("sum(a/b)")).cast("double"), "1::DOUBLE"),
    "c_int": (E.xpath_int(E.lit("<a><b>1</b></a>"), E.lit("sum(a/b)")).cast("bigint"), "1::BIGINT"), "c_long": (E.xpath_long(E.lit("<a><b>1</b></a>"), E.lit("sum(a/b)")), "1::BIGINT"), "c_short": (E.xpath_short(E.lit("<a><b>1</b></a>"), E.lit("sum(a/b)")).cast("bigint"), "1::BIGINT"), "c_string": (E.xpath_string(E.lit("<a><b>t</b></a>"), E.lit("a/b")), "'t'"),
})

family("variant_functions", "events", "event_id", {
    "c_get": (E.variant_get(E.parse_json("props"), "$.k", "int").cast("bigint"), big("json_extract(props, '$.k')")), "c_try_get": (E.try_variant_get(E.parse_json("props"), "$.z", "int").isNull(), "json_extract(props, '$.z') IS NULL"), "c_try_parse": (E.try_parse_json(E.lit("{")).isNull(), "true"),
    "c_null": (E.is_variant_null(E.parse_json(E.lit("null"))), "true"), "c_schema": (E.schema_of_variant(E.parse_json(E.lit('{"k": 1}'))), "'OBJECT<k: BIGINT>'"), "c_object": (E.schema_of_variant(E.to_variant_object(E.struct(E.lit(1).alias("a")))).contains("a"), "true"),
})


@query("SELECT true AS same FROM region LIMIT 1")
def variant_schema_agg(t):
    return t.events.agg(F.schema_of_variant_agg(F.parse_json("props")).contains("k").alias("same"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def struct_access(t):
    c = F.struct(F.col("n_name").alias("name"), F.struct("n_regionkey").alias("inner"))
    return t.nation.select("n_nationkey", c.alias("s")).select("n_nationkey", "s.name", F.col("s")["inner"]["n_regionkey"].alias("region"))
