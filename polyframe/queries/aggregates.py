"""Aggregates, grouping sets, pivots, statistics."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .deferred import E
from .registry import family, query

family("agg_basic", "lineitem", "l_returnflag, l_linestatus", {
    "n": (E.count("*"), "count(*)"),
    "sum_qty": (E.round(E.sum("l_quantity"), 2), "round(sum(l_quantity), 2)"),
    "avg_price": (E.round(E.avg("l_extendedprice"), 4), "round(avg(l_extendedprice), 4)"),
    "mean_disc": (E.round(E.mean("l_discount"), 6), "round(avg(l_discount), 6)"),
    "lo": (E.min("l_quantity"), "min(l_quantity)"),
    "hi": (E.max("l_quantity"), "max(l_quantity)"),
}, groups="keys")

family("agg_distinct", "lineitem", "l_returnflag", {
    "parts": (E.count_distinct("l_partkey"), "count(DISTINCT l_partkey)"),
    "pairs": (E.countDistinct("l_partkey", "l_suppkey"), "count(DISTINCT (l_partkey, l_suppkey))"),
    "lines": (E.sum_distinct("l_linenumber"), "CAST(sum(DISTINCT l_linenumber) AS BIGINT)"),
    "lines_old": (E.sumDistinct("l_linenumber"), "CAST(sum(DISTINCT l_linenumber) AS BIGINT)"),
}, groups="keys")

family("agg_stats", "orders", "o_orderpriority", {
    "sd": (E.round(E.stddev("o_totalprice"), 4), "round(stddev_samp(o_totalprice), 4)"),
    "sd_samp": (E.round(E.stddev_samp("o_totalprice"), 4), "round(stddev_samp(o_totalprice), 4)"),
    "sd_std": (E.round(E.std("o_totalprice"), 4), "round(stddev_samp(o_totalprice), 4)"),
    "sd_pop": (E.round(E.stddev_pop("o_totalprice"), 4), "round(stddev_pop(o_totalprice), 4)"),
    "v": (E.round(E.variance("o_totalprice") / 1e6, 4), "round(var_samp(o_totalprice) / 1e6, 4)"),
    "v_samp": (E.round(E.var_samp("o_totalprice") / 1e6, 4), "round(var_samp(o_totalprice) / 1e6, 4)"),
    "v_pop": (E.round(E.var_pop("o_totalprice") / 1e6, 4), "round(var_pop(o_totalprice) / 1e6, 4)"),
    "r": (E.round(E.corr("o_totalprice", "o_custkey"), 8), "round(corr(o_totalprice, o_custkey), 8)"),
    "c_pop": (E.round(E.covar_pop("o_totalprice", "o_custkey"), 2), "round(covar_pop(o_totalprice, o_custkey), 2)"),
    "c_samp": (E.round(E.covar_samp("o_totalprice", "o_custkey"), 2), "round(covar_samp(o_totalprice, o_custkey), 2)"),
}, groups="keys")

family("agg_skew_kurt", "events", "event_type", {
    "skew": (E.round(E.skewness("value"), 6), "round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6)"),
    "kurt": (E.round(E.kurtosis("value"), 6), "round(kurtosis_pop(value), 6)"),
}, groups="keys")

family("agg_percentile", "events", "event_type", {
    "p25": (E.round(E.percentile("value", E.lit(0.25)), 6), "round(quantile_cont(value, 0.25), 6)"),
    "p90": (E.round(E.percentile("value", E.lit(0.9)), 6), "round(quantile_cont(value, 0.9), 6)"),
    "mid": (E.round(E.median("value"), 6), "round(median(value), 6)"),
}, groups="keys")

family("agg_min_by_max_by", "orders", "o_custkey", {
    "dearest": (E.max_by("o_orderkey", E.struct("o_totalprice", "o_orderkey")), "max_by(o_orderkey, (o_totalprice, o_orderkey))"),
    "cheapest": (E.min_by("o_orderkey", E.struct("o_totalprice", "o_orderkey")), "min_by(o_orderkey, (o_totalprice, o_orderkey))"),
}, groups="keys")

family("agg_bool", "orders", "o_orderstatus", {
    "all_big": (E.bool_and(E.col("o_totalprice") > 1000), "bool_and(o_totalprice > 1000)"),
    "each_big": (E.every(E.col("o_totalprice") > 1000), "bool_and(o_totalprice > 1000)"),
    "any_big": (E.bool_or(E.col("o_totalprice") > 400000), "bool_or(o_totalprice > 400000)"),
    "some_big": (E.some(E.col("o_totalprice") > 400000), "bool_or(o_totalprice > 400000)"),
}, groups="keys")

family("agg_bit", "lineitem", "l_returnflag", {
    "a": (E.bit_and("l_partkey"), "bit_and(l_partkey)"),
    "o": (E.bit_or("l_partkey"), "bit_or(l_partkey)"),
    "x": (E.bit_xor("l_partkey"), "bit_xor(l_partkey)"),
}, groups="keys")

family("agg_collect_sorted", "nation", "n_regionkey", {
    "names": (E.array_join(E.sort_array(E.collect_list("n_name")), ","), "array_to_string(list_sort(list(n_name)), ',')"),
    "heads": (E.array_join(E.sort_array(E.collect_set(E.substring("n_name", 1, 1))), ","), "array_to_string(list_sort(list(DISTINCT substr(n_name, 1, 1))), ',')"),
    "agg": (E.array_join(E.array_sort(E.array_agg("n_nationkey")), ","), "array_to_string(list_sort(list(n_nationkey)), ',')"),
    "said": (E.array_join(E.sort_array(E.split(E.listagg("n_name", E.lit("|")), r"\|")), "|"), "array_to_string(list_sort(list(n_name)), '|')"),
    "said_chars": (E.length(E.string_agg("n_name", E.lit("|"))).cast("bigint"), "CAST(length(string_agg(n_name, '|')) AS BIGINT)"),
    "said_distinct": (E.length(E.listagg_distinct("n_name", E.lit("|"))).cast("bigint"), "CAST(length(string_agg(DISTINCT n_name, '|')) AS BIGINT)"),
    "said_once": (E.length(E.string_agg_distinct("n_name", E.lit("|"))).cast("bigint"), "CAST(length(string_agg(DISTINCT n_name, '|')) AS BIGINT)"),
}, groups="keys")

family("agg_count_if", "events", "user_id", {
    "clicks": (E.count_if(E.col("event_type") == "click"), "CAST(count_if(event_type = 'click') AS BIGINT)"),
    "seen": (E.count("event_type"), "count(event_type)"),
    "total": (E.round(E.try_sum("value"), 4), "round(sum(value), 4)"),
    "average": (E.round(E.try_avg("value"), 4), "round(avg(value), 4)"),
}, groups="keys")

family("agg_regr", "lineitem", "l_returnflag", {
    "n": (E.regr_count("l_extendedprice", "l_quantity"), "CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT)"),
    "ax": (E.round(E.regr_avgx("l_extendedprice", "l_quantity"), 5), "round(regr_avgx(l_extendedprice, l_quantity), 5)"),
    "ay": (E.round(E.regr_avgy("l_extendedprice", "l_quantity"), 5), "round(regr_avgy(l_extendedprice, l_quantity), 5)"),
    "slope": (E.round(E.regr_slope("l_extendedprice", "l_quantity"), 4), "round(regr_slope(l_extendedprice, l_quantity), 4)"),
    "cut": (E.round(E.regr_intercept("l_extendedprice", "l_quantity"), 3), "round(regr_intercept(l_extendedprice, l_quantity), 3)"),
    "r2": (E.round(E.regr_r2("l_extendedprice", "l_quantity"), 7), "round(regr_r2(l_extendedprice, l_quantity), 7)"),
    "sxx": (E.round(E.regr_sxx("l_extendedprice", "l_quantity") / 1e3, 3), "round(regr_sxx(l_extendedprice, l_quantity) / 1e3, 3)"),
    "sxy": (E.round(E.regr_sxy("l_extendedprice", "l_quantity") / 1e6, 3), "round(regr_sxy(l_extendedprice, l_quantity) / 1e6, 3)"),
    "syy": (E.round(E.regr_syy("l_extendedprice", "l_quantity") / 1e9, 3), "round(regr_syy(l_extendedprice, l_quantity) / 1e9, 3)"),
}, groups="keys")

# Values that are one in each group, and one that is the most frequent in each.
family("agg_mode_anyvalue", "orders", "o_orderkey", {
    "flag": (E.any_value("o_orderstatus"), "min(o_orderstatus)"),
    "head": (E.first("o_totalprice"), "min(o_totalprice)"),
    "tail": (E.last("o_orderpriority"), "max(o_orderpriority)"),
    "head_value": (E.first_value("o_custkey"), "min(o_custkey)"),
    "tail_value": (E.last_value("o_orderdate"), "max(o_orderdate)"),
}, groups="keys")

family("agg_mode", "events", "event_type", {
    "most": (E.mode(E.when(E.col("event_id") % 10 < 7, E.concat("event_type", E.lit("!"))).otherwise("rest")), "event_type || '!'"),
}, groups="keys")

family("agg_first_not_null", "events", "user_id", {
    "head": (E.first(E.when(E.col("event_id") % 3 == 0, E.col("user_id") * 2), True), "CASE WHEN bool_or(event_id % 3 = 0) THEN user_id * 2 END"),
    "tail": (E.last(E.when(E.col("event_id") % 5 == 0, E.col("user_id") * 3), True), "CASE WHEN bool_or(event_id % 5 = 0) THEN user_id * 3 END"),
    "any": (E.any_value(E.when(E.col("event_id") % 4 == 0, E.col("user_id")), E.lit(True)), "CASE WHEN bool_or(event_id % 4 = 0) THEN user_id END"),
}, groups="keys")

family("agg_product", "nation", "n_regionkey", {
    "p": (E.product(E.col("n_nationkey") % 3 + 1), "product(n_nationkey % 3 + 1)"),
}, groups="keys")


@query()
def agg_approximate(t):
    """Sketches and approximate quantiles: their values differ from engine to engine."""
    return t.events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("users"),
        F.approxCountDistinct("user_id", 0.02).alias("users_close"),
        F.percentile_approx("value", 0.5, 1000).alias("mid"),
        F.approx_percentile("value", F.array(F.lit(0.1), F.lit(0.9))).alias("ends"),
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(12))).alias("users_hll"),
        F.length(F.count_min_sketch("user_id", F.lit(0.1), F.lit(0.9), F.lit(1))).alias("sketch_bytes"),
        F.size(F.histogram_numeric("value", F.lit(5))).alias("bins"),
    )


@query("SELECT event_type, count(*) AS n, true AS users, true AS users_close, true AS users_hll, true AS mid, true AS low, true AS high FROM events GROUP BY event_type")
def agg_approximate_bounds(t):
    """Sketches and approximate quantiles against exact values, within their stated errors."""
    e = t.events.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_distinct("event_id").alias("exact"),
        F.approx_count_distinct("event_id").alias("a"),
        F.approxCountDistinct("event_id", 0.02).alias("b"),
        F.hll_sketch_estimate(F.hll_sketch_agg("event_id", F.lit(12))).alias("c"),
        F.percentile_approx("value", 0.5, 1000).alias("p50"),
        F.approx_percentile("value", F.array(F.lit(0.1), F.lit(0.9)), F.lit(1000)).alias("ends"),
        *(F.percentile("value", F.lit(q)).alias(f"q{name}") for name, q in (("49", 0.49), ("51", 0.51), ("09", 0.09), ("11", 0.11), ("89", 0.89), ("91", 0.91))),
    )
    near = lambda c, share: F.abs(F.col(c) - F.col("exact")) <= share * F.col("exact")  # noqa: E731  four standard errors
    ends = F.col("ends")
    return e.select("event_type", "n", near("a", 0.2).alias("users"), near("b", 0.08).alias("users_close"), near("c", 0.08).alias("users_hll"), F.col("p50").between(F.col("q49"), F.col("q51")).alias("mid"), ends[0].between(F.col("q09"), F.col("q11")).alias("low"), ends[1].between(F.col("q89"), F.col("q91")).alias("high"))


@query("SELECT count(DISTINCT event_id) AS exact, true AS near, true AS alike FROM events")
def agg_hll_union_bounds(t):
    """A union of sketches against the exact number, and two ways to unite."""
    halves = t.events.groupBy((F.col("event_id") % 2).alias("half")).agg(F.hll_sketch_agg("event_id").alias("s"), F.count_distinct("event_id").alias("n"))
    both = halves.agg(F.sum("n").alias("exact"), F.hll_sketch_estimate(F.hll_union_agg("s")).alias("united"), F.hll_sketch_estimate(F.hll_union(F.min("s"), F.max("s"))).alias("again"))
    return both.select("exact", (F.abs(F.col("united") - F.col("exact")) <= 0.08 * F.col("exact")).alias("near"), (F.col("united") == F.col("again")).alias("alike"))


@query()
def agg_hll_union(t):
    halves = t.events.groupBy((F.col("user_id") % 2).alias("half")).agg(F.hll_sketch_agg("user_id").alias("s"))
    both = halves.agg(F.hll_union_agg("s").alias("s"), F.min("s").alias("a"), F.max("s").alias("b"))
    return both.select(F.hll_sketch_estimate("s").alias("users"), F.hll_sketch_estimate(F.hll_union("a", "b")).alias("users_again"))


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events")
def agg_bitmap(t):
    """Exact distinct counts through bitmaps that merge by union."""
    parts = t.events.groupBy(F.bitmap_bucket_number("user_id").alias("bucket"), "event_type").agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("b"))
    return parts.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("b")).alias("n")).agg(F.sum("n").alias("users"))


@query("SELECT CAST(count(*) AS BIGINT) AS users FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))")
def agg_bitmap_and(t):
    """Users with every type of event, by the intersection of bitmaps."""
    parts = t.events.groupBy(F.bitmap_bucket_number("user_id").alias("bucket"), "event_type").agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("b"))
    return parts.groupBy("bucket").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n")).agg(F.sum("n").alias("users"))


@query("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def grouped_count(t):
    return t.orders.groupby("o_orderstatus").count()


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice), 4) AS average, max(o_totalprice) AS hi, min(o_totalprice) AS lo, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def grouped_shortcuts(t):
    g = t.orders.groupBy("o_orderstatus")
    frames = [
        g.mean("o_totalprice").select("o_orderstatus", F.round("avg(o_totalprice)", 4).alias("mean")),
        g.avg("o_totalprice").select("o_orderstatus", F.round("avg(o_totalprice)", 4).alias("average")),
        g.max("o_totalprice").withColumnRenamed("max(o_totalprice)", "hi"),
        g.min("o_totalprice").withColumnRenamed("min(o_totalprice)", "lo"),
        g.sum("o_custkey").withColumnRenamed("sum(o_custkey)", "total"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "o_orderstatus")
    return out


@query('SELECT o_orderstatus, max(o_totalprice) AS "max(o_totalprice)", count(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY 1')
def grouped_agg_dict(t):
    return t.orders.groupBy("o_orderstatus").agg({"o_totalprice": "max", "o_orderkey": "count"})


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def agg_global(t):
    return t.orders.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_grouping_id(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.grouping("l_returnflag").cast("bigint").alias("g"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS BIGINT) AS g, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_grouping(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("bigint").alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(t):
    return A.grouping_sets(t.lineitem, [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def pivot_single(t):
    return A.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", [F.count(F.lit(1))], ["F", "O"]).fillna(0, ["F", "O"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F_n, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F_hi, count(*) FILTER (o_orderstatus = 'O') AS O_n, round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O_hi, count(*) FILTER (o_orderstatus = 'P') AS P_n, round(max(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P_hi FROM orders GROUP BY 1")
def pivot_multi(t):
    return A.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", [F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("hi")], ["F", "O", "P"]).fillna(0, ["F_n", "O_n", "P_n"])


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS a0, count(*) FILTER (user_id % 3 = 1) AS a1, count(*) FILTER (user_id % 3 = 2) AS a2 FROM events GROUP BY 1")
def pivot_found_values(t):
    frame = t.events.select("event_type", F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("k"))
    return A.pivot(frame, ["event_type"], "k", [F.count(F.lit(1))])


@query("SELECT p_partkey, what, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT INCLUDE NULLS (amount FOR what IN (size, price))")
def unpivot(t):
    frame = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return frame.unpivot(["p_partkey"], ["size", "price"], "what", "amount")


@query("SELECT p_partkey, what, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT INCLUDE NULLS (amount FOR what IN (size, price))")
def unpivot_all(t):
    frame = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return frame.unpivot(["p_partkey"], None, "what", "amount")


@query("SELECT round(corr(o_totalprice, o_custkey), 8) AS r, round(covar_samp(o_totalprice, o_custkey), 2) AS c FROM orders")
def stat_corr_cov(t):
    r, c = A.correlation(t.orders, "o_totalprice", "o_custkey"), A.covariance(t.orders, "o_totalprice", "o_custkey")
    return t.spark.createDataFrame([(round(r, 8), round(c, 2))], "r double, c double")


@query("SELECT quantile_disc(value, 0.5) AS mid, quantile_disc(value, 0.9) AS high FROM events")
def stat_quantiles(t):
    mid, high = A.quantiles(t.events, "value", [0.5, 0.9])
    return t.spark.createDataFrame([(mid, high)], "mid double, high double")
