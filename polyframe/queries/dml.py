"""UPDATE, DELETE and MERGE as rewrites."""

from pyspark.sql import functions as F

from ..operators.dml import WhenMatched, WhenNotMatched, WhenNotMatchedBySource, deleted, merged, updated
from .registry import query


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rewrite(t):
    return updated(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": 0.0, "c_mktsegment": "DEBT"}, "c_acctbal < 0")


@query("SELECT event_id, event_type FROM events WHERE nullif(event_type, 'view') <> 'click' OR nullif(event_type, 'view') IS NULL")
def delete_rewrite(t):
    return deleted(t.events.select("event_id", "event_type"), F.nullif("event_type", F.lit("view")) == "click")


MERGE = """
WITH source AS (
  SELECT s_suppkey * 2 AS k, s_acctbal AS b FROM supplier UNION ALL SELECT 1000000 + s_suppkey, -1.0 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT c_custkey, CASE WHEN k IS NOT NULL AND c_acctbal < b THEN b WHEN k IS NULL AND c_custkey % 10 = 0 THEN -5.0 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN k IS NULL AND c_custkey % 10 = 0 THEN 'LOST' ELSE c_mktsegment END AS c_mktsegment
FROM customer LEFT JOIN source ON c_custkey = k
WHERE NOT (k IS NOT NULL AND NOT c_acctbal < b AND b < 1000) AND NOT (k IS NULL AND c_custkey % 10 = 1)
UNION ALL
SELECT k, b, 'NEW' FROM source WHERE b < 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)
"""


@query(MERGE)
def merge_rewrite(t):
    target = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    fresh = t.supplier.where("s_suppkey % 2 = 0").select((F.lit(1000000) + F.col("s_suppkey")).alias("k"), F.lit(-1.0).alias("b"))
    source = t.supplier.select((F.col("s_suppkey") * 2).alias("k"), F.col("s_acctbal").alias("b")).union(fresh)
    return merged(
        target,
        source,
        F.col("c_custkey") == F.col("k"),
        [
            WhenMatched(F.col("c_acctbal") < F.col("b")).update({"c_acctbal": F.col("b")}),
            WhenMatched(F.col("b") < 1000).delete(),
            WhenNotMatched(F.col("b") < 0).insert({"c_custkey": F.col("k"), "c_acctbal": F.col("b"), "c_mktsegment": "NEW"}),
            WhenNotMatchedBySource(F.col("c_custkey") % 10 == 0).update({"c_acctbal": -5.0, "c_mktsegment": "LOST"}),
            WhenNotMatchedBySource(F.col("c_custkey") % 10 == 1).delete(),
        ],
    )
