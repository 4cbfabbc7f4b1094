"""Keyed updates as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.operators import upsert
from shiftframe.sources.tables import table

from .catalog import query


@query(
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1
    UNION ALL SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'click') c WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')"""
)
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    old = upsert.keep_last(events.where("event_type = 'click'"), ["user_id"], [F.desc("event_id")])
    return upsert.upserted(old, events.where("event_type = 'purchase'"), ["user_id"], [F.desc("event_id")]).drop("event_type")


PAIRS = "SELECT o_orderkey AS ext_id, o_custkey * 31 + day(o_orderdate) AS player_id, o_orderstatus FROM orders"


@query(f"WITH p AS ({PAIRS}) SELECT ext_id, player_id FROM p WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM p k WHERE k.o_orderstatus = 'F' AND k.player_id = p.player_id AND k.ext_id <> p.ext_id)")
def upsert_guarded(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ext_id"), (F.col("o_custkey") * 31 + F.dayofmonth("o_orderdate")).alias("player_id"), "o_orderstatus")
    known, new = pairs.where("o_orderstatus = 'F'").drop("o_orderstatus"), pairs.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return upsert.guarded(new, known, "ext_id", "player_id")


@query("SELECT c.c_custkey, coalesce(CASE WHEN c.c_custkey % 3 > 0 THEN c.c_acctbal END, o.top) AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def fill_null_update(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return upsert.fill_null(old, new, ["c_custkey"], "c_acctbal")
