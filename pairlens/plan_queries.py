"""Queries of the matching plan's parts: routing of events, verification by ids, batches over several tables, books and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.folders import new_folder
from pairlens.operators import persist, reports
from pairlens.plans import matching
from pairlens.queries import _t, query
from pairlens.schemas import ENTITY, THRESHOLD
from pairlens.streaming import live

_EVENTS = "WITH e AS (SELECT s_suppkey::VARCHAR AS id, CASE s_nationkey % 4 WHEN 0 THEN 'kalshi' WHEN 1 THEN 'polymarket' WHEN 2 THEN 'opinion' END AS venue, CASE WHEN s_acctbal > 0 THEN s_name END AS title FROM supplier)"


def _market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("s_nationkey") % 4
    venue = F.when(kind == 0, "kalshi").when(kind == 1, "polymarket").when(kind == 2, "opinion")
    none = F.lit(None).cast("string")
    return _t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("venue_market_id"),
        venue.alias("venue"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("title"),
        none.alias("resolution_criteria"),
        none.alias("description"),
        F.lit(None).cast("timestamp").alias("end_date"),
        F.array(F.struct(F.lit("1").alias("outcome_id"), F.lit("Yes").alias("label"))).alias("outcomes"),
    )


@query(
    _EVENTS
    + """ SELECT id AS venue_market_id, coalesce(venue IN ('kalshi', 'polymarket'), false) AND title IS NOT NULL AS built,
       CASE WHEN venue IN ('kalshi', 'polymarket') AND title IS NOT NULL THEN sha256(venue || ':' || id) END AS identity_hash FROM e"""
)
def q_builder_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, failed = matching.canonicalised(_market_events(spark, sf_dir))
    rows = built.select("venue_market_id", F.lit(True).alias("built"), "identity_hash")
    return rows.union(failed.select("venue_market_id", F.lit(False), F.lit(None).cast("string")))


@query(
    _EVENTS
    + """, h AS (SELECT id, venue, title, sha256(venue || ':' || id) AS h FROM e WHERE venue IN ('kalshi', 'polymarket') AND title IS NOT NULL)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id, venue, id AS venue_market_id, title FROM h"""
)
def q_vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = matching.vector_points(_market_events(spark, sf_dir))
    return points.where(F.exists("vector", lambda x: x != 0)).select("point_id", "venue", "venue_market_id", "title")


@query("SELECT o_orderkey::VARCHAR AS pair_key, CASE o_orderstatus WHEN 'F' THEN 'equivalent' WHEN 'P' THEN 'needs_review' END AS verdict FROM orders WHERE o_orderstatus IN ('F', 'P')")
def q_persistable(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", "equivalent").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("not_equivalent")
    return matching.persistable(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pair_key"), verdict.alias("verdict")))


@query(
    """
WITH s AS (SELECT p_partkey AS k, p_size > 25 AS named, p_retailprice > 1000 AS priced, p_brand = 'Brand#11' AS sourced FROM part WHERE p_size <> 7),
m AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part)
SELECT least(m.a::VARCHAR, m.b::VARCHAR) || '_' || greatest(m.a::VARCHAR, m.b::VARCHAR) AS pair_key, x.named OR y.named AS entity_informative, x.priced OR y.priced AS threshold_informative, x.sourced OR y.sourced AS source_informative,
       CASE WHEN x.named AND y.named THEN 1.0 ELSE 0.5 END::DOUBLE AS entity_score
FROM m JOIN s x ON x.k = m.a JOIN s y ON y.k = m.b
"""
)
def q_verify_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _t(spark, sf_dir, "part")
    key = F.col("p_partkey")
    entity = F.expr(f"CAST(array(named_struct('name', 'Same', 'entity_type', 'other', 'aliases', CAST(array() AS array<string>))) AS array<{ENTITY}>)")
    threshold = F.expr(f"CAST(array(named_struct('value', 1.0D, 'unit', 'dollars', 'comparison', '>', 'is_negated', false, 'negation_context', CAST(NULL AS string))) AS array<{THRESHOLD}>)")
    specs = parts.where("p_size <> 7").select(
        F.concat(key.cast("string"), F.lit("_spec")).alias("spec_id"),
        F.when(F.col("p_size") > 25, entity).otherwise(F.array().cast(f"array<{ENTITY}>")).alias("entities"),
        F.when(F.col("p_retailprice") > 1000, threshold).otherwise(F.array().cast(f"array<{THRESHOLD}>")).alias("thresholds"),
        F.lit(None).cast("timestamp").alias("resolution_date"),
        F.when(F.col("p_brand") == "Brand#11", "Reuters").alias("data_source"),
        F.array(F.lit("Yes"), F.lit("No")).alias("outcome_labels"),
    )
    matches = parts.select(key.cast("string").alias("market_a_id"), (key + 1).cast("string").alias("market_b_id"), F.lit(0.9).alias("score"))
    return matching.verify_by_id(matches, specs).select("pair_key", "entity_informative", "threshold_informative", "source_informative", "entity_score")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate < '1995-01-01' THEN 0 ELSE 1 END::BIGINT AS batch FROM orders")
def q_committed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    root = new_folder(spark, "batches")
    tables = [("keys", lambda b: b.select("o_orderkey", "o_custkey")), ("totals", lambda b: b.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")))]
    step = persist.commit_together(root, tables)
    for number, batch in enumerate((orders.where("o_orderdate < '1995-01-01'"), orders.where("o_orderdate >= '1995-01-01'"))):
        step(batch, number)
    # A batch that has its marker is not written again, one without is never seen.
    step(orders, 1)
    orders.select("o_orderkey", "o_custkey").write.parquet(f"{root}/keys/batch=2")
    return persist.committed(spark, root, "keys", "o_orderkey long, o_custkey long")


@query(
    """
WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey::VARCHAR AS vmid, 40 + (l_discount * 100)::INTEGER AS cents, l_quantity AS size FROM lineitem)
SELECT vmid, seq, 'yes' AS outcome, cents / 100.0 AS price, size::DOUBLE AS size FROM m UNION ALL SELECT vmid, seq, 'no', (90 - cents) / 100.0, 0.0 FROM m
"""
)
def q_delta_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = 40 + F.round(F.col("l_discount") * 100).cast("int")
    payload = F.format_string('{"type":"orderbook_delta","msg":{"market_ticker":"%s","yes":[[%d,%s]],"no":[[%d,0]]}}', F.col("l_partkey").cast("string"), cents, F.col("l_quantity").cast("string"), 90 - cents)
    messages = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), payload.alias("payload"))
    # Messages of another kind, and broken ones, hold no levels.
    other = messages.select("seq", F.explode(F.array(F.lit('{"type":"ticker"}'), F.lit("not json"), F.lit(None).cast("string"))).alias("payload"))
    return live.delta_levels(messages.union(other)).select("vmid", "seq", "outcome", "price", "size")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 10 DAY")
def q_still_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", "ts")
    return live.still_fresh(rows, "ts", 10 * 86_400.0, F.lit("2024-01-15").cast("timestamp"))


@query(
    """
WITH b AS (
  SELECT user_id::VARCHAR AS vmid, CASE WHEN event_id % 2 = 0 THEN 'no' ELSE 'yes' END AS outcome, round(1 - (30 + event_id % 40) / 100.0, 6)::DOUBLE AS price, (event_id % 3 * 5)::DOUBLE AS size, event_id,
         max(event_id) OVER (PARTITION BY user_id) AS seq
  FROM events WHERE user_id IS NOT NULL
), l AS (SELECT *, row_number() OVER (PARTITION BY vmid, outcome, price ORDER BY event_id DESC) AS n FROM b)
SELECT vmid, outcome, price, size, seq FROM l WHERE n = 1 AND size > 0
"""
)
def q_stream_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    table = _t(spark, sf_dir, "events")
    events = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/event[s].parquet").where("user_id IS NOT NULL")
    outcome = F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no")
    deltas = events.select(
        F.lit("kalshi").alias("venue"),
        F.col("user_id").cast("string").alias("vmid"),
        F.col("event_id").alias("seq"),
        F.lit(-1).cast("long").alias("snapshot"),
        outcome.alias("outcome"),
        ((30 + F.col("event_id") % 40) / 100).alias("price"),
        (F.col("event_id") % 3 * 5).cast("double").alias("size"),
    )
    folder = new_folder(spark, "books")
    step = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}")
    live.books(deltas).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = live.BookState.SCHEMA
    # A book is whole in the last batch that touched it.
    found = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows")
    last = found.groupBy("vmid").agg(F.max("batch").alias("batch"))
    return found.join(last, ["vmid", "batch"], "left_semi").select("vmid", "outcome", "price", "size", "seq")


@query(
    """
SELECT p_partkey::VARCHAR AS pair_key, rpad('actionable', 10, ' ') || '  ' || rpad(p_partkey::VARCHAR, 40, ' ') || '  A ' || rpad('yes', 3, ' ') || ' ' || format('{:,.4f}', p_size / 100.0) || '  B ' || rpad('no', 3, ' ') || ' N/A  edge ' || format('{:,.4f}', p_size / 50.0)
       || '  net ' || format('{:,.4f}', p_size / 50.0) || '  at budget ' || format('{:,.2f}', p_size * 1000.0) || '  bps a day N/A  days ' || p_size::VARCHAR AS line
FROM part
"""
)
def q_opportunity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, none = F.col("p_size"), F.lit(None).cast("double")
    rows = _t(spark, sf_dir, "part").select(
        F.lit("actionable").alias("section"), F.col("p_partkey").cast("string").alias("pair_key"), F.lit("yes").alias("side_a"), F.lit("no").alias("side_b"), (size / 100).alias("ask_a"), none.alias("ask_b"),
        (size / 50).alias("gross_edge"), (size / 50).alias("net_profit_1"), (size * 1000).cast("double").alias("pnl_at_budget"), none.alias("daily_yield_bps"), size.alias("days_to_resolution"),
    )
    return reports.opportunity_lines(rows).select("pair_key", "line")
