"""Queries that drain streams over the driver's tables, and queries over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import FEE_RATES, Settings
from pairlens.folders import new_folder
from pairlens.operators import chains, metric
from pairlens.operators.store import KeyedTable
from pairlens.queries import _LATENCY, _WINDOW_MS, ORACLES, _t, query
from pairlens.streaming import live, pairs, reactions

#: A time behind all others: it ends every window, so a drained stream holds nothing back.
_END = "2200-01-01"


def _stream(spark: SparkSession, sf_dir: str, name: str, end: str, kinds: tuple[str, ...], column: str) -> DataFrame:
    """The table as a stream, with a last row for each of ``kinds`` at the end of time."""
    table = _t(spark, sf_dir, name)
    last = new_folder(spark, f"{name}-end")
    filled = [F.explode(F.array(*map(F.lit, kinds))).alias(c) if c == column else F.lit(_END if c == end else None).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    spark.range(1).select(*filled).write.parquet(last)
    # A pattern, since a stream takes a single file by pattern alone.
    parts = [spark.readStream.schema(table.schema).parquet(path) for path in (f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet", last)]
    return parts[0].union(parts[1])


def _drained(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    folder = new_folder(spark, label)
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query(_LATENCY + "SELECT * FROM f")
def q_stream_first_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    rows = _stream(spark, sf_dir, "events", "ts", ("purchase", "view"), "event_type")
    bought = rows.where("event_type = 'purchase'").select("event_id", F.col("ts").alias("event_ts"))
    seen = rows.where("event_type = 'view'").select(F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("snap_id"))
    found = reactions.first_reactions(bought, seen, _WINDOW_MS, seq=["snap_id"], slot_ms=6 * _WINDOW_MS)
    return _drained(spark, found, "first-reactions").select("event_id", "event_ts", "snapshot_ts", "snap_id", "latency_ms")


_INTERVAL_MS = 5 * 86_400_000


@query(
    f"""
WITH c AS (
  SELECT user_id, CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN 'b' ELSE 'a' END AS side, CASE WHEN event_id % 2 = 0 THEN 'no' ELSE 'yes' END AS outcome,
         round(1 - (46 + event_id % 8) / 100.0, 6)::DOUBLE AS price, event_id % 4 * 10 AS size, epoch_us(ts) AS us, event_id
  FROM events
), ends AS (
  SELECT DISTINCT user_id, us // ({_INTERVAL_MS}::BIGINT * 1000) + 1 AS k FROM c
), states AS (
  SELECT e.user_id, e.k, c.side, c.outcome, c.price, c.size, row_number() OVER (PARTITION BY e.user_id, e.k, c.side, c.outcome, c.price ORDER BY c.us DESC, c.event_id DESC) AS n
  FROM ends e JOIN c ON c.user_id = e.user_id AND c.us < e.k * {_INTERVAL_MS}::BIGINT * 1000
), tops AS (
  SELECT user_id, k, side, min(price) FILTER (outcome = 'yes') AS yes_ask, min(price) FILTER (outcome = 'no') AS no_ask
  FROM states WHERE n = 1 AND size > 0 GROUP BY user_id, k, side
), sane AS (
  SELECT * FROM tops WHERE coalesce(yes_ask + no_ask >= {Settings().book_floor}, true)
), both_ AS (
  SELECT a.user_id, a.k, x.side_a, x.side_b, CASE WHEN x.side_a = 'yes' THEN a.yes_ask ELSE a.no_ask END AS ask_a, CASE WHEN x.side_b = 'yes' THEN b.yes_ask ELSE b.no_ask END AS ask_b
  FROM sane a JOIN sane b ON a.user_id = b.user_id AND a.k = b.k AND a.side = 'a' AND b.side = 'b', (VALUES ('yes', 'no'), ('no', 'yes')) x(side_a, side_b)
)
SELECT user_id::VARCHAR AS pair_key, k * {_INTERVAL_MS}::BIGINT AS interval_ms, side_a, side_b, ask_a, ask_b, round(1 - (ask_a + ask_b), 4) AS gross_edge,
       round(1 - (ask_a + ask_b) - {FEE_RATES['kalshi']} * ask_b * (1 - ask_b), 4) AS net_profit_1
FROM both_ WHERE ask_a IS NOT NULL AND ask_b IS NOT NULL AND round(1 - (ask_a + ask_b), 4) >= -0.10
"""
)
def q_stream_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("end"))
    # The last row belongs to a pair of its own: what belongs to none doesn't move time on.
    table = _t(spark, sf_dir, "events").where("user_id IS NOT NULL").select(user.alias("u")).distinct().union(spark.range(1).select(F.lit("end")))
    none = F.lit(None).cast("timestamp")
    watched = table.select(F.col("u").alias("pair_key"), F.lit("polymarket").alias("venue_a"), F.col("u").alias("vmid_a"), F.lit("kalshi").alias("venue_b"), F.col("u").alias("vmid_b"), F.lit(False).alias("inverted"), none.alias("date_a"), none.alias("date_b"))
    rows = _stream(spark, sf_dir, "events", "ts", ("view",), "event_type").where("user_id IS NOT NULL OR event_id IS NULL")
    venue = F.when(F.col("event_type").isin("purchase", "error", "signup"), "kalshi").otherwise("polymarket")
    outcome = F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no")
    # The last row has no id and so no level: it moves time on.
    price, size = (46 + F.coalesce("event_id", F.lit(0)) % 8) / 100, F.coalesce(F.col("event_id") % 4 * 10, F.lit(0))
    changes = rows.select(venue.alias("venue"), user.alias("vmid"), "ts", F.col("event_id").alias("seq"), F.lit(-1).cast("long").alias("snapshot"), F.coalesce(outcome, F.lit("no")).alias("outcome"), price.alias("price"), size.cast("double").alias("size"))
    folder = new_folder(spark, "live-scan")
    step = pairs.scan_step(watched, lambda found, i: found.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}"))
    stream = pairs.pair_books(changes, watched, _INTERVAL_MS, "ts").writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    schema = "pair_key string, interval_ms long, side_a string, side_b string, ask_a double, ask_b double, gross_edge double, net_profit_1 double"
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*[c.split()[0] for c in schema.split(", ")])


@query(ORACLES["q_upsert_markets"])
def q_stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer")
    table = KeyedTable(spark, new_folder(spark, "customers"), "c_custkey long, c_name string, text_hash string", ["c_custkey"], 16)
    old = rows.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("text_hash"))
    hash_ = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("NEW")
    new = rows.where("c_custkey % 3 = 0 OR c_custkey % 5 <> 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), hash_.alias("text_hash"))
    # The second batch comes twice, as after a restart.
    for k, batch in enumerate((old, new, new)):
        table.upsert(batch, "text_hash", F.lit(None).cast("timestamp"), batch=("q", min(k, 1)))
    return table.read()


@query(ORACLES["q_scd2_current"])
def q_stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = KeyedTable(spark, new_folder(spark, "orders"), f"{schema}, version int, is_current boolean", ["o_custkey"], 16)
    # Later orders come in a second batch, which also brings some known ones again.
    for batch in (rows.where("o_orderdate < '1996-01-01'"), rows.where("o_orderdate >= '1995-12-01'")):
        table.add_versions(batch, ["o_orderdate", "o_orderkey"])
    return table.read().select("o_custkey", "o_orderkey", "version", "is_current")


@query(ORACLES["q_topk_cross_label"])
def q_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.similar(_t(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 20, 0.3)


@query(ORACLES.get("q_ttl_dedup"))
def q_ttl_dedup_in_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return chains.ttl_dedup(rows, ["user_id", "event_type"], "ts", ["event_id"], 86_400)
