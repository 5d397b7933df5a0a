"""Queries of parsers and text rules, on texts and payloads put together from the driver's tables.

The tables hold no contracts and no venue payloads, so each query first builds some from keys
and names; the SQL states what the rules must read from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import discovery, extract, fees, scores, text
from pairlens.operators import books, dedup, entities, latency, persist, reports, retrieve
from pairlens.plans import spreads
from pairlens.queries import _t, query
from pairlens.schemas import ENTITY, THRESHOLD
from pairlens.sources import venues

_NO_THRESHOLDS = f"CAST(array() AS array<{THRESHOLD}>)"


def _cases(key: str, *choices: str) -> Column:
    """SQL texts by the remainder of a key."""
    found = F.expr(choices[-1])
    for k in range(len(choices) - 2, -1, -1):
        found = F.when(F.col(key) % len(choices) == k, F.expr(choices[k])).otherwise(found)
    return found


# Rule extraction


@query(
    """
WITH p AS (SELECT p_partkey, p_size, p_partkey % 7 AS k FROM part),
t AS (
  SELECT p_partkey, p_size * 1000.0 AS value, 'dollars' AS unit, '>' AS comparison, false AS is_negated FROM p WHERE k = 0
  UNION ALL SELECT p_partkey, 1000000.0 * p_size, 'dollars', '>=', true FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, p_size, unnest(['percentage', 'numeric']), '>=', false FROM p WHERE k = 2
  UNION ALL SELECT p_partkey, p_size + 0.5, 'point', '>=', false FROM p WHERE k = 3
  UNION ALL SELECT p_partkey, p_size, 'losse', '<=', false FROM p WHERE k = 4
  UNION ALL SELECT p_partkey, 1000.0 + p_size, 'dollars', '>=', true FROM p WHERE k = 5
)
SELECT p_partkey, value::DOUBLE AS value, unit, comparison, is_negated FROM t
"""
)
def q_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = _cases(
        "p_partkey",
        "concat('Will it be above $', p_size, 'k by June? It must be above $', p_size, 'k.')",
        "concat('a budget of less than $', p_size, 'M')",
        "concat('Will turnout reach ', p_size, '%?')",
        "concat('Lakers score over ', p_size, '.5 points')",
        "concat('at most ', p_size, ' losses')",
        "concat('not to exceed $1,0', lpad(p_size, 2, '0'))",
        "concat('total exceeds 2026, no number of ', p_name)",
    )
    found = _t(spark, sf_dir, "part").select("p_partkey", F.explode(extract.thresholds(statement, F.lit(""))).alias("t"))
    return found.select("p_partkey", "t.value", "t.unit", "t.comparison", "t.is_negated")


@query(
    """
WITH e(k, name, entity_type) AS (VALUES (0, 'Kansas City Chiefs', 'person'), (0, 'Bank of America', 'person'), (2, 'lakers', 'other'), (2, 'Celtics', 'other'))
SELECT n_nationkey, name, entity_type FROM nation JOIN e ON n_nationkey % 3 = k
"""
)
def q_proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = _cases("n_nationkey", "'when Kansas City Chiefs meet'", "'nothing to see'", "'lakers vs Celtics tonight'")
    found = _t(spark, sf_dir, "nation").select("n_nationkey", F.explode(extract.regex_entities(statement, F.when(F.col("n_nationkey") % 3 == 0, "Bank of America"))).alias("e"))
    return found.select("n_nationkey", "e.name", "e.entity_type")


_NATION_TITLE = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


@query(
    f"""
WITH n AS (SELECT n_nationkey, {_NATION_TITLE} AS n FROM nation)
SELECT n_nationkey, 1 AS place, n AS name, 'location' AS entity_type FROM n
UNION ALL SELECT n_nationkey, 2, 'Reserve ' || n_nationkey, 'organization' FROM n
"""
)
def q_merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(*rows: tuple[str, str]) -> Column:
        return F.expr("array(" + ", ".join(f"CAST(named_struct('name', {n}, 'entity_type', '{k}', 'aliases', array()) AS {ENTITY})" for n, k in rows) + ")")

    both = extract.merged_entities(listed(("initcap(n_name)", "location")), listed(("n_name", "other"), ("concat('Reserve ', n_nationkey)", "organization")))
    found = _t(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(both).alias("at", "e"))
    return found.select("n_nationkey", (F.col("at") + 1).alias("place"), "e.name", "e.entity_type")


_SOURCE = "CASE c_custkey % 6 WHEN 0 THEN 'official results' WHEN 1 THEN 'Acme Data' WHEN 2 THEN 'Coinbase' WHEN 3 THEN 'NBA' WHEN 4 THEN 'Yahoo Finance' END"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = _cases("c_custkey", "'per the official results'", "'Resolved by Acme Data, at noon'", "'the NBA says; coinbase'", "'The NBA table'", "'see yahoo  finance'", "''")
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", extract.data_source(criteria, F.lit("")).alias("data_source"))


@query(f"SELECT c_custkey, {_SOURCE} AS data_source FROM customer")
def q_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("c_custkey", "data_source")


@query(f"WITH s AS (SELECT c_custkey, {_SOURCE} AS s FROM customer) SELECT c_custkey, CASE WHEN s IS NULL THEN 0.5 WHEN s IN ('NBA', 'Coinbase') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM s")
def q_data_source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("data_source") == "NBA", " nba").otherwise("COINBASE ")
    return _sources(spark, sf_dir).select("c_custkey", scores.source_score(F.col("data_source"), other).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2026-03-01' + INTERVAL (p_size) DAY END AS event_date FROM part")
def q_event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "date_format(date_add(DATE'2026-03-01', p_size), 'yyyy-MM-dd')"
    c = _cases("p_partkey", f"concat('on ', {day}, ' at noon\\nmore')", f"concat('Market Statement:\\n', {day})", "p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", text.event_date(c).alias("event_date"))


@query(
    """
SELECT p_partkey, round((CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END + CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0 END + 0.5 + CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0 END + 0 +
       CASE WHEN p_partkey % 7 = 0 THEN 0.9 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 0.7 ELSE 0 END) / 7, 6)::DOUBLE AS confidence,
       array_to_string(list_filter([CASE WHEN p_partkey % 2 <> 0 OR length(p_name) < 10 THEN 'statement' END, CASE WHEN p_partkey % 5 <> 0 THEN 'resolution_date' END, 'entities',
         CASE WHEN p_partkey % 7 <> 0 THEN 'thresholds' END, CASE WHEN p_partkey % 11 <> 0 THEN 'data_source' END], lambda x: x IS NOT NULL), ',') AS failed
FROM part
"""
)
def q_extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    statement, criteria = F.when(k % 2 == 0, F.col("p_name")).otherwise(""), F.when(k % 3 == 0, F.col("p_type"))
    date, source = F.when(k % 5 == 0, F.current_timestamp()), F.when(k % 11 == 0, F.lit("NBA"))
    none, one = F.expr(_NO_THRESHOLDS), F.expr(f"CAST(array(named_struct('value', 1.0D, 'unit', 'u', 'comparison', '>', 'is_negated', false, 'negation_context', '')) AS array<{THRESHOLD}>)")
    found = F.when(k % 7 == 0, one).otherwise(none)
    empty = F.expr(f"CAST(array() AS array<{ENTITY}>)")
    outcomes = F.array().cast("array<string>")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(scores.extraction_confidence(statement, criteria, outcomes, date, empty, found, source), 6).alias("confidence"),
        F.array_join(scores.failed_fields(statement, date, empty, found, source), ",").alias("failed"),
    )


# Comparators


def _entity(name: str, kind: str) -> str:
    return f"CAST(named_struct('name', {name}, 'entity_type', '{kind}', 'aliases', array()) AS {ENTITY})"


@query(
    """
SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_name = b.n_name THEN 1.0 - 0.15 ELSE 0.5 END::DOUBLE AS score,
       CASE WHEN a.n_name = b.n_name THEN 2 ELSE 1 END AS matched, (a.n_name = b.n_name)::INTEGER AS mismatched
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey
"""
)
def q_entity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation")
    left = rows.select("n_regionkey", F.col("n_nationkey").alias("a"), F.expr(f"array({_entity(chr(39) + 'BTC' + chr(39), 'other')}, {_entity('n_name', 'location')})").alias("x"))
    right = rows.select("n_regionkey", F.col("n_nationkey").alias("b"), F.expr(f"array({_entity('initcap(n_name)', 'other')}, {_entity(chr(39) + 'bitcoin' + chr(39), 'other')})").alias("y"))
    found = left.join(right, "n_regionkey").select("a", "b", entities.entity_score(F.col("x"), F.col("y")).alias("s"))
    return found.select("a", "b", F.round("s.score", 6).alias("score"), "s.matched", "s.mismatched")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Bitcoin' WHEN 1 THEN 'Federal Reserve' WHEN 2 THEN 'Supreme Court' ELSE lower(c_name) END AS name FROM customer")
def q_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", entities.canonical_name(_cases("c_custkey", "'XBT'", "'The Fed'", "'the court'", "c_name")).alias("name"))


@query(
    """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0.0 WHEN p_partkey % 4 = 2 THEN 0.5
       ELSE ((CASE WHEN p_partkey % 4 = 0 AND abs(p_size - 25) <= 25 * 0.05 THEN 1 ELSE 0 END) + 1) / 2.0 END::DOUBLE AS score FROM part
"""
)
def q_threshold_list_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(value: str, unit: str, comparison: str) -> str:
        return f"CAST(named_struct('value', CAST({value} AS DOUBLE), 'unit', '{unit}', 'comparison', '{comparison}', 'is_negated', false, 'negation_context', '') AS {THRESHOLD})"

    goals = one("3", "goal", ">=")
    a = _cases("p_partkey", *[f"array({one('25', 'point', '>')}, {goals})"] * 2, _NO_THRESHOLDS, f"array({goals})")
    b = _cases("p_partkey", f"array({goals}, {one('p_size', 'point', '>')})", f"array({goals}, {one('25', 'point', '<')})", _NO_THRESHOLDS, _NO_THRESHOLDS)
    return _t(spark, sf_dir, "part").select("p_partkey", scores.threshold_score(a, b).alias("score"))


@query(
    """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Yes:YES,No:NO' WHEN 1 THEN 'Yes:YES,No:NO' WHEN 2 THEN '' ELSE 'A:X,B:Y' END AS mapping,
       false AS inverted, n_nationkey % 4 = 1 AS crossed FROM nation
"""
)
def q_outcome_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _cases("n_nationkey", "array('Yes', 'No')", "array('Yes', 'No')", "array('Lakers', 'Celtics')", "array('A', 'B', 'C')")
    b = _cases("n_nationkey", "array('true', 'false')", "array(' NO', 'y')", "array('Yes', 'No')", "array('X', 'Y')")
    found = scores.outcome_mapping(a, b)
    shown = F.array_join(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    crossed = _cases("n_nationkey", "map('Yes', 'yes')", "map('Yes ', 'no')", "map('A', 'no')", "map('no', 'NO')")
    return _t(spark, sf_dir, "nation").select("n_nationkey", shown.alias("mapping"), scores.is_inverted(found).alias("inverted"), scores.is_inverted(crossed).alias("crossed"))


@query("SELECT o_orderkey, least('c' || o_custkey, 'o' || o_orderkey) || '_' || greatest('c' || o_custkey, 'o' || o_orderkey) AS pair_key FROM orders")
def q_pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", scores.pair_key(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")).alias("pair_key"))


@query(
    """
SELECT l_orderkey, l_linenumber, CASE WHEN d < 1 THEN 'same' WHEN d < 7 THEN 'possibly_same' ELSE 'different' END AS gap
FROM (SELECT l_orderkey, l_linenumber, abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
)
def q_date_gap_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", scores.date_gap_class(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("gap"))


@query("SELECT doc_id, 'Find the same contract' || chr(10) || source AS instructed, CASE WHEN len(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short FROM documents WHERE text IS NOT NULL")
def q_instructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", scores.instructed(F.col("source"), "Find the same contract").alias("instructed"), text.truncated(F.col("text"), 40).alias("short"))


@query("SELECT c_custkey, lower(c_mktsegment) || ';b c' AS listed FROM customer")
def q_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.array_join(text.listed(F.concat("c_mktsegment", F.lit(", B c ,,"), "c_mktsegment")), ";").alias("listed"))


# Discovery

_TITLES = "CASE n_nationkey % 5 WHEN 0 THEN 'T1 wins Map 2' WHEN 1 THEN 'League of  Legends final' WHEN 2 THEN 'Rainfall in ' || n_name WHEN 3 THEN 'the Lollapalooza line-up' ELSE 'Valorant cup' END"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _cases("n_nationkey", "'T1 wins Map 2'", "'League of  Legends final'", "concat('Rainfall in ', n_name)", "'the Lollapalooza line-up'", "'Valorant cup'")
    return _t(spark, sf_dir, "nation").withColumn("title", title)


@query(
    f"""
WITH t AS (SELECT n_nationkey, {_TITLES} AS title, n_regionkey FROM nation)
SELECT n_nationkey, n_nationkey % 5 IN (0, 1, 4) AS pair_is_esports, n_nationkey % 5 IN (1, 4) OR n_regionkey = 2 AS polymarket,
       regexp_matches(title, '(?i)\\b(valorant|map)\\b') AS kalshi, contains(lower(title), 'final') OR contains(lower(title), 'rain') AS mentioned FROM t
"""
)
def q_discovery_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("n_regionkey") == 2, '{"category": "Esports - LoL"}').otherwise('{"category": "", "categories": "weather"}')
    t = F.col("title")
    return _titled(spark, sf_dir).select(
        "n_nationkey",
        discovery.esports_pair(t, F.lit("")).alias("pair_is_esports"),
        discovery.polymarket_esports(t, F.lit(None).cast("string"), payload).alias("polymarket"),
        discovery.kalshi_keywords(t, F.lit(""), F.lit("KX1"), ("VALORANT", "map")).alias("kalshi"),
        discovery.mentions(t, ("FINAL", "rain")).alias("mentioned"),
    )


@query("SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'polymarket' ELSE 'kalshi' END AS venue FROM nation WHERE (n_nationkey % 2 = 0 AND n_nationkey % 5 IN (1, 4)) OR (n_nationkey % 2 = 1 AND n_nationkey % 5 = 4)")
def q_esports_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir).withColumns({"venue": F.when(F.col("n_nationkey") % 2 == 0, "polymarket").otherwise("kalshi"), "description": F.lit(""), "raw_payload": F.lit("{}"), "venue_market_id": F.lit("X")})
    return rows.where(discovery.accepts("esports")).select("n_nationkey", "venue")


# Venue payloads


def _payloads(spark: SparkSession, sf_dir: str, *forms: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", _cases("s_suppkey", *forms).alias("payload"), F.lit(None).cast("timestamp").alias("received_at"))


@query(
    """
SELECT 'K' || s_suppkey AS venue_market_id, 'kalshi' AS venue, 'updated' AS event_type, CASE s_suppkey % 4 WHEN 0 THEN s_name ELSE 'sub ' || s_suppkey END AS title,
       CASE s_suppkey % 4 WHEN 0 THEN 'rules' ELSE 'more' END AS description, TIMESTAMP '2026-03-01 12:00:00' AS end_date, 2 AS outcomes
FROM supplier WHERE s_suppkey % 4 < 2
"""
)
def q_kalshi_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def market(rest: str) -> str:
        return f"""concat('{{"markets": [{{"ticker": "K', s_suppkey, '", ', {rest}, ', "expiration_time": "2026-03-01T12:00:00Z"}}]}}')"""

    rows = _payloads(
        spark,
        sf_dir,
        market("""'"status": "active", "title": "', s_name, '", "rules_primary": "rules"'"""),
        market("""'"status": "Open", "title": "", "subtitle": "sub ', s_suppkey, '", "rules_secondary": "more"'"""),
        market("""'"status": "settled", "title": "x"'"""),
        "'not json'",
    )
    found = venues.kalshi_listing(rows)
    return found.select("venue_market_id", "venue", "event_type", "title", "description", "end_date", F.size("outcomes").alias("outcomes"))


@query(
    """
SELECT 'K' || s_suppkey AS venue_market_id, CASE s_suppkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'created' END AS event_type,
       CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN 'K' || s_suppkey ELSE 'event' END AS title, CASE WHEN s_suppkey % 5 = 0 THEN make_timestamp(1700000000000000 + s_suppkey::BIGINT * 1000000) END AS end_date
FROM supplier WHERE s_suppkey % 5 < 3
"""
)
def q_kalshi_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def market(rest: str) -> str:
        return f"""concat('{{"type": "market_lifecycle_v2", "msg": {{"market_ticker": "K', s_suppkey, '", ', {rest}, '}}}}')"""

    rows = _payloads(
        spark,
        sf_dir,
        market("""'"event_type": "created", "close_ts": ', 1700000000 + s_suppkey, ', "additional_metadata": {"title": "', s_name, '"}'"""),
        market("""'"event_type": "close_date_updated"'"""),
        """concat('{"type": "event_lifecycle", "msg": {"event_ticker": "K', s_suppkey, '", "title": "", "subtitle": "event"}}')""",
        market("""'"event_type": "determined"'"""),
        """'{"type": "subscribed", "msg": {}}'""",
    )
    return venues.venue_events("kalshi", rows).select("venue_market_id", "event_type", "title", "end_date")


@query(
    """
SELECT 'P' || s_suppkey AS venue_market_id, 'Q ' || s_name AS title, 'Up:t' || s_suppkey || ',Down:' AS outcomes, TIMESTAMP '2026-05-04 03:02:01' AS end_date FROM supplier WHERE s_suppkey % 3 < 2
"""
)
def q_polymarket_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = """concat('{"id": "P', s_suppkey, '", "question": "Q ', s_name, '", "active": ACTIVE, "closed": false, "endDate": "2026-05-04T03:02:01Z", "outcomes": "[\\\\"Up\\\\", \\\\"Down\\\\"]", "clobTokenIds": "[\\\\"t', s_suppkey, '\\\\"]"}')"""
    listing, wrapped, idle = f"concat('[', {market.replace('ACTIVE', 'true')}, ']')", f"""concat('{{"data": [', {market.replace('ACTIVE', 'true')}, ']}}')""", f"concat('[', {market.replace('ACTIVE', 'false')}, ']')"
    found = venues.polymarket_listing(_payloads(spark, sf_dir, listing, wrapped, idle))
    shown = F.array_join(F.transform("outcomes", lambda o: F.concat(o["label"], F.lit(":"), o["outcome_id"])), ",")
    return found.select("venue_market_id", "title", shown.alias("outcomes"), "end_date")


@query(
    """
SELECT 'P' || s_suppkey AS venue_market_id, CASE s_suppkey % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'resolved' ELSE 'updated' END AS event_type, CASE WHEN s_suppkey % 4 < 2 THEN s_name ELSE '' END AS title
FROM supplier WHERE s_suppkey % 4 < 3
"""
)
def q_polymarket_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = """concat('{"type": "market", "data": {"id": "P', s_suppkey, '", "question": "', s_name, '", "status": "STATUS"}}')"""
    rows = _payloads(spark, sf_dir, market.replace("STATUS", "open"), market.replace("STATUS", "resolved"), """concat('{"type": "price", "market_id": "P', s_suppkey, '"}')""", """'{"type": "pong"}'""")
    return venues.venue_events("polymarket", rows).select("venue_market_id", "event_type", "title")


_TOPS = "s_suppkey % 40 + 30"


@query(
    f"""
SELECT s_suppkey, ({_TOPS}) / 100 AS yes_bid, ({_TOPS} + 2) / 100 AS yes_ask, round(1 - ({_TOPS} + 2) / 100, 4) AS no_bid,
       CASE WHEN s_suppkey % 2 = 0 THEN ({_TOPS} + 9) / 100 ELSE round(1 - ({_TOPS}) / 100, 4) END AS no_ask, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10.0 ELSE 0 END::DOUBLE AS volume
FROM supplier
"""
)
def q_kalshi_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = f"""'"yes_bid": ', {_TOPS}, ', "yes_ask": ', {_TOPS} + 2"""
    rows = _payloads(spark, sf_dir, f"""concat('{{"market": {{', {asked}, ', "no_ask": ', {_TOPS} + 9, ', "volume": ', s_suppkey * 10, '}}}}')""", f"""concat('{{"market": {{', {asked}, '}}}}')""")
    return venues.kalshi_top(rows.drop("received_at")).drop("close_time")


@query(
    """
WITH b AS (SELECT s_suppkey, 40 + s_suppkey % 10 AS y, 45 AS n FROM supplier)
SELECT s_suppkey, 'orderbook' AS source, round(1 - n / 100, 4) AS ask, 7.0::DOUBLE AS size, 1 AS levels FROM b WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'top_of_book', 0.9, greatest(100, least(s_suppkey * 1000 * 0.01, 10000))::DOUBLE, 1 FROM b WHERE s_suppkey % 2 = 1
"""
)
def q_kalshi_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir, """concat('{"orderbook": {"yes": [[', 40 + s_suppkey % 10, ', 5]], "no": [[45, 7], [0, 3]]}}')""", """concat('{"orderbook": {"yes": [], "no": [[45, 7]]}}')""")
    even = F.col("s_suppkey") % 2 == 0
    top = {"yes_bid": F.lit(0.4), "yes_ask": F.when(even, 0.55).otherwise(0.9), "no_bid": F.lit(0.45), "no_ask": F.when(even, 1 - (40 + F.col("s_suppkey") % 10) / 100).otherwise(0.6), "volume": F.col("s_suppkey") * 1000.0}
    found = venues.kalshi_book(rows.withColumns(top))
    return found.select("s_suppkey", "source", F.round(F.get("yes_asks", F.lit(0))["price"], 4).alias("ask"), F.get("yes_asks", F.lit(0))["size"].alias("size"), F.size("yes_asks").alias("levels"))


@query("SELECT s_suppkey, 'y' || s_suppkey AS yes_token, 'n' AS no_token, CASE WHEN s_suppkey % 2 = 0 THEN 0.25::DOUBLE END AS price, TIMESTAMP '2026-05-04' AS end_date FROM supplier")
def q_gamma_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = """concat('{"clobTokenIds": "[\\\\"y', s_suppkey, '\\\\", \\\\"n\\\\"]", "outcomePrices": "[\\\\"PRICE\\\\"]", "endDate": "2026-05-04"}')"""
    found = venues.gamma_market(_payloads(spark, sf_dir, form.replace("PRICE", "0.25"), form.replace("PRICE", "soon")).drop("received_at"))
    return found.select("s_suppkey", "yes_token", "no_token", F.get("prices", F.lit(0)).alias("price"), "end_date")


@query(
    """
SELECT s_suppkey, 'orderbook_partial' AS source, 'yes' AS outcome, 'ask' AS side, p AS price, 10.0::DOUBLE AS size FROM supplier, (VALUES (0.4::DOUBLE), (0.6::DOUBLE)) v(p) WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'orderbook_partial', 'yes', 'bid', 0.3, 4.0 FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'orderbook_partial', 'no', 'ask', 0.7, 4.0 FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'gamma_mid', o, k, p, 100.0 FROM supplier, (VALUES ('yes', 0.25::DOUBLE), ('no', 0.75::DOUBLE)) v(o, p), (VALUES ('ask'), ('bid')) w(k) WHERE s_suppkey % 3 = 1
"""
)
def q_polymarket_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = """'{"asks": [{"price": "0.6", "size": "10"}, {"price": "0.4", "size": "10"}, {"price": "1.2", "size": "1"}], "bids": [{"price": "0.3", "size": "4"}]}'"""
    rows = _payloads(spark, sf_dir, book, "'{}'", "'{}'")
    empty = F.expr("CAST(array() AS array<struct<price:double,size:double>>)")
    prices = F.when(F.col("s_suppkey") % 3 == 1, F.array(F.lit(0.25), F.lit(0.75)))
    rows = rows.select("s_suppkey", venues.clob_levels("asks", False).alias("yes_asks"), venues.clob_levels("bids", True).alias("yes_bids"), empty.alias("no_asks"), empty.alias("no_bids"), prices.alias("prices"))
    # Without Yes prices nothing turns a book round, so the No side comes from the Yes bids.
    found = venues.polymarket_book(rows)
    long = venues.exploded(found.withColumns({"venue": F.col("source"), "venue_market_id": F.col("s_suppkey")}))
    return long.select(F.col("vmid").alias("s_suppkey"), F.col("venue").alias("source"), "outcome", "side", F.round("price", 6).alias("price"), "size")


@query("SELECT 'M7' AS market_id, 'a' AS yes_token, 'b' AS no_token WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 7)")
def q_resolve_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = """concat('{"slug": "slug-', s_suppkey, '", "conditionId": "M', s_suppkey, '", "clobTokenIds": "[\\\\"a\\\\", \\\\"b\\\\"]"}')"""
    return venues.resolve_market(_payloads(spark, sf_dir, form, form), "slug-7")


@query("SELECT s_suppkey, 'G' || s_suppkey AS game_id, 'LCK' AS league, '1/3' AS period, s_suppkey % 2 = 0 AS live FROM supplier")
def q_game_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = """concat('{"gameId": "G', s_suppkey, '", "leagueAbbreviation": "LCK", "period": "1/3"LIVE}')"""
    rows = _payloads(spark, sf_dir, form.replace("LIVE", """, "live": true"""), form.replace("LIVE", ""))
    return venues.game_state(rows.drop("received_at")).select("s_suppkey", "game_id", "league", "period", "live")


@query(
    """
WITH g AS (SELECT s_suppkey % 7 AS game_number, min(s_suppkey)::VARCHAR AS market_id FROM supplier WHERE s_suppkey % 7 BETWEEN 1 AND 5 AND s_suppkey < 1000 GROUP BY ALL)
SELECT game_number::INTEGER AS game_number, market_id, CASE WHEN game_number = 2 THEN 'live' WHEN game_number < 2 THEN 'completed' ELSE 'scheduled' END AS status, game_number = 2 AS is_current FROM g
"""
)
def q_series_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").where("s_suppkey < 1000")
    named = rows.select(F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("market_id"), F.concat(F.lit("A vs B GAME "), F.col("s_suppkey") % 7).alias("title"))
    found = venues.series_status(venues.series_games(named), F.lit("2/5"), F.lit("LIVE"))
    return found.select("game_number", F.ltrim("market_id", F.lit("0")).alias("market_id"), "status", "is_current")


@query(
    """
SELECT 'm' || s_suppkey || '-' || (s_suppkey * 1000)::VARCHAR || '-CHAMPION_KILL-4-' AS event_id, 'CHAMPION_KILL' AS event_type, TIMESTAMP '2026-01-01' + INTERVAL (s_suppkey) SECOND AS event_timestamp FROM supplier
UNION ALL SELECT 'm' || s_suppkey || '-5-DRAGON_KILL--', 'DRAGON_KILL', TIMESTAMP '2026-01-01 00:00:00.005' FROM supplier
"""
)
def q_timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kill = """'{"type": "CHAMPION_KILL", "timestamp": ', s_suppkey * 1000, ', "killerId": "4"}'"""
    form = f"""concat('{{"info": {{"frames": [{{"events": [', {kill}, ', {{"type": "ITEM", "timestamp": 3}}]}}, {{"events": [', {kill}, ', {{"type": "DRAGON_KILL", "timestamp": 5}}]}}]}}}}')"""
    rows = _payloads(spark, sf_dir, form, form)
    found = venues.timeline_events(rows.select("payload", F.concat(F.lit("m"), "s_suppkey").alias("match_id"), F.lit("2026-01-01").cast("timestamp").alias("game_start")))
    return found.select("event_id", "event_type", "event_timestamp")


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 'updated' ELSE 'created' END AS event_type FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, event_type FROM events WHERE event_type <> 'purchase'")
def q_first_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "created").otherwise(F.col("event_type"))
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("venue_market_id"), kind.alias("event_type"), F.struct("ts", "event_id").alias("received_at"))
    return venues.first_created(rows).select("event_id", "event_type")


# Opportunities, state and reports


@query("SELECT l_orderkey, l_linenumber, greatest(100, least(l_extendedprice * 0.01, 10000))::DOUBLE AS size, greatest(1, floor((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1996-01-01')) / 86400000000.0))::BIGINT AS days FROM lineitem")
def q_book_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("1996-01-01").cast("timestamp")
    days = fees.days_to_resolution(F.col("l_shipdate").cast("timestamp"), F.lit(None).cast("timestamp"), as_of)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fees.top_depth(F.col("l_extendedprice")).alias("size"), days.alias("days"))


@query(
    """
WITH o AS (SELECT s_suppkey, s_suppkey % 9 / 100 AS d, 10 + s_suppkey % 50 AS q FROM supplier),
b AS (SELECT *, round(1 - (0.40 + d + 0.45), 4) AS gross_edge, round(1 - (0.40 + d + 0.45) - 0.07 * 0.45 * 0.55, 4) AS net_profit_1, q - q * (0.40 + d + 0.45) - 0.07 * q * 0.45 * 0.55 AS best FROM o)
SELECT s_suppkey::VARCHAR AS pair_key, gross_edge, net_profit_1, round(greatest(best, 0), 2) AS max_profit FROM b WHERE net_profit_1 > 0
"""
)
def q_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    pairs = s.select(
        key.alias("pair_key"), F.lit("polymarket").alias("venue_a"), key.alias("vmid_a"), F.lit("kalshi").alias("venue_b"), key.alias("vmid_b"),
        F.lit("x").alias("title_a"), F.lit("x").alias("title_b"), F.create_map(F.lit("Yes"), F.lit("YES")).alias("outcome_mapping"),
        F.lit("2026-02-01").cast("timestamp").alias("date_a"), F.lit(None).cast("timestamp").alias("date_b"),
    )
    # One level a side; the other direction costs more than one.
    asks = F.array(
        *[F.struct(F.lit(v).alias("venue"), F.lit(o).alias("outcome"), p.alias("price"), (10 + F.col("s_suppkey") % 50).cast("double").alias("size")) for v, o, p in (("polymarket", "yes", 0.40 + F.col("s_suppkey") % 9 / 100), ("polymarket", "no", F.lit(0.60)), ("kalshi", "yes", F.lit(0.50)), ("kalshi", "no", F.lit(0.45)))]
    )
    levels = s.select(key.alias("vmid"), F.explode(asks).alias("x")).select("x.venue", "vmid", "x.outcome", "x.price", "x.size")
    found = spreads.scan(pairs, levels, F.lit("2026-01-01").cast("timestamp"))
    return found.select("pair_key", "gross_edge", "net_profit_1", F.round("max_profit", 2).alias("max_profit"))


@query("SELECT count(*) AS opportunities, sum(p_size)::DOUBLE AS profit, sum(p_retailprice) AS capital, sum(CASE WHEN p_partkey % 60 <= 30 THEN p_retailprice ELSE 0 END) AS recyclable_capital, min(p_partkey % 60) AS first_days, max(p_partkey % 60) AS last_days FROM part WHERE p_size > 10")
def q_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select((F.col("p_size") - 10).alias("net_profit_1"), F.col("p_size").cast("double").alias("max_profit"), F.col("p_retailprice").alias("optimal_capital"), (F.col("p_partkey") % 60).alias("days_to_resolution"))
    return books.portfolio(rows)


@query("SELECT DISTINCT 's' AS venue, l_suppkey::VARCHAR AS vmid FROM lineitem UNION SELECT 'p', l_partkey::VARCHAR FROM lineitem")
def q_to_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.lit("s").alias("venue_a"), F.col("l_suppkey").cast("string").alias("vmid_a"), F.lit("p").alias("venue_b"), F.col("l_partkey").cast("string").alias("vmid_b"))
    return spreads.to_price(rows)


@query("SELECT DISTINCT o_custkey AS venue_market_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49")
def q_changed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("token_id"))
    return dedup.changed_markets(updates, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token_id"), F.col("o_custkey").alias("venue_market_id")))


@query("SELECT s_suppkey AS point_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM supplier")
def q_overwrite_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"))
    return persist.overwrite_points(rows.withColumn("state", F.lit("old")), rows.where("point_id % 3 = 0").withColumn("state", F.lit("new")))


@query("""SELECT DISTINCT '{"pair_key":"' || o_custkey || '","ts":"t"}' AS payload FROM orders""")
def q_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persist.change_log(_t(spark, sf_dir, "orders").withColumn("pair_key", F.col("o_custkey").cast("string")), "pair_key", F.lit("t"))


@query("""SELECT 'calls' AS category, '{"timestamp":"t","severity":"' || CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END || '","record":{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' AS value FROM events""")
def q_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type")
    return persist.audit_lines(rows, "calls", F.when(F.col("event_type") == "error", "high").otherwise("low"), F.lit("t"))


@query(
    """
WITH e AS (SELECT p_partkey::VARCHAR AS pair_key, p_size / 100 AS edge FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey::VARCHAR AS pair_key, CASE WHEN p_partkey % 2 = 0 THEN 'no' ELSE 'yes' END AS side_a, round(coalesce(edge + 0.01, 0.1), 6) AS gross_edge, coalesce(edge, 0) AS net_edge FROM part LEFT JOIN e ON pair_key = p_partkey::VARCHAR
"""
)
def q_best_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").withColumn("pair_key", F.col("p_partkey").cast("string"))
    edge = F.col("p_size") / 100
    both = rows.where("p_partkey % 2 = 0").select("pair_key", F.explode(F.array(F.struct(F.lit("yes").alias("side_a"), edge.alias("gross_edge")), F.struct(F.lit("no").alias("side_a"), (edge + 0.01).alias("gross_edge")))).alias("x"), edge.alias("net_profit_1"))
    half = F.lit(0.5)
    found = both.select("pair_key", "x.side_a", F.lit("no").alias("side_b"), half.alias("ask_a"), half.alias("ask_b"), "x.gross_edge", "net_profit_1", half.alias("pnl_at_budget"), half.alias("daily_yield_bps"))
    shown = reports.best_snapshots(found, rows.select("pair_key", F.lit(0.4).alias("ask_a"), half.alias("ask_b")), F.lit(None).cast("timestamp"))
    return shown.select("pair_key", "side_a", F.round("gross_edge", 6).alias("gross_edge"), "net_edge")


@query("SELECT event_id, value * 1.0 AS ingestion_ms FROM events")
def q_ingestion_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros(text.micros("ts") + F.round(F.col("value") * 1000).cast("long"))
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_timestamp"), at.alias("ingestion_timestamp"))
    return latency.ingestion_latency(rows).select("event_id", "ingestion_ms")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'line two' END AS title FROM part WHERE p_partkey % 5 > 1")
def q_valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 5 == 0, "elsewhere").otherwise("kalshi").alias("venue"), F.when(k % 5 != 1, "Market Statement:\nline two\nx").alias("canonical_text"), F.lit("v").alias("venue_market_id"), F.lit("h").alias("identity_hash"), F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("title")
    )
    return retrieve.valid_candidates(rows, ("kalshi",)).select("p_partkey", "title")


@query(
    """
SELECT * FROM (SELECT count(*) AS events_received, count_if(event_type = 'view') AS events_deduplicated, count_if(event_type NOT IN ('view', 'error') AND user_id IS NOT NULL) AS events_processed,
  count_if(event_type = 'error') AS events_failed, count_if(event_type NOT IN ('view', 'error') AND user_id % 4 = 0) AS events_no_candidates FROM events),
(SELECT count(*) AS pairs_found, count_if(l_returnflag = 'A') AS pairs_equivalent, count_if(l_returnflag = 'N') AS pairs_needs_review, count_if(l_returnflag = 'R') AS pairs_not_equivalent,
  count_if(l_linestatus = 'F') AS pairs_persisted FROM lineitem)
"""
)
def q_pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select((F.col("event_type") == "view").alias("duplicate"), (F.col("event_type") == "error").alias("failed"), (F.col("user_id") % 4).alias("candidates"))
    verdict = F.when(F.col("l_returnflag") == "A", "equivalent").when(F.col("l_returnflag") == "N", "needs_review").otherwise("not_equivalent")
    return reports.pipeline_counters(events, _t(spark, sf_dir, "lineitem").select(verdict.alias("verdict"), (F.col("l_linestatus") == "F").alias("persisted")))


@query("SELECT (count(*) - count(DISTINCT l_partkey))::BIGINT AS hits, count(DISTINCT l_partkey) AS misses, (count(*) - count(DISTINCT l_partkey)) / count(*) AS hit_rate FROM lineitem")
def q_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cache_stats(_t(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'absent' WHEN 2 THEN 'limited' ELSE 'failed' END AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS body FROM orders")
def q_fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("element_at(array(200, 404, 429, 500), int(o_orderkey % 4) + 1)")
    return venues.fetched(_t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderpriority").alias("body"))).select("o_orderkey", "outcome", "body")


@query("SELECT p_partkey FROM part WHERE p_partkey % 6 = 0")
def q_match_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Red Foxes").otherwise("Foxes"), F.lit(" vs BLUE OWLS - "), F.when(F.col("p_partkey") % 3 == 0, "Game 3").otherwise("Game 2"))
    return _t(spark, sf_dir, "part").where(discovery.match_search(title, ("red foxes", "rfx"), ("blue owls",), ("game 3", "game3"))).select("p_partkey")
