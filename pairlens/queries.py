"""Catalogue of queries: each operator on the driver's tables, with the SQL that gives the same rows.

The tables aren't markets, so columns stand in for those of markets (see the README); the
operators are those that market data goes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.functions import fees, scores, text
from pairlens.operators import books, dedup, latency, persist, reports, retrieve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Hashes and texts


@query("SELECT o_orderkey, sha256(o_orderpriority || ':' || o_orderkey::VARCHAR) AS identity_hash FROM orders")
def q_identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.identity_hash(F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("identity_hash"))


_NORMAL = r"""
  SELECT doc_id, source, list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
         lambda x: regexp_replace(x, '[\x{09}\x{0B}\x{0C}\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '')) AS lines
  FROM documents
"""
_HASHED = f"""
WITH n AS ({_NORMAL}), h AS (
  SELECT doc_id, source, sha256(rtrim(array_to_string(list_filter(lines, lambda x, i: x <> '' OR i = 1 OR lines[i - 1] <> ''), chr(10)), chr(10))) AS content_hash FROM n
)
"""


@query(_HASHED + "SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id FROM h GROUP BY content_hash HAVING count(*) > 1")
def q_content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_CANONICAL = """
  SELECT p_partkey, 'Market Statement:' || chr(10) || p_name || chr(10) || chr(10) || 'Resolution Criteria:' || chr(10) || p_type || chr(10) || chr(10) ||
         'Clarifications:' || chr(10) || '- ' || p_brand || chr(10) || chr(10) || 'End Date: 2026-03-01' || chr(10) || chr(10) || 'Outcomes: Yes, No, Draw' AS canonical_text
  FROM part
"""


def _canonical_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(F.lit("Yes"), F.lit("No"), F.lit("Draw"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", text.canonical_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.to_timestamp(F.lit("2026-03-01 12:00:00")), labels).alias("canonical_text"))


@query(_CANONICAL)
def q_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_parts(spark, sf_dir).select("p_partkey", "canonical_text")


@query("SELECT p_partkey, trim(p_name) AS statement, trim(p_type) AS criteria, ['Yes', 'No', 'Draw'] AS outcomes, '2026-03-01' AS end_date, TIMESTAMP '2026-03-01' AS parsed FROM part")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("canonical_text")
    return _canonical_parts(spark, sf_dir).select(
        "p_partkey",
        text.parse_statement(c).alias("statement"),
        text.parse_criteria(c).alias("criteria"),
        text.parse_outcomes(c).alias("outcomes"),
        text.parse_end_date(c).alias("end_date"),
        text.parse_date(text.parse_end_date(c)).alias("parsed"),
    )


@query(
    r"""
WITH c AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(text, '[.;]\s+'), lambda x: trim(x)) AS parts FROM conversations),
k AS (SELECT conv_id, turn, list_filter(parts, lambda x: len(x) > 10) AS parts FROM c)
SELECT conv_id, turn, unnest(range(len(parts)))::INTEGER AS clause_no, unnest(parts) AS clause FROM k
"""
)
def q_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.secondary_clauses(F.col("text"))).alias("clause_no", "clause"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(the|token|apache)\b') AS matches FROM documents")
def q_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.keyword_match(F.col("text"), ("the", "token", "apache")).alias("matches"))


@query(
    """
WITH t AS (
  SELECT item_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda x: x <> '') AS a FROM benchmark
)
SELECT x.item_id AS id_a, y.item_id AS id_b,
       round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 6) AS jaccard
FROM t x JOIN t y ON y.item_id = x.item_id + 1
""".replace("\\\\", "\\")
)
def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("a"))
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("id_b"), F.col("a").alias("b"))
    return rows.join(other, "item_id").select(F.col("item_id").alias("id_a"), "id_b", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# JSON, deduplication, fan-in


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def q_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def q_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return dedup.first_seen(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT user_id, event_type, event_id, ts, n, ts AS kept_at, true AS kept FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.event_id, e.ts, e.n,
         CASE WHEN epoch_us(e.ts) - epoch_us(f.kept_at) > 86400000000 THEN e.ts ELSE f.kept_at END,
         epoch_us(e.ts) - epoch_us(f.kept_at) > 86400000000
  FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1
)
SELECT event_id, user_id, event_type, ts FROM f WHERE kept
"""
)
def q_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return dedup.ttl_dedup(rows, ["user_id", "event_type"], "ts", ["event_id"], 86_400)


@query("SELECT 's' AS side, s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'c', c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.lit("s").alias("side"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = _t(spark, sf_dir, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return dedup.fan_in(s, c)


@query("SELECT user_id, event_type, interval_start, event_id, value FROM (SELECT user_id, event_type, event_id, value, time_bucket(INTERVAL 6 HOUR, ts) AS interval_start, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q_throttle_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlens.streaming.live import throttled

    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return throttled(rows, ["user_id", "event_type"], "ts", ["ts", "event_id"], "6 hours").select("user_id", "event_type", "interval_start", "event_id", "value")


# Vectors

_COSINE = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"
_TOPK = f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, {_COSINE} AS similarity FROM e a JOIN e b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id)::INTEGER AS rank FROM s WHERE similarity >= 0.3),
k AS (SELECT query_id, rank, candidate_id, similarity FROM r WHERE rank <= 20)
"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.similar(_t(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", least=0.3)


@query(_TOPK + "SELECT * FROM k")
def q_topk_cross_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir)


@query(
    _TOPK
    + """SELECT least(query_id, candidate_id)::VARCHAR || '_' || greatest(query_id, candidate_id)::VARCHAR AS pair_key,
       arg_min(query_id, (rank, query_id)) AS query_id, arg_min(candidate_id, (rank, query_id)) AS candidate_id, max(similarity) AS similarity
FROM k GROUP BY least(query_id, candidate_id), greatest(query_id, candidate_id)"""
)
def q_pair_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.one_direction(_similar(spark, sf_dir))


@query("SELECT vec_id, list_slice(embedding, 1, 32)::DOUBLE[] AS short, len(embedding) AS dimensions FROM embeddings")
def q_mrl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", scores.resized(F.col("embedding"), 32).cast("array<double>").alias("short"), F.size("embedding").cast("long").alias("dimensions"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings WHERE vec_id = 7")
def q_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").withColumn("identity_hash", F.col("vec_id").cast("string"))
    found = retrieve.by_identity(rows, "7").withColumn("v", F.col("embedding").cast("array<double>"))
    return found.select("vec_id", F.round(F.sqrt(scores.dot(F.col("v"), F.col("v"))), 6).alias("length"))


# Scores


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity") / 50
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("e"), (F.col("l_discount") + 0.1).alias("n"), (1 - q).alias("c"))


_NLI = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS e, l_discount + 0.1 AS n, 1 - l_quantity / 50 AS c FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, CASE WHEN e + n + c > 0 THEN e / (e + n + c) ELSE e END AS e, CASE WHEN e + n + c > 0 THEN n / (e + n + c) ELSE n END AS n, CASE WHEN e + n + c > 0 THEN c / (e + n + c) ELSE c END AS c FROM x),
m AS (SELECT l_orderkey, l_linenumber, least(e, c) AS e, n, greatest(c, e) AS c FROM s)
SELECT l_orderkey, l_linenumber,
       round(least(greatest(CASE WHEN e >= 0.7 THEN e WHEN n > 0.3 OR e BETWEEN 0.4 AND 0.7 THEN 0.6 * e + 0.4 * n WHEN c > 0.5 THEN 1 - c ELSE e END, 0), 1), 6) AS confidence,
       CASE WHEN e >= 0.7 THEN 'full_match' WHEN n > 0.3 OR e BETWEEN 0.4 AND 0.7 THEN 'partial_match' ELSE 'no_match' END AS match_type
FROM m
"""


@query(_NLI)
def q_nli_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward = scores.nli_normalised(F.col("e"), F.col("n"), F.col("c"))
    reverse = scores.nli_normalised(F.col("c"), F.col("n"), F.col("e"))
    confidence, kind = scores.nli_confidence(*scores.nli_both_ways(forward, reverse))
    return _triples(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(confidence, 6).alias("confidence"), kind.alias("match_type"))


_RERANK = """
WITH c AS (SELECT l_orderkey AS q, l_suppkey AS cand, l_linenumber AS clause, max(greatest(l_discount * 8 + 0.2, 0)) AS best FROM lineitem GROUP BY ALL),
s AS (SELECT q, cand, avg(best) AS secondary FROM c GROUP BY ALL),
p AS (SELECT l_orderkey AS q, l_suppkey AS cand, max(l_quantity) / 50 AS pri FROM lineitem GROUP BY ALL),
x AS (SELECT p.q, p.cand, pri, CASE WHEN pri < 0.35 THEN pri ELSE 0.7 * pri + 0.3 * secondary END AS raw FROM p JOIN s USING (q, cand)),
k AS (SELECT q, cand, round(raw, 6) AS score, CASE WHEN pri < 0.35 OR raw < 0.7 THEN 'no_match' WHEN pri > 0.7 THEN 'full_match' ELSE 'partial_match' END AS match_type FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand)::INTEGER AS place FROM k WHERE score >= 0.7)
SELECT q, cand, score, match_type, place FROM r WHERE place <= 10
"""


@query(_RERANK)
def q_rerank_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlens.operators import rerank

    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("cand"), F.col("l_linenumber").alias("clause"), "l_quantity", (F.col("l_discount") * 8 + 0.2).alias("confidence"))
    best = rerank.best_match_mean(rerank.dealt(rows, "q"), ["q", "cand"], "clause", "confidence", ("l_quantity",))
    score, kind = scores.rerank_score(F.col("primary"), F.col("secondary"))
    scored = best.withColumn("primary", F.col("l_quantity") / 50).select("q", "cand", F.round(score, 6).alias("score"), kind.alias("match_type"))
    return rerank.kept(scored, "q", tie=("cand",)).select("q", "cand", "score", "match_type", "place")


_GRID = """
SELECT p_partkey, (p_partkey % 11) / 10 AS ce, (p_partkey // 11 % 6) / 5 AS entity, (p_partkey // 66 % 4) / 3 AS threshold,
       [1.0, 0.9, 0.7, 0.4][(p_size % 4) + 1]::DOUBLE AS date, p_size % 3 > 0 AS ei, p_size % 5 > 0 AS ti, p_size % 7 = 0 AS esports, p_size % 2 = 0 AS multi FROM part
"""
_VERDICT = f"""
WITH g AS ({_GRID}),
w AS (SELECT *, (0.5 * ce + 0.1 * date + CASE WHEN ei THEN 0.15 * entity ELSE 0 END + CASE WHEN ti THEN 0.2 * threshold ELSE 0 END) / (0.6 + CASE WHEN ei THEN 0.15 ELSE 0 END + CASE WHEN ti THEN 0.2 ELSE 0 END) AS weighted,
      esports AND ce > 0.75 AS relaxed, CASE WHEN esports AND ce > 0.75 THEN 0.6 ELSE 0.8 END AS tol FROM g)
SELECT p_partkey, round(weighted, 6) AS weighted,
  CASE WHEN ce < 0.5 THEN 'not_equivalent' WHEN multi AND ei AND entity < 0.4 THEN 'not_equivalent'
       WHEN (ei AND entity < tol * 0.5 - 1e-9) OR (ti AND threshold < 0.3 - 1e-9) OR date < CASE WHEN relaxed THEN 0.3 ELSE 0.5 END - 1e-9 THEN 'not_equivalent'
       WHEN weighted >= CASE WHEN relaxed THEN 0.75 ELSE 0.9 END - 1e-9 AND (NOT ei OR entity >= tol - 1e-9) AND (NOT ti OR threshold >= 0.8 - 1e-9) AND date >= CASE WHEN relaxed THEN 0.6 ELSE 0.8 END - 1e-9 AND ce >= 0.7 - 1e-9 THEN 'equivalent'
       WHEN weighted < 0.5 - 1e-9 THEN 'not_equivalent' ELSE 'needs_review' END AS verdict,
  round(CASE WHEN ce < 0.5 THEN ce WHEN multi AND ei AND entity < 0.4 THEN least(entity, threshold, date) ELSE weighted END, 6) AS confidence
FROM w
"""


@query(_VERDICT)
def q_fusion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    grid = _t(spark, sf_dir, "part").select(
        "p_partkey",
        ((k % 11) / 10).alias("ce"),
        (F.expr("p_partkey DIV 11 % 6") / 5).alias("entity"),
        (F.expr("p_partkey DIV 66 % 4") / 3).alias("threshold"),
        F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.9, 0.7, 0.4)]), s % 4 + 1).alias("date"),
        (s % 3 > 0).alias("ei"),
        (s % 5 > 0).alias("ti"),
        (s % 7 == 0).alias("esports"),
        (s % 2 == 0).alias("multi"),
    )
    parts = {"cross_encoder": (F.col("ce"), F.lit(True)), "threshold": (F.col("threshold"), F.col("ti")), "entity": (F.col("entity"), F.col("ei")), "date": (F.col("date"), F.lit(True))}
    rows = grid.withColumn("weighted", scores.weighted_score(parts))
    verdict, confidence = scores.verdict(*[F.col(c) for c in ("ce", "entity", "threshold", "date", "weighted", "ei", "ti", "esports", "multi")])
    return rows.select("p_partkey", F.round("weighted", 6).alias("weighted"), verdict.alias("verdict"), F.round(confidence, 6).alias("confidence"))


@query(
    """
WITH d AS (SELECT l_orderkey, l_linenumber, abs(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, days::BIGINT AS days, CASE WHEN days = 0 THEN 1.0 WHEN days <= 1 THEN 0.9 WHEN days <= 7 THEN 0.7 WHEN days <= 30 THEN 0.4 ELSE 0.3 END::DOUBLE AS score FROM d
"""
)
def q_date_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("l_shipdate"), F.col("o_orderdate")
    return rows.select("l_orderkey", "l_linenumber", scores.days_apart(a, b).cast("long").alias("days"), scores.date_score(a, b).alias("score"))


@query(
    """
WITH s AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src3') THEN NULL ELSE upper(source) END AS a, CASE WHEN doc_id % 3 = 0 THEN ' ' || source ELSE lang END AS b FROM documents)
SELECT doc_id, CASE WHEN a IS NULL THEN 0.5 WHEN lower(trim(a)) = lower(trim(b)) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM s
"""
)
def q_source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(~F.col("source").isin("src0", "src3"), F.upper("source"))
    b = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source")).otherwise(F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", scores.source_score(a, b).alias("score"))


@query("SELECT p_partkey, CASE WHEN abs(p_retailprice - 1000) <= 10 THEN 1.0 WHEN abs(p_retailprice - 1000) <= 50 THEN 0.8 WHEN abs(p_retailprice - 1000) <= 100 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM part")
def q_threshold_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", scores.threshold_value_score(F.lit(1000.0), F.col("p_retailprice")).alias("score"))


# Books: market = part, venue = return flag (a pair of books is A and R), yes / no = line status O / F

_BOOK_SETTINGS = Settings(ladder_step=50.0, budget=100.0, ladder_rungs=20)
_KEYS = ["market"]

_LEVELS = """
levels AS (
  SELECT l_partkey AS market, l_returnflag AS venue, CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS outcome,
         round(0.45 + l_discount, 4) + 0.0 AS price, sum(l_quantity) AS size
  FROM lineitem GROUP BY ALL
)"""
_SCHED = f"""
WITH {_LEVELS},
sched AS (
  SELECT *, sum(size) OVER w AS cum_qty, sum(price * size) OVER w AS cum_cost,
         sum(CASE WHEN venue = 'R' THEN 0.07 * size * price * (1 - price) ELSE 0 END) OVER w AS cum_fee
  FROM levels WINDOW w AS (PARTITION BY market, venue, outcome ORDER BY price ROWS UNBOUNDED PRECEDING)
),
seg AS (
  SELECT *, coalesce(lag(cum_qty) OVER w, 0) AS prev_qty, coalesce(lag(cum_cost) OVER w, 0) AS prev_cost, coalesce(lag(cum_fee) OVER w, 0) AS prev_fee
  FROM sched WINDOW w AS (PARTITION BY market, venue, outcome ORDER BY price)
),
a AS (SELECT * FROM seg WHERE venue = 'A' AND outcome = 'yes'),
b AS (SELECT * FROM seg WHERE venue = 'R' AND outcome = 'no'),
depth AS (SELECT market, least(x.q, y.q) AS max_qty FROM (SELECT market, max(cum_qty) AS q FROM a GROUP BY market) x JOIN (SELECT market, max(cum_qty) AS q FROM b GROUP BY market) y USING (market))
"""


def _at(points: str) -> str:
    """SQL for the outlay at points (market, tag, q)."""
    return f"""
SELECT p.market, p.tag, p.q,
       a.prev_cost + (p.q - a.prev_qty) / (a.cum_qty - a.prev_qty) * (a.cum_cost - a.prev_cost)
     + b.prev_cost + (p.q - b.prev_qty) / (b.cum_qty - b.prev_qty) * (b.cum_cost - b.prev_cost)
     + a.prev_fee + (p.q - a.prev_qty) / (a.cum_qty - a.prev_qty) * (a.cum_fee - a.prev_fee)
     + b.prev_fee + (p.q - b.prev_qty) / (b.cum_qty - b.prev_qty) * (b.cum_fee - b.prev_fee) AS outlay
FROM ({points}) p JOIN a ON a.market = p.market AND p.q > a.prev_qty AND p.q <= a.cum_qty
JOIN b ON b.market = p.market AND p.q > b.prev_qty AND p.q <= b.cum_qty"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem")
    price = (F.round(0.45 + F.col("l_discount"), 4) + 0.0).alias("price")
    outcome = F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("outcome")
    return rows.groupBy(F.col("l_partkey").alias("market"), F.col("l_returnflag").alias("venue"), outcome, price).agg(F.sum("l_quantity").alias("size"))


def _schedules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rate = F.when(F.col("venue") == "R", 0.07).otherwise(0.0)
    levels = _levels(spark, sf_dir)
    sides = (levels.where("venue = 'A' AND outcome = 'yes'"), levels.where("venue = 'R' AND outcome = 'no'"))
    return tuple(books.schedule(s, _KEYS, rate) for s in sides)


@query(_SCHED + "SELECT market, venue, outcome, price, size, round(cum_qty, 4) AS cum_qty, round(cum_cost, 4) AS cum_cost FROM seg")
def q_book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = books.schedule(_levels(spark, sf_dir), ["market", "venue", "outcome"])
    return found.select("market", "venue", "outcome", "price", "size", F.round("cum_qty", 4).alias("cum_qty"), F.round("cum_cost", 4).alias("cum_cost"))


@query(f"WITH {_LEVELS} SELECT market, venue, outcome, price, round(0.07 * size * price * (1 - price), 6) AS fee FROM levels")
def q_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    fee = fees.entry_fee(F.col("size"), F.col("price"), F.lit(0.07))
    return _levels(spark, sf_dir).select("market", "venue", "outcome", "price", F.round(fee, 6).alias("fee"))


_CURVE = (
    _SCHED
    + ", curve AS ("
    + _at("SELECT market, i AS tag, max_qty * i / 20 AS q FROM depth, range(1, 21) r(i)")
    + "), points AS (SELECT market, tag::INTEGER AS step, round(q, 9) AS quantity, round(outlay, 9) AS total_cost, round(q - outlay, 9) AS guaranteed_profit, round((q - outlay) / outlay * 100, 9) AS roi_pct FROM curve)"
)


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.pnl_curve(*_schedules(spark, sf_dir), _KEYS, _BOOK_SETTINGS, (9, 9, 9))


@query(_CURVE + " SELECT * FROM points")
def q_pnl_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir)


@query(
    _CURVE
    + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY guaranteed_profit DESC, step) AS n FROM points) WHERE n = 1)
SELECT market, CASE WHEN guaranteed_profit > 0 THEN quantity ELSE 0 END AS optimal_qty, CASE WHEN guaranteed_profit > 0 THEN guaranteed_profit ELSE 0 END AS max_profit,
       CASE WHEN guaranteed_profit > 0 THEN total_cost ELSE 0 END AS optimal_capital, CASE WHEN guaranteed_profit > 0 THEN roi_pct ELSE 0 END AS optimal_roi_pct FROM best"""
)
def q_optimal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.optimal_size(_curve(spark, sf_dir), _KEYS)


@query(
    _CURVE
    + """, t AS (SELECT *, max(guaranteed_profit) OVER (PARTITION BY market) AS top FROM points)
SELECT market, min(CASE WHEN guaranteed_profit >= top * 0.5 THEN quantity END) AS qty_50, min(CASE WHEN guaranteed_profit >= top * 0.8 THEN quantity END) AS qty_80,
       min(CASE WHEN guaranteed_profit >= top * 0.95 THEN quantity END) AS qty_95 FROM t WHERE top > 0 GROUP BY market"""
)
def q_diminishing_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.diminishing_returns(_curve(spark, sf_dir), _KEYS)


_OUTLAY = (
    _SCHED
    + ", knots AS ("
    + _at("SELECT market, 0 AS tag, q FROM (SELECT market, cum_qty AS q FROM a UNION SELECT market, cum_qty FROM b) JOIN depth USING (market) WHERE q <= max_qty")
    + """), ends AS (
  SELECT market, q AS q1, outlay AS out1, coalesce(lag(q) OVER w, 0) AS q0, coalesce(lag(outlay) OVER w, 0) AS out0, max(outlay) OVER (PARTITION BY market) AS max_out
  FROM knots WINDOW w AS (PARTITION BY market ORDER BY q)
)"""
)


@query(
    _OUTLAY
    + """, spent AS (SELECT *, least(100.0::DOUBLE, max_out) AS capital FROM ends), hit AS (
  SELECT market, capital, q0 + (capital - out0) / (out1 - out0) * (q1 - q0) AS q FROM spent WHERE capital > out0 AND capital <= out1
)
SELECT market, round(capital, 6) AS capital, round(q, 6) AS quantity, round(q - capital, 6) AS guaranteed_profit, round((q - capital) / capital * 100, 6) AS roi_pct FROM hit WHERE q >= 0.5"""
)
def q_budget_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.budget_point(*_schedules(spark, sf_dir), _KEYS, _BOOK_SETTINGS.budget, (6, 6, 6))


@query(
    _OUTLAY
    + """, tops AS (SELECT market, max(max_out) AS max_out, least(floor((max(max_out) + 1e-9) / 50), 20)::BIGINT AS rungs FROM ends GROUP BY market),
wanted AS (SELECT market, unnest(range(1, rungs + 1)) AS rung FROM tops WHERE rungs > 0),
hit AS (
  SELECT market, rung, least(rung * 50.0::DOUBLE, max_out) AS capital, q0 + (least(rung * 50.0::DOUBLE, max_out) - out0) / (out1 - out0) * (q1 - q0) AS q
  FROM ends JOIN wanted USING (market) WHERE least(rung * 50.0::DOUBLE, max_out) > out0 AND least(rung * 50.0::DOUBLE, max_out) <= out1
), p AS (SELECT *, round(q - capital, 4) AS p FROM hit),
u AS (SELECT *, coalesce(p > max(p) OVER (PARTITION BY market ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS rises FROM p),
f AS (SELECT *, rung - max(CASE WHEN rises THEN rung END) OVER (PARTITION BY market ORDER BY rung ROWS UNBOUNDED PRECEDING) AS falls FROM u),
e AS (SELECT *, coalesce(max(CASE WHEN falls >= 3 THEN 1 END) OVER (PARTITION BY market ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM f)
SELECT market, rung::INTEGER AS rung, round(rung * 50.0::DOUBLE, 2) AS capital, round(q, 6) AS quantity, round(p, 6) AS guaranteed_profit, round(p / capital * 100, 6) AS roi_pct FROM e WHERE ended = 0"""
)
def q_capital_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.capital_ladder(*_schedules(spark, sf_dir), _KEYS, _BOOK_SETTINGS, 6)


@query(f"WITH {_LEVELS} SELECT market, venue, CASE WHEN outcome = 'yes' THEN 'no' ELSE 'yes' END AS outcome, round(1 - price, 6) AS ask, size FROM levels WHERE round(1 - price, 6) > 0 AND round(1 - price, 6) < 1")
def q_invert_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("outcome") == "yes", "no").otherwise("yes")
    rows = _levels(spark, sf_dir).select("market", "venue", other.alias("outcome"), fees.inverted_price(F.col("price")).alias("ask"), "size")
    return rows.where("ask IS NOT NULL")


@query(
    f"""WITH {_LEVELS}, t AS (
  SELECT market, venue, min(CASE WHEN outcome = 'yes' THEN price END) AS yes_ask, min(CASE WHEN outcome = 'no' THEN price END) AS no_ask,
         coalesce(sum(CASE WHEN outcome = 'yes' THEN size END), 0) AS yes_depth, coalesce(sum(CASE WHEN outcome = 'no' THEN size END), 0) AS no_depth FROM levels GROUP BY ALL
) SELECT *, coalesce(yes_ask + no_ask >= 0.95, true) AS sane FROM t"""
)
def q_book_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books.tops(_levels(spark, sf_dir), ["market", "venue"])
    return rows.withColumn("sane", fees.book_sane(F.col("yes_ask"), F.col("no_ask"), Settings(book_floor=0.95)))


_OPPS = (
    _CURVE
    + """, best AS (SELECT market, greatest(max(guaranteed_profit), 0) AS max_profit FROM points GROUP BY market),
edge AS (SELECT a.market, round(1 - (min(a.price) + min(b.price)), 4) AS gross_edge FROM a JOIN b USING (market) GROUP BY a.market),
y AS (SELECT market, gross_edge, max_profit, CASE WHEN max_profit >= 5 THEN 'actionable' ELSE 'dust' END AS section, round(max_profit / 5000 / 30 * 10000, 9) AS daily_yield_bps FROM best JOIN edge USING (market))"""
)


def _yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = books.optimal_size(_curve(spark, sf_dir), _KEYS)
    a, b = _schedules(spark, sf_dir)
    tops = a.groupBy("market").agg(F.min("price").alias("pa")).join(b.groupBy("market").agg(F.min("price").alias("pb")), "market")
    edge = F.round(1 - (F.col("pa") + F.col("pb")), 4)
    return best.join(tops, "market").select(
        F.col("market").cast("string").alias("pair_key"),
        F.lit("yes").alias("side_a"),
        F.lit("no").alias("side_b"),
        edge.alias("gross_edge"),
        F.col("max_profit").alias("net_profit_1"),
        F.col("max_profit").alias("pnl_at_budget"),
        "max_profit",
        "optimal_capital",
        F.lit(30).cast("long").alias("days_to_resolution"),
        F.round(fees.daily_yield_bps(F.col("max_profit"), F.lit(30)), 9).alias("daily_yield_bps"),
    )


@query(_OPPS + " SELECT market::VARCHAR AS pair_key, section, gross_edge, max_profit, daily_yield_bps FROM y WHERE max_profit > 0")
def q_opportunity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.ranked(_yields(spark, sf_dir)).select("pair_key", "section", "gross_edge", "max_profit", "daily_yield_bps")


@query(_OPPS + " SELECT market::VARCHAR AS pair_key, gross_edge FROM y WHERE max_profit <= 0 AND gross_edge > -0.03 ORDER BY gross_edge DESC, market::VARCHAR LIMIT 5")
def q_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.near_misses(_yields(spark, sf_dir)).select("pair_key", "gross_edge")


# Persistence


@query(
    """
WITH o AS (SELECT c_custkey, c_name, c_mktsegment AS text_hash FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey, c_name || '!' AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS text_hash FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
       CASE WHEN n.c_custkey IS NOT NULL AND (o.c_custkey IS NULL OR o.text_hash IS DISTINCT FROM n.text_hash) THEN n.c_name ELSE o.c_name END AS c_name,
       CASE WHEN n.c_custkey IS NOT NULL AND (o.c_custkey IS NULL OR o.text_hash IS DISTINCT FROM n.text_hash) THEN n.text_hash ELSE o.text_hash END AS text_hash
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
"""
)
def q_upsert_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer")
    old = rows.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("text_hash"))
    hash_ = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("NEW")
    new = rows.where("c_custkey % 3 = 0 OR c_custkey % 5 <> 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), hash_.alias("text_hash"))
    return persist.upsert(old, new, ["c_custkey"], "text_hash", F.lit(None).cast("timestamp"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def q_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return persist.insert_absent(rows.where("s_suppkey % 3 <> 0"), rows, ["s_suppkey"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders")
def q_scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    found = persist.versioned(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return found.select("o_custkey", "o_orderkey", "version", "is_current")


@query(
    """
WITH h AS (SELECT s_suppkey, sha256('supplier:' || s_suppkey::VARCHAR) AS h FROM supplier)
SELECT s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id FROM h
"""
)
def q_point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.identity_hash(F.lit("supplier"), F.col("s_suppkey").cast("string"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", persist.point_id(h).alias("point_id"))


@query(
    """
SELECT o_orderkey::VARCHAR AS pair_key, a.c_name AS title_a, b.n_name AS title_b, o_totalprice AS confidence
FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN nation b ON a.c_nationkey = b.n_nationkey WHERE o_orderstatus = 'O'
"""
)
def q_pairs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlens.plans.spreads import current_pairs

    customers, nations = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    linked = _t(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    pairs = linked.select(
        F.col("o_orderkey").cast("string").alias("pair_key"),
        F.concat(F.lit("c"), "o_custkey").alias("market_a_id"),
        F.concat(F.lit("n"), "c_nationkey").alias("market_b_id"),
        F.col("o_totalprice").alias("confidence"),
        (F.col("o_orderstatus") == "O").alias("is_current"),
        F.lit(True).alias("is_active"),
        F.lit("equivalent").alias("verdict"),
    )
    a = customers.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("a").alias("venue"), F.col("c_custkey").cast("string").alias("venue_market_id"), F.col("c_name").alias("title"))
    b = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("b").alias("venue"), F.col("n_nationkey").cast("string").alias("venue_market_id"), F.col("n_name").alias("title"))
    return current_pairs(pairs, a.union(b)).select("pair_key", "title_a", "title_b", "confidence")


# Latency and reports

_WINDOW_MS = 3_600_000
_LATENCY = f"""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS snap_id, user_id, ts FROM events WHERE event_type = 'view'),
m AS (
  SELECT p.event_id, p.ts AS event_ts, v.ts AS snapshot_ts, v.snap_id, (epoch_us(v.ts) - epoch_us(p.ts)) / 1000.0 AS latency_ms,
         row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts, v.snap_id) AS n
  FROM p JOIN v ON v.ts >= p.ts AND epoch_us(v.ts) - epoch_us(p.ts) <= {_WINDOW_MS}::BIGINT * 1000
), f AS (SELECT event_id, event_ts, snapshot_ts, snap_id, latency_ms::DOUBLE AS latency_ms FROM m WHERE n = 1)
"""


def _first_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events")
    bought = rows.where("event_type = 'purchase'").select("event_id", F.col("ts").alias("event_ts"))
    seen = rows.where("event_type = 'view'").select(F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("snap_id"))
    return latency.first_reactions(bought, seen, _WINDOW_MS, seq=["snap_id"])


@query(_LATENCY + "SELECT * FROM f")
def q_latency_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_views(spark, sf_dir)


@query(
    _LATENCY
    + """, r AS (SELECT * FROM f ORDER BY event_ts DESC, event_id DESC LIMIT 1000), l AS (SELECT count(*) AS count, min(latency_ms) AS min, max(latency_ms) AS max, round(avg(latency_ms), 6) AS mean, list_sort(list(latency_ms)) AS v FROM r)
SELECT count, min, max, mean, v[count // 2 + 1] AS median FROM l"""
)
def q_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.latency_stats(_first_views(spark, sf_dir), ["event_ts", "event_id"]).withColumn("mean", F.round("mean", 6))


@query(
    """
WITH l AS (SELECT event_id, user_id, lag(value) OVER w AS before, value AS after, (event_id % 2500)::DOUBLE AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, abs(after - before) / before AS move FROM l WHERE before > 0 AND after > 0 AND ms <= 2000),
c AS (SELECT *, 0.6 * greatest(0, 1 - ms / 2000) + 0.4 * least(1, move / 0.04) AS conf FROM m)
SELECT event_id, round(move, 6) AS price_move_pct, round(conf, 6) AS confidence, ms < 1000 AS actionable, ms < 1000 AND conf >= 0.7 AS alert FROM c WHERE move >= 0.02 AND conf >= 0.6
"""
)
def q_opportunity_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = _t(spark, sf_dir, "events").withColumn("before", F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    found = latency.detected(rows, F.col("before"), F.col("value"), (F.col("event_id") % 2500).cast("double"))
    return found.select("event_id", F.round("price_move_pct", 6).alias("price_move_pct"), F.round("confidence", 6).alias("confidence"), "actionable", "alert")


@query(
    """
SELECT user_id, count(*) AS n, max(value) AS max_edge, arg_max(ts, (value, -epoch_us(ts), -event_id)) AS max_edge_time, min(value) AS min_edge,
       arg_min(ts, (value, epoch_us(ts), event_id)) AS min_edge_time, round(avg(value), 6) AS avg_edge FROM events GROUP BY user_id
"""
)
def q_series_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.series_stats(_t(spark, sf_dir, "events"), "user_id", "ts", "value", ["ts", "event_id"])
    return found.withColumn("avg_edge", F.round("avg_edge", 6))


@query("SELECT event_id, max(value) OVER w AS max_so_far, min(value) OVER w AS min_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_running_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.running_extremes(_t(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"]).select("event_id", "max_so_far", "min_so_far")


@query("SELECT user_id, v - 250 AS gross_edge, v - 400 AS net_edge, CASE WHEN v > 400 THEN 'ARB' WHEN v > 250 THEN 'EDGE' ELSE '---' END AS status FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id)")
def q_live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") - 250).alias("gross_edge"), (F.col("value") - 400).alias("net_edge"))
    return reports.live_status(rows, "user_id", ["ts", "event_id"])


@query(
    """
WITH p AS (SELECT user_id, bool_or(value > 480) AS arb, max(value - 488) > 0 AS profit, bool_or(value > 485) AS budget FROM events GROUP BY user_id)
SELECT count(*) AS pairs, count_if(arb) AS arb_pairs, count_if(profit) AS profit_pairs, count_if(budget) AS budget_pairs FROM p
"""
)
def q_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = _t(spark, sf_dir, "events").select("user_id", (v - 480).alias("net_edge"), (v - 488).alias("pnl"), (v - 480).alias("pnl_budget"))
    return reports.session_counts(rows, "user_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_group_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grouped_counts(_t(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, count(*) AS n, count_if(value < 50) AS errors, round(sum(value), 4) AS total, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(count(*) / 3600 * 60, 6) AS per_minute FROM events GROUP BY event_type")
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.stage_metrics(_t(spark, sf_dir, "events"), "event_type", "value", F.col("value") < 50, F.lit(3600))
    return found.withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6), "per_minute": F.round("per_minute", 6)})


@query("SELECT user_id, count_if(event_type = 'error') AS errors, count(*) AS calls, count_if(event_type = 'error') / count(*) AS error_rate FROM events GROUP BY user_id")
def q_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_rate(_t(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def q_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.last_n(_t(spark, sf_dir, "events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], 100)


@query(
    """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, CASE WHEN 0.0 = 0 THEN value END AS ema FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN f.ema = 0 THEN e.value ELSE 0.9 * f.ema + 0.1 * e.value END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, round(arg_max(ema, n), 6) AS ema FROM f GROUP BY user_id
"""
)
def q_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latency.moving_averages(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.select("user_id", F.round("ema", 6).alias("ema"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def q_recent_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent(_t(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag AS verdict, count(*) AS n, round(avg(l_discount), 6) AS avg_confidence FROM lineitem GROUP BY l_returnflag")
def q_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("verdict"), F.col("l_discount").alias("confidence"))
    return reports.verdict_summary(rows).withColumn("avg_confidence", F.round("avg_confidence", 6))
