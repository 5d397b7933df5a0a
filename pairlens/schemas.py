"""Schemas of the logical tables, and checks that set rows outside their domain aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.config import COMPARISONS, ENTITY_TYPES, EVENT_TYPES, VENUES, VERDICTS

OUTCOME = "struct<outcome_id:string,label:string>"
ENTITY = "struct<name:string,entity_type:string,aliases:array<string>>"
THRESHOLD = "struct<value:double,unit:string,comparison:string,is_negated:boolean,negation_context:string>"
DATE_SPEC = "struct<date:timestamp,timezone:string,is_deadline:boolean>"
LEVEL = "struct<price:double,size:double>"

MARKET_EVENT = f"venue string, venue_market_id string, event_type string, title string, description string, resolution_criteria string, end_date timestamp, outcomes array<{OUTCOME}>, raw_payload string, received_at timestamp"
CANONICAL_EVENT = f"{MARKET_EVENT}, canonical_text string, content_hash string, identity_hash string, created_at timestamp"
CONTRACT_SPEC = f"statement string, resolution_date {DATE_SPEC}, event_date {DATE_SPEC}, entities array<{ENTITY}>, thresholds array<{THRESHOLD}>, resolution_criteria string, data_source string, outcome_labels array<string>, confidence double, extraction_notes string, evidence_spans map<string,array<struct<start:int,end:int>>>"
VERIFIED_PAIR = "pair_key string, market_a_id string, market_b_id string, outcome_mapping map<string,string>, verdict string, confidence double, comparison_details string, verified_at timestamp"
MARKETS = "id string, venue string, venue_market_id string, title string, canonical_text string, text_hash string, description string, end_date timestamp, created_at timestamp, updated_at timestamp"
EQUIVALENT_PAIR = "pair_key string, venue_a string, vmid_a string, title_a string, venue_b string, vmid_b string, title_b string, outcome_mapping map<string,string>, confidence double, verdict string"
VENUE_BOOK = f"venue string, venue_market_id string, yes_asks array<{LEVEL}>, yes_bids array<{LEVEL}>, no_asks array<{LEVEL}>, no_bids array<{LEVEL}>, source string, resolution_date timestamp, fetched_at timestamp"
BOOK_LEVEL = "venue string, vmid string, outcome string, side string, price double, size double"
GAME_EVENT = "event_type string, event_timestamp timestamp, ingestion_timestamp timestamp, source string, match_id string, event_data string"
BOOK_SNAPSHOT = "ts timestamp, venue string, market_id string, yes_price double, no_price double"
LATENCY_SAMPLE = "event_ts timestamp, odds_update_ts timestamp, latency_ms double, venue string, event_type string, market_id string"

_SLACK = 1e-6

#: Column checks by name; a missing value passes where the field is optional.
CHECKS: dict[str, object] = {
    "venue": lambda c: c.isin(*VENUES),
    "event_type": lambda c: c.isin(*EVENT_TYPES),
    "entity_type": lambda c: c.isin(*ENTITY_TYPES),
    "comparison": lambda c: c.isin(*COMPARISONS),
    "verdict": lambda c: c.isin(*VERDICTS),
    "confidence": lambda c: c.between(0.0, 1.0),
    "similarity_score": lambda c: c.between(-_SLACK, 1 + _SLACK),
}


def clamped(score: Column) -> Column:
    """A score within rounding slack of [0, 1], cut to it; null beyond."""
    return F.when(score.between(-_SLACK, 1 + _SLACK), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def quarantined(rows: DataFrame, checks: dict[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the checks of their columns, and the others with the names of those that failed."""
    used = {k: v for k, v in (checks or CHECKS).items() if k in rows.columns}
    failed = F.filter(F.array(*[F.when(F.col(k).isNotNull() & ~v(F.col(k)), k) for k, v in used.items()]) if used else F.array().cast("array<string>"), lambda k: k.isNotNull())
    marked = rows.withColumn("failed_checks", failed)
    return marked.where(F.size("failed_checks") == 0).drop("failed_checks"), marked.where(F.size("failed_checks") > 0)
