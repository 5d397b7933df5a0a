"""From current pairs and books to ranked opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.functions import discovery, scores
from pairlens.operators import books


def current_pairs(pairs: DataFrame, markets: DataFrame) -> DataFrame:
    """Current, active, equivalent pairs with both markets, most confident first."""
    a, b = (markets.select(F.col("id").alias(f"market_{s}_id"), F.col("venue").alias(f"venue_{s}"), F.col("venue_market_id").alias(f"vmid_{s}"), F.col("title").alias(f"title_{s}")) for s in "ab")
    live = pairs.where("is_current AND is_active AND verdict = 'equivalent'")
    return live.join(a, "market_a_id").join(b, "market_b_id").orderBy(F.col("confidence").desc(), "pair_key")


def to_price(pairs: DataFrame) -> DataFrame:
    """The distinct markets that the pairs name."""
    sides = [pairs.select(F.col(f"venue_{s}").alias("venue"), F.col(f"vmid_{s}").alias("vmid")) for s in "ab"]
    return sides[0].union(sides[1]).distinct()


def scan(pairs: DataFrame, asks: DataFrame, as_of: Column, esports_only: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Ranked opportunities of ``pairs`` (with outcome_mapping, date_a, date_b) over ask levels."""
    rows = pairs.where(discovery.esports_pair(F.col("title_a"), F.col("title_b"))) if esports_only else pairs
    rows = rows.withColumn("inverted", scores.is_inverted(F.col("outcome_mapping")))
    keep = ["pair_key", "venue_a", "vmid_a", "venue_b", "vmid_b", "inverted", "date_a", "date_b"]
    return books.ranked(books.opportunities(rows.select(*keep), asks, as_of, settings), settings)
