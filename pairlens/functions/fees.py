"""Prices, fees and yields of contracts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.config import FEE_RATES, Settings
from pairlens.functions.text import micros


def entry_fee(contracts: Column, price: Column, rate: Column) -> Column:
    """rate x contracts x price x (1 - price); 0 where any of them is out of its open domain."""
    inside = (contracts > 0) & (price > 0) & (price < 1) & (rate > 0)
    return F.when(inside, rate * contracts * price * (1 - price)).otherwise(0.0)


def fee_rate(venue: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FEE_RATES.items() for x in pair]), venue), F.lit(0.0))


def inverted_price(bid: Column) -> Column:
    """The ask of one outcome from the bid of the other; null outside (0, 1)."""
    ask = F.round(1 - bid, 6)
    return F.when((ask > 0) & (ask < 1), ask)


def inverted_asks(bids: Column) -> Column:
    """Asks in order of price from an array of the other outcome's bids."""
    asks = F.transform(bids, lambda b: F.struct(inverted_price(b["price"]).alias("price"), b["size"].alias("size")))
    return F.array_sort(F.filter(asks, lambda a: a["price"].isNotNull()))


def levels(raw: Column, scale: float = 1.0, descending: bool = False) -> Column:
    """[[price, size], ...] as levels in order of price; prices outside (0, 1) and empty sizes go."""
    parsed = F.transform(raw, lambda e: F.struct((e[0].cast("double") / scale).alias("price"), e[1].cast("double").alias("size")))
    kept = F.array_sort(F.filter(parsed, lambda x: (x["price"] > 0) & (x["price"] < 1) & (x["size"] > 0)))
    return F.reverse(kept) if descending else kept


def book_sane(yes_ask: Column, no_ask: Column, settings: Settings = Settings()) -> Column:
    """Asks of both outcomes add up to a believable sum; unknown passes."""
    return F.coalesce(yes_ask + no_ask >= settings.book_floor, F.lit(True))


def agrees_with_top(ask: Column, top: Column) -> Column:
    return F.coalesce(F.abs(ask - top) <= 0.05, F.lit(True))


def top_depth(volume: Column) -> Column:
    """Assumed size of a top-of-book level."""
    return F.greatest(F.lit(100.0), F.least(volume * 0.01, F.lit(10_000.0)))


def days_to_resolution(date_a: Column, date_b: Column, as_of: Column) -> Column:
    """Whole days to the earlier date, one at least; 365 without a date."""
    first = F.least(date_a, date_b)
    days = F.floor((micros(first) - micros(as_of)) / F.lit(86_400_000_000.0))
    return F.coalesce(F.greatest(days, F.lit(1)), F.lit(365)).cast("long")


def daily_yield_bps(profit: Column, days: Column, settings: Settings = Settings()) -> Column:
    return F.when(profit > 0, profit / settings.budget / days * 10_000).otherwise(0.0)


def annual_roi_pct(profit: Column, days: Column, settings: Settings = Settings()) -> Column:
    return F.when(profit > 0, profit / settings.budget * (365.0 / days) * 100).otherwise(0.0)
