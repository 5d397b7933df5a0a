"""Which events and pairs a discovery strategy takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.text import keyword_match

# Words that mark esports.
COMMON_WORDS = r"esport|esports|gaming|video\s+game|league\s+of\s+legends|lol|dota|valorant|csgo|counter[-\s]?strike|overwatch|fortnite|apex|call\s+of\s+duty|cod|rainbow\s+six|r6|rocket\s+league|fifa"
EVENT_WORDS = COMMON_WORDS + r"|nba\s+2k|madden|tournament|championship|pro\s+player|streamer|streaming"
PAIR_WORDS = COMMON_WORDS + (
    r"|cs2|counter\s+strike\s+2|cs\s+2|map\s+\d+|game\s+\d+|match\s+\d+|win\s+map|win\s+game|win\s+match|pgl|esl|blast|epicenter|challengers|academy|rolster|t1|"
    r"loud|furia|mongolz|mouz|team\s+vitality|team\s+falcons|natus\s+vincere|navi|giantx|karmine|corp"
)


def _words(text: Column, words: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b(?:{words})\b")


def _text(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def polymarket_esports(title: Column, description: Column, payload: Column, categories: tuple[str, ...] = ("esports",)) -> Column:
    """The first category field holds a configured category, or a word of the title or description does."""
    found = F.coalesce(*[F.when(F.get_json_object(payload, f"$.{c}") != "", F.get_json_object(payload, f"$.{c}")) for c in ("category", "categories", "category_slug")])
    by_category = F.lit(False)
    for c in categories:
        by_category = by_category | F.coalesce(F.lower(found).contains(c.lower()), F.lit(False))
    return by_category | _words(_text(title, description), EVENT_WORDS)


def kalshi_keywords(title: Column, description: Column, ticker: Column, keywords: tuple[str, ...]) -> Column:
    return keyword_match(_text(title, description, ticker), keywords)


def esports_pair(title_a: Column, title_b: Column) -> Column:
    return _words(_text(title_a, title_b), PAIR_WORDS)


def mentions(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.lower(text).contains(p))


#: Strategy name to a condition on the columns of market events.
STRATEGIES: dict[str, Callable[[], Column]] = {
    "normal": lambda: F.lit(True),
    "esports": lambda: F.when(F.col("venue") == "polymarket", polymarket_esports(F.col("title"), F.col("description"), F.col("raw_payload")))
    .when(F.col("venue") == "kalshi", kalshi_keywords(F.col("title"), F.col("description"), F.col("venue_market_id"), ("ESPORTS", "LOL", "CSGO", "CS2", "DOTA", "VALORANT")))
    .otherwise(F.lit(False)),
}


def accepts(strategy: str) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy]()


def match_search(text: Column, *needed: tuple[str, ...]) -> Column:
    """Every group of spellings has one in the text, such as both teams and the game; null texts hold none."""
    found = F.lit(True)
    for spellings in needed:
        found = found & mentions(F.coalesce(text, F.lit("")), spellings)
    return found
