"""Settings of the matching and spread operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any

#: Texts that mean true.
TRUE = ("true", "1", "yes", "on")


def from_env(name: str, default: Any) -> Any:
    """The environment's value in the type of ``default``; what can't be read as a number gives the default."""
    text = os.environ.get(name)
    if text is None or default is None or isinstance(default, str):
        return default if text is None else text
    if isinstance(default, bool):
        return text.lower() in TRUE
    try:
        return type(default)(text)
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """Thresholds and weights; every field can be overridden, zero included."""

    top_k: int = 20
    least_similarity: float = 0.5
    rerank_keep: int = 10
    least_rerank: float = 0.7
    least_primary: float = 0.35
    entity_tolerance: float = 0.8
    threshold_tolerance: float = 0.01
    date_tolerance_days: int = 1
    equivalent_at: float = 0.9
    not_equivalent_below: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: {"cross_encoder": 0.50, "threshold": 0.20, "entity": 0.15, "date": 0.10, "source": 0.05})
    dedup_ttl_seconds: int = 3600
    book_floor: float = 0.85
    curve_steps: int = 20
    ladder_step: float = 10_000.0
    ladder_rungs: int = 50
    ladder_declines: int = 3
    budget: float = 5_000.0
    least_profit: float = 5.0
    correlation_window_ms: float = 5_000.0

    @classmethod
    def of_environment(cls, prefix: str = "PAIRLENS_") -> Settings:
        """Numbers by variables such as PAIRLENS_TOP_K, the rest as they stand."""
        plain = cls()
        names = [f.name for f in fields(cls) if f.name != "weights"]
        return cls(**{n: from_env(prefix + n.upper(), getattr(plain, n)) for n in names})


#: Entry fee rates by venue (taker), and the two other schedules.
FEE_RATES = {"kalshi": 0.07, "polymarket": 0.0}
MAKER_RATE, INDEX_RATE = 0.0175, 0.035

#: Domains of the string enumerations.
VENUES = ("kalshi", "polymarket", "opinion", "gemini")
EVENT_TYPES = ("created", "updated", "resolved", "closed")
ENTITY_TYPES = ("person", "organization", "location", "other")
COMPARISONS = (">=", "<=", "==", ">", "<")
VERDICTS = ("equivalent", "not_equivalent", "needs_review")
