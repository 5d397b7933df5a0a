"""Guards around calls to outside services, for ingest jobs and model plug-ins."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from typing import Any


class CircuitOpen(RuntimeError):
    """A call was refused because the service has failed too often."""


class CircuitBreaker:
    """Refuses calls for ``rest_seconds`` after ``failures`` in a row; then ``successes`` in a row close it again."""

    def __init__(self, failures: int = 5, rest_seconds: float = 60.0, successes: int = 2, clock: Callable[[], float] = time.monotonic):
        self.failures, self.rest_seconds, self.successes, self.clock = failures, rest_seconds, successes, clock
        self.state, self._bad, self._good, self._opened = "closed", 0, 0, 0.0

    def call(self, f: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        if self.state == "open":
            if self.clock() - self._opened < self.rest_seconds:
                raise CircuitOpen(f"resting for {self.rest_seconds - (self.clock() - self._opened):.1f} s more")
            self.state, self._good = "half_open", 0
        try:
            result = f(*args, **kwargs)
        except Exception:
            self._bad += 1
            if self.state == "half_open" or self._bad >= self.failures:
                self.state, self._opened = "open", self.clock()
            raise
        self._bad = 0
        if self.state == "half_open":
            self._good += 1
            if self._good >= self.successes:
                self.state = "closed"
        return result


def reconnect_waits(first: float = 5.0, most: float = 300.0, tries: int = 10) -> list[float]:
    """Seconds to wait before each try to reconnect."""
    return [min(first * 2**n, most) for n in range(tries)]


def batch_rows(free_mb: float, row_mb: float, most: int, share: float = 0.6) -> int:
    """Rows of a model batch that fit a share of the free memory: one at least."""
    return max(1, min(most, math.floor(free_mb * share / row_mb))) if row_mb > 0 else most
