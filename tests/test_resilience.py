import pytest

from pairlens.operators.resilience import CircuitBreaker, CircuitOpen, batch_rows, reconnect_waits
from pairlens.plans import matching


def test_circuit_breaker():
    now = [0.0]
    breaker = CircuitBreaker(clock=lambda: now[0])

    def fail():
        raise ValueError("down")

    for _ in range(5):
        assert breaker.state == "closed"
        with pytest.raises(ValueError):
            breaker.call(fail)
    with pytest.raises(CircuitOpen):
        breaker.call(int)
    now[0] = 61.0
    assert breaker.call(int) == 0 and breaker.state == "half_open"
    assert breaker.call(int) == 0 and breaker.state == "closed"
    for _ in range(5):
        with pytest.raises(ValueError):
            breaker.call(fail)
    now[0] = 200.0
    with pytest.raises(ValueError):
        breaker.call(fail)
    assert breaker.state == "open"


def test_waits_and_batches():
    assert reconnect_waits()[:3] == [5.0, 10.0, 20.0] and max(reconnect_waits()) == 300.0 and len(reconnect_waits()) == 10
    assert (batch_rows(1000, 250, 48), batch_rows(10, 250, 48), batch_rows(1e6, 1, 48), batch_rows(5, 0, 7)) == (2, 1, 48, 7)


def test_fallback_only_sees_unsure_rows(spark):
    texts = [("a", "Market Statement:\nToo little here"), ("b", "Market Statement:\nWill Bank of Japan move above 5%\n\nResolution Criteria:\nAccording to Reuters.\n\nEnd Date: 2026-01-01")]
    specs = matching.extracted(spark.createDataFrame(texts, "content_hash string, canonical_text string"))
    assert matching.with_fallback(specs) is specs

    def load():
        return lambda statements: [[{"value": float(len(statements)), "unit": s, "comparison": ">", "is_negated": False, "negation_context": None}] for s in statements]

    rows = {r["content_hash"]: r for r in matching.with_fallback(specs, load).collect()}
    assert rows["a"]["confidence"] == 0.9 and rows["a"]["thresholds"][0]["unit"] == "Too little here"
    assert rows["b"]["thresholds"][0]["value"] == 5.0 and rows["b"]["confidence"] > 0.7
