"""Work that may not grow faster than the input: calls to state, parses of a message, rows of a task."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.operators import rerank, retrieve
from pairlens.streaming import live, pairs


class Calls:
    """A state handle that counts what would be messages to the JVM."""

    def __init__(self):
        self.count, self.kept = 0, {}

    def _state(self, name):
        return State(self, name)

    getMapState = getListState = getValueState = lambda self, name, *schema: self._state(name)


class State:
    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def _held(self, kind=dict):
        self.calls.count += 1
        return self.calls.kept.setdefault(self.name, kind())

    def exists(self):
        return bool(self._held())

    def get(self):
        return iter(held) if isinstance(held := self._held(list), list) else held

    def put(self, rows):
        self.calls.count += 1
        self.calls.kept[self.name] = list(rows)

    update = put

    def clear(self):
        self.calls.count += 1
        self.calls.kept.pop(self.name, None)

    def containsKey(self, key):
        return key in self._held()

    def updateValue(self, key, value):
        self._held()[key] = value

    def removeKey(self, key):
        del self._held()[key]

    def iterator(self):
        return iter(list(self._held().items()))


def test_a_books_calls_to_state_do_not_grow_with_its_changes():
    used = []
    for n in (10, 400):
        calls, book = Calls(), live.BookState()
        book.init(calls)
        rows = pd.DataFrame({"seq": range(n), "snapshot": [-1] * n, "outcome": ["yes", "no"] * (n // 2), "price": [(1 + k % 90) / 100 for k in range(n)], "size": [float(k % 3) for k in range(n)]})
        out = pd.concat(book.handleInputRows(("v", "m"), iter([rows]), None))
        assert len(out) and set(out["seq"]) == {n - 1}
        used.append(calls.count)
    assert used[0] == used[1]


def test_a_delta_message_is_parsed_once(spark):
    messages = spark.createDataFrame([(1, '{"type":"orderbook_delta","msg":{"market_ticker":"M","yes":[[40,3]]}}'), (2, "not json")], "seq long, payload string").repartition(2)
    levels = live.delta_levels(messages)
    plan = levels._jdf.queryExecution().optimizedPlan().toString()
    # The message, and the two lists in it.
    assert plan.count("get_json_object") == 0 and plan.count("from_json") == 3
    assert [tuple(r) for r in levels.collect()] == [("kalshi", "M", 1, -1, "yes", 0.4, 3.0)]


def test_odd_delta_messages(spark):
    delta = '{"type":"orderbook_delta","msg":%s}'
    odd = ['{"type":"orderbook\\u005fdelta","msg":{"market_ticker":"U","no":[[30,3]]}}', delta % '{"market_ticker":7,"yes":"[[40,1]]","no":null}', delta % '{"market_ticker":"","yes":[[1,1]]}', delta % '{"market_ticker":"B","yes":[[1,1]]', delta % "null", "[" + delta % '{"market_ticker":"A","yes":[[1,1]]}' + "]", "", None, '{"type":"ticker"}']
    rows = spark.createDataFrame(list(enumerate(odd)), "seq long, payload string")
    assert sorted((r["seq"], r["vmid"], r["outcome"], r["price"]) for r in live.delta_levels(rows).collect()) == [(0, "U", "no", 0.3), (1, "7", "yes", 0.4)]


def test_more_rows_are_more_tasks_and_ranks_need_no_further_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 50 AS q", "id % 7 AS cand", "id % 3 AS clause", "id % 11 / 10 AS confidence", "id AS most")
    tasks = rerank.dealt(rows, "q", 20)
    assert tasks.rdd.getNumPartitions() == 50 and rerank.dealt(rows, "q").rdd.getNumPartitions() == 4
    scored = rerank.best_match_mean(tasks, ["q", "cand"], "clause", "confidence", ("most",)).withColumn("score", F.col("secondary") + F.lit(1.0))
    best = rerank.kept(scored, "q", tie=("cand",))
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert best.agg(F.max("most")).first()[0] == 999


def test_rows_below_a_querys_last_score_are_left_out_and_the_rest_is_exact():
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.normal(size=(150, 8)), 2, axis=0)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    table = pa.table({"id": np.arange(300), "venue": pa.array(["ab"[i % 3 == 0] for i in range(300)]), "v": pa.array(list(vectors), pa.list_(pa.float64()))})
    scores = np.round(unit @ unit.T, 6)
    for last in (None, 0.5, -np.inf):
        for k in (1, 5, 400):
            left = table if last is None else table.append_column("last", pa.array(np.full(300, last)))
            got = list(zip(*retrieve.best_of(left, table, k, 0.3).to_pydict().values()))
            want = []
            for q in range(300):
                open_ = [c for c in range(300) if (c % 3 == 0) != (q % 3 == 0) and scores[q, c] >= max(0.3, last or -1.0)]
                want += [(q, c, scores[q, c]) for c in sorted(open_, key=lambda c: (-scores[q, c], c))[:k]]
            assert got == want


def test_all_intervals_of_a_pair_leave_as_one_frame():
    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 10_000)

    calls, watched = Calls(), pairs.PairBooks(1_000, event_time=True)
    watched.init(calls)
    calls.kept["waiting"] = [(side, k * 1_000_000 + 5, k, -1, "yes", 0.4 + k / 100, 5.0) for k in range(4) for side in "ab"]
    frames = list(watched.handleExpiredTimer(("p",), Times, None))
    assert len(frames) == 1 and list(frames[0].columns) == [c.split()[0] for c in pairs.LEVEL.split(", ")]
    assert frames[0].groupby("interval_ms").size().to_dict() == {1_000: 2, 2_000: 4, 3_000: 6, 4_000: 8}
