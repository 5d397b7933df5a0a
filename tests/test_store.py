import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from pairlens.operators import persist, store
from pairlens.operators.store import KeyedTable

T0 = datetime.datetime(2026, 3, 1)
SCHEMA = "id string, venue string, vmid string, title string, text_hash string, created_at timestamp, updated_at timestamp"
NEW = "id string, venue string, vmid string, title string, text_hash string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["venue", "vmid"], 8)


def batch(spark, seed, n=40):
    return spark.createDataFrame([(f"{seed}-{i}", "k" if i % 2 else None, f"m{i % 31}", f"T{seed}", f"h{i * seed % 3}") for i in range(n)], NEW).dropDuplicates(["venue", "vmid"])


def rows(frame):
    return sorted(map(repr, frame.collect()))


def test_upserts_equal_the_plain_merge(spark, table):
    now, plain = F.lit(T0), spark.createDataFrame([], SCHEMA)
    for seed in (1, 2, 5):
        new = batch(spark, seed)
        assert table.upsert(new, "text_hash", now) == table.version()["number"]
        plain = spark.createDataFrame(persist.upsert(plain, new, ["venue", "vmid"], "text_hash", now).collect(), SCHEMA)
        assert rows(table.read()) == rows(plain)
    assert table.read(1).count() == batch(spark, 1).count() and set(table.version()["buckets"]) <= {str(i) for i in range(8)}


def test_a_repeated_batch_changes_nothing(spark, table):
    step = store.upsert_step(table, "q", "text_hash", lambda: F.lit(T0))
    step(batch(spark, 1), 0)
    first = table.version()
    step(batch(spark, 2), 0)
    assert table.version() == first
    # Without an id: equal hashes rewrite no bucket.
    assert table.upsert(batch(spark, 1), "text_hash", F.current_timestamp()) == first["number"]
    step(batch(spark, 1), 1)
    assert table.version()["buckets"] == first["buckets"] and table.version()["batches"] == {"q": 1}


def test_only_touched_buckets_are_written_anew(spark, table):
    table.upsert(batch(spark, 1), "text_hash", F.lit(T0))
    before = table.version()["buckets"]
    table.upsert(spark.createDataFrame([("z", "k", "m1", "changed", "other")], NEW), "text_hash", F.lit(T0))
    after = table.version()["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert [r["title"] for r in table.read().where("vmid = 'm1' AND venue = 'k'").collect()] == ["changed"]


def test_a_killed_write_leaves_the_version_before(spark, table, monkeypatch):
    table.upsert(batch(spark, 1), "text_hash", F.lit(T0))
    was = rows(table.read())
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda self, version: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.upsert(batch(spark, 2), "text_hash", F.lit(T0))
    assert rows(table.read()) == was
    # A writer that died over its list holds its number; it counts as dead after a while.
    fs, place = table._place("versions", "2.json")
    fs.create(place).close()
    assert rows(table.read()) == was and table.version()["number"] == 1
    monkeypatch.setattr(store, "GRACE_SECONDS", 0.0)
    assert table.upsert(batch(spark, 2), "text_hash", F.lit(T0)) == 3 and rows(table.read()) != was
    table.clean()
    assert table._numbers() == [3] and table.read().count() > 0
    fs, place = table._place("rows")
    assert {f.getPath().getName() for f in fs.listStatus(place)} == set(table.version()["buckets"].values())


def test_two_writers_lose_nothing(spark, table):
    parts = [spark.createDataFrame([(f"{k}-{i}", "k", f"{k}-{i}", "T", "h") for i in range(20)], NEW) for k in range(3)]
    threads = [threading.Thread(target=table.upsert, args=(p, "text_hash", F.lit(T0))) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    assert table.read().count() == 60 and table.version()["number"] == 3


def test_absent_rows_and_versions(spark, tmp_path):
    specs = KeyedTable(spark, str(tmp_path / "specs"), "a long, b string, v string", ["a", "b"], 4)
    specs.insert_absent(spark.createDataFrame([(1, None, "x"), (1, None, "w"), (2, "q", "y")], "a int, b string, v string"))
    specs.insert_absent(spark.createDataFrame([(1, None, "z"), (3, "q", "new")], "a int, b string, v string"))
    assert {tuple(r) for r in specs.read().collect()} == {(1, None, "w"), (2, "q", "y"), (3, "q", "new")}
    pairs = KeyedTable(spark, str(tmp_path / "pairs"), "pair_key string, seq long, verdict string, version int, is_current boolean", ["pair_key"], 4)
    for batch_ in ([("p", 1, "a"), ("p", 2, "b")], [("p", 3, "c"), ("q", 1, "a"), ("p", 2, "b")]):
        pairs.add_versions(spark.createDataFrame(batch_, "pair_key string, seq int, verdict string"), ["seq"])
    assert sorted((r["pair_key"], r["seq"], r["version"], r["is_current"]) for r in pairs.read().collect()) == [("p", 1, 1, False), ("p", 2, 2, False), ("p", 3, 3, True), ("q", 1, 1, True)]


def test_empty_tables_and_versions(spark, table):
    assert table.read().count() == 0 and table.upsert(batch(spark, 1).limit(0), "text_hash", F.lit(T0)) == 0
    with pytest.raises(ValueError, match="no version"):
        table.read(7)
    table.clean()
    table.upsert(batch(spark, 1), "text_hash", F.lit(T0), batch=("q", 3))
    fs, place = table._place("versions", "1.json")
    stream = fs.open(place)
    assert json.loads(bytes(stream.readAllBytes()).decode())["batches"] == {"q": 3}
    stream.close()
