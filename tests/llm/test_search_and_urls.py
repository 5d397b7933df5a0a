import random

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import topk, url_filter


def brute_top(rows, k):
    vectors = []
    for i, v in rows:
        if v is not None and not any(x is None or not np.isfinite(x) for x in v):
            vectors.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = []
    for at, (i, q) in enumerate(vectors):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(vectors) if other != at and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in (base[i % 6] + 0.1 * rng.normal(size=12)) / 4]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2100, [0.0] * 12), (2200, []), (5, rows[7][1]), (6, rows[6][1])]
    rows += [(100, [0.9] * 12), (100, [1.0] * 12), (101, [1.0] * 12), (101, [0.5] * 12)]  # rows that share an id
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 200 * 12 * 8)
    monkeypatch.setattr(topk, "QUERY_BYTES", 4 * 12 * 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("row", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows, 10)


def test_bounds_leave_few_candidates_to_resolve():
    rng = np.random.default_rng(3)
    for width, noise in ((64, 1.0), (16, 1.0), (64, 0.3)):
        centres = rng.normal(size=(20, width))
        x = (centres[rng.integers(0, 20, 4000)] if noise < 1 else 0) + noise * rng.normal(size=(4000, width))
        v = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
        lists = topk.SortedLists(np.arange(4000), np.arange(4000), v)
        for i in range(0, 4000, 200):
            ids, scores = lists.top(i, v[i], 10)
            every = v @ v[i]
            every[i] = -(2**62)
            assert np.array_equal(ids, np.lexsort((np.arange(4000), -every))[:10]) and np.array_equal(scores, every[ids])
        assert lists.resolved <= 20 * 4000 // 32 + 20 * 10


def test_top_k_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, -1.0]), (100, [0.0, 0.0])], schema)
    got = sorted(tuple(r) for r in topk.top_k(few, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top([(0, [1.0, 0.5]), (1, [0.25, -1.0]), (100, [0.0, 0.0])], 10)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        cut = min([i for i in (tail.find(c) for c in "?#") if i >= 0] or [len(tail)])
        path = tail[:cut]
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or ("",), (len(h + p), len(h), h + p, verdict)) if best else (len(h + p), len(h), h + p, verdict)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "xexample.net", "EXAMPLE.com", "b.example.com", "org", "w.org", "borg", "É.org", "net.", "", "u:p@c.net:80"]
    paths = ["", "/", "/en/", "/en", "/en/x?y#z", "/de/1", "/fr/", "?q=/en/", "#/fr/", "//en/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c.net/", "http://net/\nen/", "x" * 5000 + "://net/" + "y" * 50000]
    rows = [(i // 2, u) for i, u in enumerate(urls + urls[:20])] + [(None, "http://net/"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    for rules in (url_filter.RULES, url_filter.RULES + (("net", "/", "allow"), ("c", "/ab", "block"), ("b.c", "/", "allow"), ("org", "", "block")), ()):
        listed = url_filter.rules_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
        got = sorted(map(repr, (tuple(r) for r in url_filter.judge(df, listed).collect())))
        assert got == sorted(repr((i, *brute_verdict(u, rules))) for i, u in rows)


def test_url_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.col("id").alias("row"), F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    words, blocks = url_filter.bloom_filter(keys, 3000)
    assert url_filter.possible_hits(keys, words, blocks).count() == 3000
    others = spark.range(3000, 23000).select(F.col("id").alias("row"), F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    assert url_filter.possible_hits(others, words, blocks).count() < 1000
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.rules_table(spark)).collect() == []


def test_a_list_of_a_million_entries(spark):
    host = F.concat(F.lit("h"), "id", F.when(F.col("id") % 3 == 0, ".co.uk").otherwise(".com"))
    rules = spark.range(1_000_000).select(host.alias("host"), F.concat(F.lit("/"), F.expr("repeat('p', CAST(id % 40 AS INT))")).alias("path"), F.lit("block").alias("verdict"))
    urls = [(i, f"http://www.h{i}.{'co.uk' if i % 3 == 0 else 'com'}/{'p' * (i % 40 - (i % 5 == 0))}x") for i in range(1, 1000, 7)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {i: "allow" if i % 5 == 0 and i % 40 else "block" for i, _ in urls}
