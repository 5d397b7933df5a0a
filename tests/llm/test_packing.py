import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlens.llm import packing


def reference(text):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(2)
    words = ["the", "Étude", "q1w2", "<|endoftext|>", "東京", "🙂", "\n\n", "  ", "supercalifragilistic"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 300, 900, 2500])))) for i in range(120)]
    rows += [(200 + i, "same text here") for i in range(60)] + [(500, None), (501, ""), (502, "a" * 30000), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("salt", F.lit("x")).withColumn("length", F.lit("y"))
    got = packing.pack(df).collect()

    want = sorted((i, tuple(reference(t))) for i, t in rows)
    parts = {}
    for r in got:
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    for i, ids in set(want):
        copies = sum(w == (i, ids) for w in want)
        pieces = sorted(parts[i, len(ids)])
        assert sum(len(p) for _, p in pieces) == copies * sum(len(w[1]) for w in set(want) if w[0] == i and len(w[1]) == len(ids)) or copies > 1
        assert all(ids[s : s + len(p)] == p for s, p in pieces)
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)

    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 1024
    assert sum(1024 - u for u in used.values()) <= 0.05 * sum(used.values())


def test_shortest_pack_first_places_every_length():
    rng = random.Random(4)
    for size in (8, 64, 1024):
        histogram = {n: rng.randrange(1, 500) for n in rng.sample(range(1, size + 1), min(size, 60))}
        plan = packing.shortest_pack_first(histogram, size)
        placed = {}
        for pattern, count in plan:
            assert sum(pattern) <= size
            for n in pattern:
                placed[n] = placed.get(n, 0) + count
        assert placed == histogram
        assert len(plan) <= 3 * len(histogram)


def test_crc_matches_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = packing.pack(df).select("*", F.crc32("ids").alias("c")).collect()[0]
    assert row["c"] == zlib.crc32(np.array(reference("hello world"), "<u4").tobytes())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_read_added_tokens_as_the_json_file_does(spark, tmp_path):
    from pairlens.llm import catalogue

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "x<|endoftext|><|endoftext|>y", 4: "<|endoftext |>", 5: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in catalogue.op1_packing(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))
