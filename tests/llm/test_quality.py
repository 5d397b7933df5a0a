import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import quality, trees


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        good = int(rng.random() < 0.8)
        if not good:
            kind = rng.randrange(4)
            if kind == 0:
                words = [f"{w.upper()}!!" for w in words]
            elif kind == 1:
                words = [w + rng.choice(["***", "$$$", "%%%", "&&&"]) for w in words]
            elif kind == 2:
                words = [w for w in words[:20] for _ in range(9)]
            else:
                words = " | ".join(words).split(" ")
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + ".", good))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(random.Random(4), 1500)
    extra = [(3000, None), (3001, ""), (3002, " \n\n "), (3003, "lang " * 200_000), (5, rows[5][1]), (None, "ein Text")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string").withColumns({"quality": F.lit(9), "score": F.lit("x"), "_text": F.lit(1), "quality_score": F.lit(2)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3000, None), (None, 1)], "doc_id long, quality int")
    return rows, docs, labels, quality.quality(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows, _, _, got = scored
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    apart = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in apart]) >= 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3000, 3001)}) == 1


def test_held_out_labels_are_never_read(spark, scored):
    _, docs, labels, got = scored
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(repr, quality.quality(docs, flipped).collect())) == sorted(map(repr, got))


def test_without_labels_or_rows(spark, scored):
    _, docs, labels, _ = scored
    assert {r["score"] for r in quality.quality(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    ones = labels.where("quality = 1")
    assert {r["score"] for r in quality.quality(docs.limit(5), ones).collect()} == {1.0}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_sample_is_bounded(spark, scored):
    _, docs, labels, _ = scored
    model = quality.fit(docs, labels, rows=40)
    assert model.forest is None or model.forest.depth == quality.DEPTH


def test_flat_arrays_walk_like_the_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    start, forest = trees.boosted(x, y, 20, 4, 0.2)
    flat = quality.Flat.of(forest, 4)
    assert np.allclose(flat(x), sum(t(x) for t in forest)) and ((start + flat(x) > 0) == y).mean() > 0.95
    # A tree that is one leaf.
    assert np.allclose(quality.Flat.of([trees.Tree(np.full(31, -1), np.zeros(31), np.append(2.5, np.zeros(30)))], 4)(x), 2.5)


def test_statistics_by_hand():
    named = dict(zip(quality.FEATURES, quality.statistics("Ein EIN Wort Wort, |\nEin EIN Wort Wort, |")))
    assert named["repeated"] == pytest.approx(0) and named["line_copies"] == 0.5 and named["bars"] == 0.2
    assert named["shouted"] == 0.2 and named["distinct"] == 0.5 and named["pauses"] == 0.2
    assert quality.statistics("a a a a")[quality.FEATURES.index("repeated")] == 0.75
    long_ = quality.statistics("wort " * 3000)
    assert long_[quality.FEATURES.index("repeated")] == pytest.approx(2999 / 3000) and len(long_) == len(quality.FEATURES)
    assert np.isfinite(quality.statistics("")).all()
