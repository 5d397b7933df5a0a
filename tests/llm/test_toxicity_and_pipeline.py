import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import toxicity, trees

#: Names that stages use inside.
NAMES = ["_toxicity", "toxicity_score", "toxicity", "_text", "_id", "id", "digest", "_digest", "norm", "fp", "h", "keep_id", "kept", "group_size", "node", "rep", "component_id", "size", "key", "taken", "target", "ids", "rank", "start", "length", "offset", "sequence_id", "source_size", "part", "salt", "a", "b"]

INSULTS = ["grobnar", "grobnix", "grobnuff", "vilster", "dreckle"]


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 90))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(random.Random(2), 1200)
    extra = [(2000, None), (2001, ""), (2002, "!!! 123"), (2003, "slim " * 60000), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string").withColumn("toxic", F.lit(9)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2000, None), (None, 1)], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.toxicity(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows, _, _, got = scored
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    apart = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in apart]) >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert not any(r["predicted"] for r in got if r["doc_id"] >= 2000)


def test_held_out_labels_are_never_read(spark, scored):
    rows, docs, labels, got = scored
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs, flipped).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_without_labels_or_rows(spark, scored):
    _, docs, labels, _ = scored
    assert {r["score"] for r in toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_disguised_words_count():
    model = toxicity.Model({"grobnar$": 5.0})
    plain = model.features("a grobnar here")
    for text in ("a gr0bnar here", "a g.r.o.b.n.a.r here", "a grobnaaar here", "a GROBNAR here", "a gro*nar here"):
        assert model.features(text)[3] == plain[3] == 5.0
    assert model.features("a robin here")[3] == 0.0 and len(plain) == toxicity.FEATURES


def test_isotonic_and_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    start, forest = trees.boosted(x[:1500], y[:1500], depth=3)
    margin = start + sum(t(x) for t in forest)
    assert ((margin[1500:] > 0) == y[1500:]).mean() > 0.9
    knots, shares = trees.isotonic(margin, y)
    assert np.all(np.diff(knots) > 0) and np.all(np.diff(shares) > 0) and shares.min() >= 0 and shares.max() <= 1


def test_pipeline_takes_out_what_is_planted(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = corpus(rng, 600)
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, _ in rows]
    clean = [d for d, r in zip(docs, rows) if not r[2] and len(d[1].split()) >= 40]
    exact = [(3000 + k, clean[0][1].replace(" ", "  ", 1), "en", "s1", 1) for k in range(40)]
    near = []
    for k in range(8):
        words = clean[1 + k][1].split() * 4
        docs[clean[1 + k][0]] = (clean[1 + k][0], " ".join(words), "en", "s2", 1)
        words[7] = "changed"
        near.append((4000 + k, " ".join(words), "en", "s0", 1))
    all_ = docs + exact + near + [(5000, None, None, None, None), (5001, "", "en", "s3", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(all_, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns({name: F.lit(k) for k, name in enumerate(NAMES)}), []
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, before, str(tmp_path)).cache()
        if name != "packing":
            assert frame.columns == before.columns
        kept.append([r["doc_id"] for r in frame.select("doc_id").collect()])
    toxic = {i for i, _, y in rows if y}
    innocent = {i for i, _, y in rows if not y}
    assert len(toxic & set(kept[0])) <= 0.05 * len(toxic) and len(innocent - set(kept[0])) <= 0.01 * len(innocent)
    assert not {d[0] for d in exact} & set(kept[1]) and clean[0][0] in kept[1]
    assert len({d[0] for d in near} & set(kept[2])) <= 1 and innocent & set(kept[1]) == innocent & set(kept[2])
    words = lambda f: f.agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0]
    assert kept[3] and kept[4]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns[:2] == ["doc_id", "start"] and packed.count() > 0
