import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import common, exact_dedup, mixing


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    for bits in (8, 20, 64):
        parts = [np.unique(rng.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64), return_counts=True) for n in (0, 1, 7, 200, 900)]
        filters = [exact_dedup.CountingQuotientFilter.build(v, c, bits) for v, c in parts]
        for f, (v, c) in zip(filters, parts):
            got = f.items()
            assert np.array_equal(got[0], v) and np.array_equal(got[1], c)
        values, counts = exact_dedup.merged(filters).items()
        want = {}
        for v, c in parts:
            for x, n in zip(v.tolist(), c.tolist()):
                want[x] = want.get(x, 0) + n
        assert dict(zip(values.tolist(), counts.tolist())) == want and np.all(np.diff(values.astype(float)) >= 0)
    assert exact_dedup.merged([]) is None


def dedup_rows():
    rng = random.Random(1)
    rows = [(i, rng.choice(["a  b", "a b", "a\tb", "A b", "x", f"u{i}", " a b", "é b", "é b"])) for i in range(200)]
    return rows + [(300 + i, "hot text") for i in range(150)] + [(500, None), (501, ""), (502, " "), (503, "\n\t"), (7, "twice"), (7, "twice"), (7, "other"), (600, "z " * 50000), (601, "z\t" * 50000)]


@pytest.mark.parametrize("bits", [64, 5])
def test_exact_dedup_equals_brute_force(spark, bits):
    rows = dedup_rows()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("fp", F.lit(1)).withColumn("norm", F.lit("n"))
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df, bits=bits).collect()) == want
    kept = exact_dedup.drop_copies(df, )
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], norm(r["text"])) for r in kept.collect()) == sorted((min(ids), t) for t, ids in groups.items())


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).collect() == [] and exact_dedup.drop_copies(empty).collect() == []


def brute_targets(sizes):
    """Share by weight, cut at three times the size, share what is cut off again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    limit, total = {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > limit[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: float(limit[s]) for s in over}


def mix_rows():
    rng = random.Random(8)
    sources = ["a"] * 60 + ["b", "B", "é", "src1"] * 5 + [None] * 4 + ["tiny"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), s) for i, s in enumerate(sources)]
    return rows + [(900, None, "b"), (901, "", "empty"), (902, "\t \n", None), (3, "same id again", "a"), (3, "same id again", "a"), (950, "long " * 60000, "b")]


def test_mixing_meets_targets_and_limits(spark):
    rows = mix_rows()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = brute_targets(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("range", F.lit("y"))
    got = mixing.mix(df).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, words(t)) for i, t, _ in rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) for r in own)
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-6) or sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        # At most one row is cut, the others are whole epochs apart by one at most.
        assert sum(r["taken"] % max(1, r["size"]) > 0 for r in own) <= 1
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixed_rows_carry_out_the_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    plan = {}
    for r in mixing.mix(df).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in plan.items() if v}
    empty = df.limit(0)
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_copies_go_and_clashing_columns_stay(spark):
    rows = dedup_rows()
    extra = {"_id": F.lit(1), "_digest": F.lit("d"), "id": F.lit(2), "digest": F.lit(3), "text_sha256": F.lit("x"), "kept": F.lit(False), "other_doc_id": F.lit(4)}
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").withColumns(extra)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    found = out.collect()
    first = {}
    for i, t in rows:
        first[norm(t)] = min(i, first.get(norm(t), i))
    assert sorted(r["doc_id"] for r in found) == sorted(first.values())
    assert {(r["_id"], r["_digest"], r["id"], r["digest"], r["other_doc_id"]) for r in found} == {(1, "d", 2, 3, 4)}


def test_tables_written_on_the_way_are_deleted(spark):
    import os

    paths = []

    def make():
        one = common.saved(spark.range(5), "one")
        inner = common.finished(lambda: common.saved(one, "two").where("id > 1"), "inner")
        paths.extend(os.path.dirname(f.replace("file:", "").replace("//", "/")) for d in (one, inner) for f in d.inputFiles())
        return inner.where("id > 2")

    out = common.finished(make, "out")
    assert out.count() == 2 and paths and not any(map(os.path.exists, paths))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    assert common.shared_dir(spark)
