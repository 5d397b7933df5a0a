import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairlens.llm import simhash
from pairlens.llm.components import connected_components, local_components, spanning_forest


def brute_fingerprint(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    groups = {f: min(i for i, g in zip(ids, prints) if g == f) for f in set(prints)}
    parent = {f: f for f in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in groups:
        for b in groups:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                parent[root(a)] = root(b)
    smallest = {}
    for f, i in groups.items():
        smallest[root(f)] = min(i, smallest.get(root(f), i))
    return {(i, smallest[root(f)]) for i, f in zip(ids, prints)}


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(50)] + ["Été", "ÀB", "X\u00a0Y"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 60, 200]))))
    return out


def test_fingerprints_and_components_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 150))) + [(900, None), (901, ""), (902, " \t\n"), (903, "A\tb\x0bC"), (904, "a b c"), (5, "twice"), (950, "z " * 40000), (951, "z " * 40001)]
    monkeypatch.setattr(simhash, "LEAF_ROWS", 8)
    monkeypatch.setattr(simhash, "FAN", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id").collect()
    prints = [brute_fingerprint(t, 3) for _, t in rows]
    assert sorted((r[0], r[1]) for r in got) == sorted((i, f"{f:016x}") for (i, _), f in zip(rows, prints))
    assert {(r[0], r[2]) for r in got} == brute_components([i for i, _ in rows], prints, 2)


def test_links_of_dense_fingerprints_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    monkeypatch.setattr(simhash, "FAN", 3)
    for radius in (1, 2, 4):
        base = rng.integers(0, 2**63, 12, dtype=np.uint64)
        prints = {int(b) for b in base}
        for _ in range(300):
            p = int(rng.choice(sorted(prints)))
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                p ^= 1 << int(bit)
            prints.add(p)
        signed = [p - 2**64 if p >= 2**63 else p for p in prints]
        df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
        got = {tuple(r) for r in simhash.components_of(df, radius).select("doc_id", "component_id").collect()}
        assert got == brute_components(range(len(signed)), signed, radius)


def test_close_pairs_equal_brute_force():
    rng = np.random.default_rng(4)

    def leaf(n):
        prints = np.unique(rng.integers(0, 2**12, n, dtype=np.uint64))
        return prints[np.argsort(simhash.gray_rank(prints))]

    for n, m in ((1, 1), (2, 40), (5, 3), (17, 17), (300, 90)):
        one, two = leaf(n), leaf(m)
        a, b = simhash.close_pairs(one, None, 2)
        want = {(i, j) for i in range(len(one)) for j in range(i + 1, len(one)) if bin(int(one[i]) ^ int(one[j])).count("1") <= 2}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
        a, b = simhash.close_pairs(one, two, 2)
        want = {(i, j) for i in range(len(one)) for j in range(len(two)) if bin(int(one[i]) ^ int(two[j])).count("1") <= 2}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_the_index_descends_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    monkeypatch.setattr(simhash, "FAN", 4)
    rng = np.random.default_rng(9)
    # Groups of prints a few bits apart, far from the other groups.
    prints = np.unique([int(b) ^ (1 << int(rng.integers(0, 8))) ^ (1 << int(rng.integers(0, 8))) for b in rng.integers(0, 2**62, 40, dtype=np.uint64) for _ in range(20)]).astype(np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    leaves, count = simhash.index_leaves(df)
    rows = sorted(leaves.collect(), key=lambda r: r["leaf"])
    ranks = [x for r in rows for x in simhash.gray_rank(np.frombuffer(r["prints"], np.uint64)).tolist()]
    assert [r["leaf"] for r in rows] == list(range(count)) and ranks == sorted(set(ranks)) and len(ranks) == len(prints)
    pairs = [tuple(r) for r in simhash.close_leaves(leaves, count, 2).collect()]
    # The whole result comes from these pairs of leaves, and most pairs are pruned.
    assert len(pairs) == len(set(pairs)) < count * (count + 1) // 4
    home = {int(p): r["leaf"] for r in rows for p in np.frombuffer(r["prints"], np.uint64)}
    close = {tuple(sorted((home[int(p)], home[int(q)]))) for p in prints for q in prints if bin(int(p) ^ int(q)).count("1") <= 2}
    assert close <= set(pairs)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["rep"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 61 + 60 + 2 and len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 160)}) == 1
    assert len(set(got.values())) == 3
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert local_components(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(31)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, near, distinct = [], [], []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 600]))]
        rows.append((10 * k, " ".join(words)))
        distinct.append(10 * k)
        for j in range(1, 3):
            # A changed word takes five shingles of each side: the similarity stays above 0.85.
            copy = list(words)
            for _ in range(max(1, len(words) // 120)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((10 * k + j, " ".join(copy)))
            near.append(10 * k + j)
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit(1)).withColumn("fp", F.lit(2)).withColumns({"_id": F.lit(7), "_text": F.lit("x"), "h": F.lit(1), "id": F.lit(3), "other": F.lit(4), "node": F.lit(5), "first": F.lit(6)})
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    found = kept.collect()
    assert {(r["_h"], r["_id"], r["_text"], r["id"], r["other"], r["node"], r["first"]) for r in found} == {(1, 7, "x", 3, 4, 5, 6)}
    ids = [r["doc_id"] for r in found]
    assert set(distinct) <= set(ids) and len(set(near) & set(ids)) <= 0.1 * len(near)
    assert 5000 in ids and 5001 not in ids and 5002 in ids and 5003 not in ids
    assert simhash.drop_near_copies(df.limit(0)).collect() == []


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n, m = int(rng.integers(2, 20)), int(rng.integers(0, 60))
        a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        got = spanning_forest(n, a, b, w)
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        total = edges = 0
        for i in np.argsort(w, kind="stable"):
            x, y = root(a[i]), root(b[i])
            if x != y:
                parent[x], total, edges = y, total + w[i], edges + 1
        assert w[got].sum() == total and len(got) == edges
        assert len(set(local_components(n, a[got], b[got]).tolist())) == n - edges


def test_documents_that_share_a_frequent_line_stay(spark):
    rng = random.Random(8)
    line = " ".join(f"l{i}" for i in range(9))
    rows = [(i, " ".join([line] * 40 + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for i in range(6)]
    rows += [(10 + i, " ".join(["same"] * 60 + [f"own{rng.randrange(10**9)}" for _ in range(40)])) for i in range(6)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _ in rows]

def blocks_replaced(rng, n, share):
    """Pairs of texts of 400 words, the second with one block replaced."""
    out = []
    for k in range(n):
        words = [f"w{rng.randrange(20000)}" for _ in range(400)]
        copy, at = list(words), rng.randrange(400 - share)
        copy[at : at + share] = [f"x{rng.randrange(20000)}" for _ in range(share)]
        out += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return out


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_copies_with_a_replaced_block_go(spark):
    for share in (20, 38):
        rows = blocks_replaced(random.Random(share), 150, share)
        assert all(0.8 <= jaccard(rows[i][1], rows[i + 1][1]) < 0.91 for i in range(0, len(rows), 2))
        kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r["doc_id"] for r in kept) == list(range(0, len(rows), 2))


@pytest.mark.parametrize("small", [False, True])
def test_every_link_of_a_near_threshold_group_counts(spark, monkeypatch, small):
    if small:
        # Nearly all cells are cut into blocks, and neighbours aren't joined before.
        monkeypatch.setattr(simhash, "PAIR_NODES", 2)
        monkeypatch.setattr(simhash, "BLOCK_NODES", 4)
        monkeypatch.setattr(simhash, "CHAIN_ROUNDS", 0)
    rng = random.Random(21)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(20000)}" for _ in range(300)]
        for _ in range(14):
            # Two pieces replaced: pairs of copies lie around 0.8, some above and most below.
            copy = list(words)
            for at in (rng.randrange(280), rng.randrange(280)):
                copy[at : at + 5] = [f"x{rng.randrange(20000)}" for _ in range(5)]
            rows.append((len(rows), " ".join(copy)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if i // 14 == j // 14 and jaccard(rows[i][1], rows[j][1]) >= 0.8]
    label = local_components(len(rows), *(np.array(x) for x in zip(*links)))
    assert 20 < len(set(label.tolist())) < len(rows) - 20
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label.tolist()))


def test_fingerprints_in_the_index_give_the_stage_its_first_candidates(spark, monkeypatch):
    def unlike(hashes, factors, masks):
        return np.random.default_rng(int(hashes.sum())).integers(0, 2**64, len(factors), np.uint64)

    # No two sets share a band: what goes, goes by its fingerprint.
    monkeypatch.setattr(simhash, "least_hashes", unlike)
    rng = random.Random(17)
    rows, near = [], []
    for k in range(40):
        words = [f"w{rng.randrange(20000)}" for _ in range(800)]
        copy = list(words)
        copy[rng.randrange(800)] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        one, two = (simhash.majority_bits(np.unique(simhash.shingle_hashes(t.encode(), 5))) for _, t in rows[-2:])
        near += [2 * k + 1] if (one ^ two).bit_count() <= simhash.RADIUS else []
    assert 20 < len(near)
    # One text close to the fingerprint of none, and a repeated line that decides no set's fingerprint.
    line = " ".join(f"l{i}" for i in range(9))
    rows += [(100 + i, " ".join([line] * 40 + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for i in range(6)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _ in rows if i not in near]
