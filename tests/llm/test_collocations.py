import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, longest, top, share):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, ws), a in f.items():
        if len(ws) == 1 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        found[lang, ws] = (a, f[lang, ws[:k]], f[lang, ws[k:]], score)
    dropped = set()
    for lang, ws in found:
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if 100 * f[lang, ws] >= share * f[lang, ws[i : i + k]]:
                    dropped.add((lang, ws[i : i + k]))
    rows = []
    for lang in n:
        own = sorted(((-s, -a, " ".join(ws).encode(), l, r) for (o, ws), (a, l, r, s) in found.items() if o == lang and (o, ws) not in dropped))
        rows += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(own[:top])]
    return sorted(rows)


def made(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "A", "Ä", "ß", "日本", "x-y", "it's", "a\x00b", "\x1f", " ", "q q", *map(str, range(30))]
    fixed = ["new york city", "a a", "to be or not", "日本 b", "x-y it's a"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 60))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "!", ", "]) for p in parts)
        docs.append((rng.choice(["en", "de", None, "EN"]), rng.choice([text, text.upper()]) if rng.random() < 0.9 else None))
    return docs + docs[:9] + [("en", ""), ("fr", ". ! "), ("es", "a a a a a a a a a a a a a a a")]


@pytest.mark.parametrize(("seed", "least", "longest", "top", "cell_bits"), [(1, 3, 4, 2000, 20), (2, 5, 4, 7, 15), (3, 1, 3, 50, 16), (4, 300, 2, 9, 16), (5, 4, 5, 30, 25)])
def test_equals_counting_all(spark, seed, least, longest, top, cell_bits):
    docs = made(seed, 150)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocations(frame, least, longest, top, 80, cell_bits, 400)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, least, longest, top, 80)


def test_other_columns_long_texts_and_empty_tables(spark):
    docs = [("en", "far away land " * 60_000), ("en", "away " * 40)]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumns({"phrase": F.lit(1), "words": F.lit(2), "f": F.lit(None).cast("int")})
    assert sorted(tuple(r) for r in collocations.collocations(frame).collect()) == plain(docs, 30, 4, 2000, 80)
    assert collocations.collocations(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(frame, least=0)


def test_bounds_never_fall_below_counts():
    shard = collocations.Shard("en", False)
    shard.add([t for _, t in made(7, 80) if t])
    shard.close()
    for n, places in enumerate(shard.candidates([], 3), 1):
        phrases, counts = np.unique(shard.prints(places, n), return_counts=True)
        bits = np.zeros(collocations.SKETCH_ROWS << 13, np.uint8)
        for cells in collocations.cells_of(shard.prints(places, n), 16):
            bits |= np.packbits(np.bincount(cells, minlength=len(bits) * 8) >= 5, bitorder="little")
        assert collocations.Sketch(bits, 16).reaches(phrases)[counts >= 5].all()


def test_hashes_know_words_wherever_they_stand(monkeypatch):
    texts = [t for _, t in made(11, 60) if t]
    raw = collocations.normal("\n".join(texts))
    words = [w for piece in raw.split(b"\n") for w in [*piece.split(b" "), b"\n"] if w][:-1]
    whole = collocations.hashed(raw, 9)
    assert len(whole) == len(words) and [h == 0 for h in whole] == [w == b"\n" for w in words]
    assert len(set(zip(words, whole.tolist()))) == len(set(words)) == len(set(whole.tolist()))
    for stretch in (1, 7, 100):
        monkeypatch.setattr(collocations, "STRETCH", stretch)
        assert np.array_equal(collocations.hashed(raw, 9), whole)
    spelled = collocations.Shard("en", True)
    spelled.add(texts)
    spelled.close()
    plain_ = collocations.Shard("en", False)
    plain_.add(texts)
    plain_.close()
    assert np.array_equal(spelled.hashes, plain_.hashes) and spelled.words == plain_.words


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "", 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    got = collocations.judged(spark.createDataFrame(rows, "lang string, phrase string, words int, f long"), 5, 80).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big - 2, big, big - 1, big, 2_000_000 * (big - 2) // (2 * big - 1))]
