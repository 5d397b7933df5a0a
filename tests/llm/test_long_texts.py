import random
import time

import regex

from pairlens.llm import license_scan, secret_scan

NOTICE = "licensed under the gnu affero general public license version 3"


def test_a_text_of_many_lines_holds_no_copy_of_itself_in_each(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("ab bc cd de ef fg".split()) for _ in range(12)) for _ in range(50_000)]
    at = [5, 20_000, 49_999]
    for k in at:
        lines[k] = NOTICE
    # Four million characters: each line's own copy would be 200 GB.
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, NOTICE), (3, "\n" * 50_000 + NOTICE)], "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]) for r in license_scan.scan(docs).where("family = 'agpl'").collect()}
    assert got == {*((1, k) for k in at), (2, 0), (3, 50_000)}


def test_windows_grow_with_the_lines(spark):
    # Every line may start a notice, none is confirmed alone.
    def taken(n):
        docs = spark.createDataFrame([(1, "\n".join(["licensed under the gnu affero"] * n))], "doc_id long, text string")
        began = time.monotonic()
        assert license_scan.paragraphs(docs).count() == n
        return time.monotonic() - began

    taken(100)
    short, long_ = taken(4_000), taken(32_000)
    # Squared it would be 64 times.
    assert long_ < 24 * max(short, 0.3)


def plain_candidates(text):
    lists = [[(m.start(), m.end()) for m in regex.finditer(p, text)] for p in (secret_scan.ASSIGNED, secret_scan.IN_URL, secret_scan.RUN)]
    found = []
    for spans in lists:
        found += [s for s in spans if not any(a < s[1] and s[0] < b for a, b in found)]
    return sorted(found)


def test_candidates_equal_a_plain_model(spark):
    rng = random.Random(4)
    parts = ["token = abcdef123456", "password: 'p4ssword'", "https://user:s3cret@host.net/x", "postgres://a:token=abcdefgh1234567890@db", "0123456789abcdef0123", "api_key=ABCDEFGHIJKLMNOP1234", "ä", "日本", "pwd=x", "secret:", "a_b-c.d/e+f=9aaaaaaaaaaaaa", "://", ":@", "word", "\n", "9" * 40]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "\n", ";", "="]) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (7, rows[8][1]), (7, rows[7][1])]
    got = {}
    for r in secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    want = {}
    for i, text in rows:
        want.setdefault(i, []).extend(plain_candidates(text or ""))
    assert sum(map(len, want.values())) > 500
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_a_text_of_a_hundred_thousand_candidates(spark):
    text = "token = abcdefgh1234\nhttps://user:s3cret99@host.net/x\n0123456789abcdef0123\n" * 34_000
    found = secret_scan.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    began = time.monotonic()
    assert found.count() == 3 * 34_000
    # All against all took 45 s for 16,000 of them.
    assert time.monotonic() - began < 150
