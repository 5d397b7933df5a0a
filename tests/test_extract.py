import random
import re

import extract_model
import pytest
from pyspark.sql import functions as F

from pairlens.functions import extract, text
from pairlens.operators import entities
from pairlens.schemas import ENTITY

CASES = [
    ("Will BTC be above $100k by June?", [(100_000.0, "dollars", ">", False)]),
    ("Price of at least $1,250.50", [(1250.5, "dollars", ">=", False)]),
    ("a budget of less than $5M", [(5_000_000.0, "dollars", ">=", True)]),
    ("Will turnout reach 50%?", [(50.0, "percentage", ">=", False), (50.0, "numeric", ">=", False)]),
    ("Lakers score over 110.5 points", [(110.5, "point", ">=", False)]),
    ("total exceeds 2026", []),
    ("at most 12 losses", [(12.0, "losse", "<=", False)]),
    ("not to exceed $3", [(3.0, "dollars", ">=", True)]),
    ("rate >= 3%", [(3.0, "percentage", ">", False)]),
    ("less than 5 goals", [(5.0, "goal", ">=", False)]),
    ("T1 to take 3 games winner", []),
    ("no numbers here", []),
    ("$, and , %", []),
]


@pytest.mark.parametrize("sentence, want", CASES)
def test_thresholds(sentence, want):
    assert [(t["value"], t["unit"], t["comparison"], t["is_negated"]) for t in extract_model.thresholds_of(sentence)] == want


def test_negation_keeps_its_context():
    found = extract_model.thresholds_of("It shall not exceed $7 today")[0]
    assert found["is_negated"] and found["negation_context"] == "It shall not exceed $7 today"


def test_names():
    names = lambda t, **k: [(e["name"], e["entity_type"]) for e in extract_model.names_of(t, **k)]
    assert names("when Kansas City Chiefs meet Bank of America") == [("Kansas City Chiefs", "person"), ("Bank of America", "person")]
    assert names("when Kansas City Chiefs meet Bank of America", narrow=True) == [("Bank of America", "person")]
    assert ("Lakers", "other") in names("Lakers vs Celtics tonight") and ("Celtics", "other") in names("Lakers vs Celtics tonight")
    assert names("nothing to see") == []


def test_text_columns(spark):
    c = text.canonical_text(F.lit("T"), F.lit("The first rule applies. 2. Second rule holds; ok"), F.lit(""), F.lit(None).cast("timestamp"), F.array(F.lit("A"), F.lit("B")))
    row = spark.range(1).select(
        c.alias("c"),
        text.parse_statement(c).alias("s"),
        text.secondary_clauses(text.parse_criteria(c)).alias("k"),
        text.parse_outcomes(c).alias("o"),
        text.parse_end_date(c).alias("e"),
        text.event_date(c).alias("d"),
        text.parse_statement(F.lit("plain line\nmore")).alias("p"),
        text.truncated(F.lit("abcdefgh"), 6).alias("t"),
        text.listed(F.lit("B, a ,b,, A")).alias("l"),
        extract.data_source(F.lit("per the official results"), F.lit("x")).alias("src"),
        extract.data_source(F.lit("Resolved by Acme Data, at noon"), F.lit("")).alias("cited"),
        extract.data_source(F.lit("the NBA says; coinbase"), F.lit("")).alias("first"),
        extract.data_source(F.lit(""), F.lit(None).cast("string")).alias("none"),
    ).first()
    assert row["c"] == "Market Statement:\nT\n\nResolution Criteria:\nThe first rule applies. 2. Second rule holds; ok"
    assert row["s"] == "T" and row["k"] == ["The first rule applies", "Second rule holds"] or row["k"][0] == "The first rule applies"
    assert row["o"] == ["Yes", "No"] and row["e"] is None and row["d"] is None and row["p"] == "plain line"
    assert row["t"] == "abc..." and row["l"] == ["b", "a"]
    assert (row["src"], row["cited"], row["first"], row["none"]) == ("official results", "Acme Data", "Coinbase", None)


def model_normalise(t):
    lines = [x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    kept = [x for i, x in enumerate(lines) if x or i == 0 or lines[i - 1]]
    return re.sub(r"\n+$", "", "\n".join(kept))


def test_normalise_text(spark):
    texts = ["", "a", " a  \r\nb\t\rc", "\n\n\nx", "x\n\n\n\ny\n\n", "a \nb \n \n　\nc", "\n", "a\n \n \nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.normalise_text(F.col("t"))).collect()]
    assert got == [model_normalise(t) for t in texts]
    again = spark.createDataFrame([(t,) for t in got], "t string").select(text.normalise_text(F.col("t"))).collect()
    assert [r[0] for r in again] == got


def test_extracted_specs_once_per_text(spark):
    from pairlens.plans.matching import extracted

    t = "Market Statement:\nWill Bitcoin close above $100k?\n\nResolution Criteria:\nAccording to Coinbase prices.\n\nEnd Date: 2026-12-31"
    df = spark.createDataFrame([("h", t), ("h", t), ("g", "short")], "content_hash string, canonical_text string")
    rows = {r["content_hash"]: r for r in extracted(df).collect()}
    assert len(rows) == 2
    assert rows["h"]["data_source"] == "Coinbase" and rows["h"]["thresholds"][0]["value"] == 100_000.0
    assert str(rows["h"]["resolution_date"]) == "2026-12-31 00:00:00" and rows["h"]["event_date"] is None
    assert rows["g"]["failed_fields"] == ["statement", "resolution_date", "entities", "thresholds", "data_source"]


def test_entities_of_a_model_with_labels(spark):
    def load():
        return lambda texts: [[("Paris", "GPE"), ("Monday", "DATE"), ("Paris", "PERSON"), ("ACME", "ORG")] for _ in texts]

    rows = spark.createDataFrame([("Paris and ACME on Monday",), ("short",), (None,)], "t string")
    got = [[(e["name"], e["entity_type"]) for e in r["e"]] for r in rows.select(extract.model_entities(F.col("t"), extract.labelling(load)).alias("e")).collect()]
    assert got == [[("Paris", "location"), ("ACME", "organization")], [], []]


def test_spellings_of_names(spark):
    names = {"LA Lakers": "Los Angeles Lakers", "ny jets": "New York Jets", "jets": "Winnipeg Jets", "sixers": "Philadelphia 76ers", "SCOTUS": "Supreme Court", "someone": "someone", "st louis cardinals": "St. Louis Cardinals"}
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    assert {r["n"]: r["c"] for r in rows.select("n", entities.canonical_name(F.col("n")).alias("c")).collect()} == {**names, None: None}
    pair = spark.createDataFrame([([("BTC", "other", None)], [("my coin", "other", None)])], f"a array<{ENTITY}>, b array<{ENTITY}>")
    own = entities.entity_score(F.col("a"), F.col("b"), {"My Coin": ("btc",)})
    assert tuple(pair.select(own.alias("x")).first()["x"]) == (1.0, 1, 0)


def _texts(rng, n):
    words = "above below at least at most exactly > < >= <= not exceed unless it is above except when no more than less than reach hits exceeding game Game games map winner Winner result points Points goals degrees wins bps basis points".split(" ")
    numbers = ["$5", "$1,250.50", "$100k", "$2M", "50%", "1,000.5%", "3", "12.5", "1999", "2026", "1,999", "7k", "4m", ",", "$,", "%", "3.", "1,2,3", "110.5 points", "3 games", "2 map", "5 wins", "20 bps"]
    names = ["Kansas City Chiefs", "Bank of America", "Lakers vs Celtics", "Ana-Maria von Berg", "John Smith Jr.", "New  York Mets", "The Market Statement", "Éric Dupont", "A vs. B, ok", "x versus Y Z", "Trading", "McDonald Corp", "Ünal Öz vs Real Madrid."]
    blanks = [" ", " ", " ", "  ", "\t", "\n", "\u00a0", ", ", ". "]
    return ["".join(rng.choice(rng.choice([words, words, numbers, names])) + rng.choice(blanks) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_columns_equal_the_rules_text_by_text(spark):
    rng = random.Random(3)
    texts = [*(c[0] for c in CASES), *_texts(rng, 400), "", None, "It shall not exceed $7 today", "日本 $5 日本 above 7 日本"]
    df = spark.createDataFrame([(i, t, rng.choice([None, "", "at least 4 goals"])) for i, t in enumerate(texts)], "i int, s string, c string")
    columns = {"t": extract.thresholds(F.col("s"), F.col("c")), "n": extract.regex_entities(F.col("s"), F.col("c")), "w": extract.regex_entities(F.col("s"), F.col("c"), True)}
    found = df.withColumns(columns)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    many = 0
    for r in found.collect():
        text_ = f"{r['s'] or ''} {r['c'] or ''}"
        as_dicts = lambda rows: [x.asDict() for x in rows]
        assert as_dicts(r["t"]) == extract_model.thresholds_of(text_), text_
        assert as_dicts(r["n"]) == extract_model.names_of(text_), text_
        assert as_dicts(r["w"]) == extract_model.names_of(text_, True), text_
        many += len(r["t"]) + len(r["n"])
    assert many > 2000
