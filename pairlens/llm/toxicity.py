"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

A bounded sample of labelled rows (SAMPLE_ROWS of each label) is split three ways by hash:
one part teaches a lexicon (words and beginnings of words with their log odds), one fits
the trees, one the calibration.  Scoring reads whole texts, one row at a time, and uses
the text alone.

Defined results: a null text counts as empty; an empty text gets the score of its (zero)
features; repeated rows score alike; of several labels for a doc_id the highest counts,
null labels none; without labelled rows of both kinds every score is the share of toxic
ones (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm import trees
from pairlens.llm.common import fresh, saved

#: Labelled rows of each kind that are used at most: those whose hashed ids come first.
SAMPLE_ROWS = {1: 6_000, 0: 9_000}
#: A bound on the size of the learned lexicon, which every worker holds: beyond it the entries with
#: the highest scores stay.  It doesn't bind on any table at hand: without it 129 entries are learned
#: at scale 0.1 and 244 on 0.5 GB, as LEAST_DOCS and LEAST_SCORE decide.
LEXICON_ENTRIES = 4_000
LEAST_DOCS, LEAST_SCORE = 4, 2.6
#: Lengths of the beginnings of words that count as entries.
STEMS = range(3, 9)
THRESHOLD = 0.7
FEATURES = 16

#: Second-person pronouns.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._-]+[^\W\d_]+)+")
_MASK = re.compile(r"[0-9@$!|*._-]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_HINT = re.compile(r"[0-9@$!|*._-][^\W\d_]")
_CAPITALS, _PUNCTUATION = string.ascii_uppercase.encode(), string.punctuation.encode()
_CACHE = 200_000
_NEAR = 3


def entries_of(word: str) -> list[str]:
    """What the lexicon may hold for a word: its beginnings, and itself with an end mark."""
    return [*(word[:n] for n in STEMS if n < len(word)), f"{word}$"]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    forest: list[trees.Tree] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def __post_init__(self) -> None:
        self.cache: dict[str, tuple] = {}
        self.heads = {entry[: STEMS[0]] for entry in self.lexicon}
        by_length: dict[int, list[str]] = {}
        for entry in self.lexicon:
            if entry.endswith("$"):
                by_length.setdefault(len(entry) - 1, []).append(entry[:-1])
        self.by_length = by_length

    def weight(self, word: str) -> float:
        if word[: STEMS[0]] not in self.heads:
            return 0.0
        return max((self.lexicon.get(e, 0.0) for e in entries_of(word)), default=0.0)

    def known(self, word: str) -> tuple[float, bool] | tuple[()]:
        """(weight, drawn out or not) of a word; empty for the many words that are neither."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            long_ = bool(_LONG.search(word))
            weight = max(self.weight(word), self.weight(_LONG.sub(r"\1", word)) if long_ else 0.0)
            found = self.cache[word] = (weight, long_) if weight or long_ else ()
        return found

    def hidden(self, token: str) -> float:
        """The weight of a word written with marks among its letters."""
        plain, bare = token.translate(LEET), _MASK.sub("", token)
        found = max(self.weight(_MASK.sub("", plain)), self.weight(bare))
        if not found and "*" in token:
            like = re.compile(re.escape(token).replace(r"\*", "."))
            found = max((self.lexicon[f"{w}$"] for w in self.by_length.get(len(token), ()) if like.fullmatch(w)), default=0.0)
        return found

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = _WORD.findall(lower)
        n, size = max(1, len(words)), max(1, len(text))
        special = {w: found for w in set(words) if (found := self.known(w))}
        hits = [i for i, w in enumerate(words) if w in special and special[w][0]] if special else []
        second = sum(map(SECOND_PERSON.__contains__, words))
        near = 0
        if hits and second:
            near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - _NEAR) : i + _NEAR + 1]) for i in hits)
        tokens = _HIDDEN.findall(lower) if _HINT.search(lower) else []
        hidden = [w for w in map(self.hidden, tokens) if w]
        strength = [special[words[i]][0] for i in hits] + hidden
        raw = text.encode("utf-8", "replace")
        return [
            math.log1p(len(words)),
            len(strength) / n,
            sum(strength) / n,
            max(strength, default=0.0),
            math.log1p(len(strength)),
            math.log1p(len({words[i] for i in hits})),
            near / max(1, len(hits)),
            second / n,
            (len(raw) - len(raw.translate(None, _CAPITALS))) / size,
            (len(raw) - len(raw.translate(None, b"0123456789"))) / size,
            text.count("!") / n,
            text.count("?") / n,
            (len(raw) - len(raw.translate(None, _PUNCTUATION))) / size,
            len(tokens) / n,
            math.log1p(len(hidden)),
            sum(special[w][1] for w in words if w in special) / n if special else 0.0,
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.features(t) for t in texts], float).reshape(-1, FEATURES)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((t(x) for t in self.forest), np.full(len(x), self.start))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), self.knots, self.shares), 0.0, 1.0)


def learned_lexicon(sample: DataFrame, rows: dict[int, int], entries: int = LEXICON_ENTRIES) -> dict[str, float]:
    """Entries that toxic rows use more than others, by a cautious log odds ratio.

    ``sample`` (text, toxic): counted on the executors, one entry a partition and word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entry in {e for w in set(_WORD.findall((text or "").lower())) if len(w) >= STEMS[0] for e in entries_of(w)}:
                    found.setdefault(entry, [0, 0])[toxic] += 1
            # Handed on in parts, so that memory stays bounded.
            if len(found) > 2_000_000:
                yield _counted(found)
                found = {}
        yield _counted(found)

    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    ones, zeros = F.col("ones"), F.col("zeros")
    odds = F.log((ones + 0.5) / (n1 + 1)) - F.log((zeros + 0.5) / (n0 + 1)) - F.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    found = (
        sample.select("text", F.col("toxic").cast("int"))
        .mapInArrow(count, "entry string, ones long, zeros long")
        .groupBy("entry")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .where(ones >= LEAST_DOCS)
        .select("entry", odds.alias("score"))
        .where(F.col("score") >= LEAST_SCORE)
        .orderBy(F.col("score").desc(), "entry")
        .limit(entries)
    )
    return {r["entry"]: r["score"] for r in found.collect()}


def _counted(found: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (1, 0))], names=["entry", "ones", "zeros"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lexicon_entries: int = LEXICON_ENTRIES) -> Model:
    """A model from the labelled rows that aren't held out; ``lexicon_entries`` bounds what it knows by heart."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    parts = [known.where(F.col("toxic") == kind).orderBy("h", "doc_id").limit(n) for kind, n in SAMPLE_ROWS.items()]
    chosen = parts[0].union(parts[1])
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    # At most the sum of SAMPLE_ROWS narrow rows are broadcast.
    sample = docs.select(F.col(id_column).cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    sample = saved(sample.select("text", "toxic", F.pmod(F.xxhash64("h"), F.lit(10)).alias("part")), "toxicity-sample")
    counts = sample.groupBy("toxic", (F.col("part") < 6).alias("first")).count().collect()
    total = {k: sum(r["count"] for r in counts if r["toxic"] == k) for k in (0, 1)}
    rows = {r["toxic"]: r["count"] for r in counts if r["first"]}
    if not total[0] or not total[1]:
        return Model(shares=np.array([1.0 if total[1] else 0.0]))
    model = Model(learned_lexicon(sample.where("part < 6"), rows, lexicon_entries))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                x = model.matrix(piece.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    # The sample's features: the sum of SAMPLE_ROWS rows of FEATURES doubles at most.
    measured = sample.select("text", "toxic", "part").mapInArrow(measure, "toxic int, part long, x array<double>").collect()
    measured.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in measured])
    y, part = np.array([r["toxic"] for r in measured], float), np.array([r["part"] for r in measured])
    # The lexicon knows its own part by heart: with few rows elsewhere all of them must do.
    fitting = part >= 6 if min((y[part >= 6] == k).sum() for k in (0, 1)) >= 40 else part >= 0
    calibrating = fitting & (part >= 8) if min((y[part >= 8] == k).sum() for k in (0, 1)) >= 40 else fitting
    boosting = fitting & ~calibrating if calibrating.sum() < fitting.sum() else fitting
    model.start, model.forest = trees.boosted(x[boosting], y[boosting])
    model.knots, model.shares = trees.isotonic(model.margin(x[calibrating]), y[calibrating])
    return model


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", name: str = "toxicity") -> DataFrame:
    """The columns of ``carry`` with the score as ``name``, for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                scores = model.score(model.matrix([t or "" for t in piece.column(piece.num_columns - 1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(scores)], names=[*piece.schema.names[:-1], name])

    kept = docs.select(*carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    (own,) = fresh(kept, "text")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias(own)
    return docs.select(*carry, text).mapInArrow(run, f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= threshold, 1).otherwise(0).alias("predicted"),
    )
