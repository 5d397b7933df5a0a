"""Quality scores: histogram gradient-boosted trees over document statistics.

Trees are grown over binned features from a bounded sample of labelled rows (SAMPLE_ROWS, those
whose hashed ids come first, in the ratio in which labels occur).  For scoring they are laid out as
flat arrays: every tree is filled up to its full depth, so a batch of rows walks all trees at once,
level by level, without a branch.  Scoring reads whole texts and uses the text alone.

Defined results: a null text counts as empty; an empty text gets the score of its (zero)
statistics; repeated rows score alike; of several labels for a doc_id the highest counts,
null labels none; without labelled rows of both kinds every score is the share of good ones
(0 without any); a very long text is read in blocks of words; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm import trees
from pairlens.llm.common import fresh, saved

#: Labelled rows that the trees are grown from at most.
SAMPLE_ROWS = 24_000
THRESHOLD = 0.3
ROUNDS, DEPTH, RATE = 80, 4, 0.15
#: Words whose repetition is measured together, so that long texts aren't less diverse for being long.
BLOCK = 512

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), string.digits.encode()
_ENDS, _PAUSES = b".!?", b",;:"
_SYMBOLS = bytes(sorted(set(string.punctuation.encode()) - set(_ENDS + _PAUSES + b"'\"-()")))
FEATURES = (
    "words", "word_length", "distinct", "commonest", "repeated", "block_distinct", "least_block", "lines", "line_words", "line_copies",
    "capitals", "shouted", "digits", "symbols", "symbol_kinds", "marked", "pauses", "ends", "sentence_words", "exclaimed", "bars", "short", "foreign",
)


def statistics(text: str) -> list[float]:
    """The document statistics that the trees see, in the order of FEATURES."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    repeated, blocks = 0, []
    last = None
    for at in range(0, len(words), BLOCK):
        block = words[at : at + BLOCK]
        repeated += sum(map(eq, block, islice(block, 1, None))) + (block[0] == last)
        last = block[-1]
        blocks.append(len(set(block)) / len(block))
    lines = [line for line in text.split("\n") if line]
    raw = text.encode("utf-8", "replace")

    def share(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    upper, lower, symbols, ends, pauses = (share(chars) for chars in (_UPPER, _LOWER, _SYMBOLS, _ENDS, _PAUSES))
    plain = [w for w in counts if w[-1:].isalpha()]
    return [
        math.log1p(len(words)),
        size / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        repeated / n,
        sum(blocks) / max(1, len(blocks)),
        min(blocks, default=0.0),
        math.log1p(len(lines)),
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        upper / max(1, upper + lower),
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
        share(_DIGITS) / size,
        symbols / size,
        len(set(raw) & set(_SYMBOLS)),
        1 - len(plain) / max(1, len(counts)),
        pauses / n,
        ends / n,
        math.log1p(n / max(1, ends)),
        text.count("!") / n,
        text.count("|") / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        (len(raw) - len(text)) / size,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Flat:
    """Trees of one depth side by side: node i of tree t stands at t * nodes + i, its children at 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    nodes: int
    depth: int

    @classmethod
    def of(cls, forest: list[trees.Tree], depth: int) -> Flat:
        nodes = 2 ** (depth + 1) - 1
        feature, threshold = np.zeros((len(forest), nodes), np.int64), np.full((len(forest), nodes), np.inf)
        value = np.zeros((len(forest), nodes))
        for t, tree in enumerate(forest):
            value[t, 0] = tree.value[0]
            for i in range(nodes):
                leaf = i and (threshold[t, (i - 1) // 2] == np.inf)
                if leaf:
                    # Below a leaf everything goes left and keeps its value.
                    value[t, i] = value[t, (i - 1) // 2]
                else:
                    value[t, i] = tree.value[i]
                    if tree.feature[i] >= 0:
                        feature[t, i], threshold[t, i] = tree.feature[i], tree.threshold[i]
        return cls(feature.ravel(), threshold.ravel(), value.ravel(), nodes, depth)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The sum over all trees for each row of ``x``."""
        base = np.arange(len(self.feature) // self.nodes) * self.nodes
        at = np.zeros((len(x), len(base)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = base + at
            at = 2 * at + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[base + at].sum(1)


@dataclass
class Model:
    start: float = 0.0
    forest: Flat | None = None
    #: The score of every text, where there is nothing to learn from.
    constant: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.forest is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-(self.start + self.forest(x))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows that aren't held out."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    # At most ``rows`` narrow rows are broadcast.
    sample = docs.select(F.col(id_column).cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                x = matrix(piece.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    # Rows that share a labelled id are in it several times; it is cut to the bound again.
    measured = saved(sample.mapInArrow(measure, "quality int, x array<double>"), "quality-sample").orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(rows).collect()
    x, y = np.array([r["x"] for r in measured]), np.array([r["quality"] for r in measured], float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    start, forest = trees.boosted(x, y, ROUNDS, DEPTH, RATE)
    return Model(start, Flat.of(forest, DEPTH))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", name: str = "quality_score") -> DataFrame:
    """The columns of ``carry`` with the score as ``name``, for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                scores = model.score(matrix(piece.column(piece.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(scores, pa.float64())], names=[*piece.schema.names[:-1], name])

    kept = docs.select(*carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    (text,) = fresh(kept, "text")
    return docs.select(*carry, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias(text)).mapInArrow(run, f"{schema}, `{name}` double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
