"""Phrases whose words belong together, mined per language.

Two passes over the texts fill count-min sketches, first with single words and pairs, then with
the longer word sequences whose pairs may be frequent.  A sketch's counters never fall below
the true count, so what stays under the least count in any row is no candidate; what is left
of a sketch is a bit a cell, of a size that a parameter fixes.  In the third pass each shard of texts
compiles its candidates into an Aho-Corasick automaton whose patterns begin and end with a
delimiter, and counts overlapping matches; counts are summed over shards, and only then the
thresholds apply, exactly.  However full a sketch is, results stay the same: it only prunes less.

Defined results: a null text counts as empty, a null language as ``und``; words in no piece count
nowhere; copies count as often as they occur; phrases tie by text in byte order; texts
of any length are read whole (a text forms part of one shard); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.common import UPPER, partitions, saved

LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Cells of a row of a sketch, as a power of two, and its rows: two sketches of 8 MB as bits.
CELL_BITS, SKETCH_ROWS = 25, 2
#: Cells whose counters travel together.
BLOCK_BITS = 15
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 22
#: Words that a shard holds at least before it is worked off, all languages together.
SHARD_WORDS = 1_000_000
#: Parts that a language's phrases are ranked in before their best are ranked together.
RANK_PARTS = 32

#: What ends a piece, as one byte; what parts words, as a blank.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(UPPER.encode() + _ENDS + b"\t", UPPER.lower().encode() + b"\n" * len(_ENDS) + b" ")
#: A byte that UTF-8 doesn't use stands for the end of a piece; its id is 0.
_END = b"\xff"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Sketch:
    """The cells of a count-min sketch that reach the least count, a bit each, row behind row."""

    bits: np.ndarray
    cell_bits: int

    def reaches(self, prints: np.ndarray) -> np.ndarray:
        """Whether the upper bound of each fingerprint's count reaches the least count."""
        found = np.ones(len(prints), bool)
        for cells in cells_of(prints, self.cell_bits):
            found &= (self.bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
        return found


def cells_of(prints: np.ndarray, cell_bits: int) -> list[np.ndarray]:
    """The cell of each fingerprint in each row."""
    return [((_scrambled(prints + np.uint64(r) * _PRIME) >> np.uint64(64 - cell_bits)) + np.uint64(r << cell_bits)).astype(np.int64) for r in range(SKETCH_ROWS)]


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.bases = [np.uint64(base), np.uint64(pow(base, -1, 1 << 64))]
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            self.tables = [np.cumprod(np.append(np.uint64(1), np.full(n + n // 4, base))) for base in self.bases]
        return [t[:n] for t in self.tables]


_POWERS = Powers()


def normal(text: str) -> bytes:
    """``text`` in lower case with line feeds for what ends a piece and blanks for what parts words."""
    return text.encode("utf-8", "replace").translate(_TABLE)


def hashed(raw: bytes, seed: int) -> np.ndarray:
    """A hash of each word of a normal text and 0 for each end of a piece, in order.

    A word's hash is a polynomial in its bytes, as a difference of running sums; long texts are read in stretches.
    """
    out, at = [], 0
    while at < len(raw):
        stop = at + STRETCH
        if stop < len(raw):
            # Stretches end between words.
            cut = max(raw.rfind(b" ", at, stop), raw.rfind(b"\n", at, stop)) + 1
            if cut <= at:
                cut = min([len(raw), *(x + 1 for x in (raw.find(b" ", stop), raw.find(b"\n", stop)) if x >= 0)])
            stop = cut
        data = np.frombuffer(raw, np.uint8, min(stop, len(raw)) - at, at)
        at = stop
        power, inverse = _POWERS.upto(len(data) + 1)
        end = data == 10
        gap = end | (data == 32)
        begins = ~gap & np.append(True, gap[:-1])
        first = np.flatnonzero(begins)
        last = np.flatnonzero(~gap & np.append(gap[1:], True)) + 1
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1]))
        words = _scrambled((sums[last] - sums[first]) * inverse[first] + np.uint64(seed)) | np.uint64(1)
        marks = np.flatnonzero(begins | end)
        found = np.zeros(len(marks), np.uint64)
        found[begins[marks]] = words
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Shard:
    """Texts of one language as hashes of their words; 0 ends a piece.  ``spelled`` shards know the words as well."""

    def __init__(self, lang: str, spelled: bool):
        self.lang, self.seed, self.spelled = lang, xxhash.xxh64_intdigest(lang.encode()), spelled
        self.vocabulary: dict[bytes, int] = defaultdict(int, {_END: 0})
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts: list[np.ndarray] = []
        self.texts: list[str] = []
        self.words = 0

    def add(self, texts: list[str]) -> None:
        raw = normal("\n".join(texts)) + b"\n"
        if self.spelled:
            tokens = raw.replace(b"\n", b" " + _END + b" ").split()
            part = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens))
            self.texts.append(f" {b' '.join(tokens).replace(_END, b'\n').decode()} ")
        else:
            part = hashed(raw, self.seed)
        self.parts.append(part)
        self.words += int(np.count_nonzero(part))

    def close(self) -> None:
        whole = np.concatenate(self.parts)
        self.parts = []
        if self.spelled:
            self.ids, self.names = whole, list(self.vocabulary)
            self.name_hashes = np.append(np.uint64(0), hashed(b" ".join(self.names[1:]), self.seed))
            self.hashes = self.name_hashes[whole]
        else:
            self.hashes = whole
        self.inside = self.hashes > 0

    def prints(self, places: np.ndarray, length: int) -> np.ndarray:
        """A fingerprint of the ``length`` words from each place on."""
        h = np.full(len(places), length, np.uint64)
        for k in range(length):
            h = _scrambled(h * _PRIME + self.hashes[places + k])
        return h

    def candidates(self, sketches: list[Sketch], longest: int) -> list[np.ndarray]:
        """By length, the places from which 1 to ``longest`` words of a piece may be frequent, as far as the sketches tell.

        Sketch k bounds lengths 2k + 1 and 2k + 2; what it can't bound rests on the longest parts that it can.
        """
        found, fits = [], self.inside
        for length in range(1, longest + 1):
            if length > 1:
                # Both parts without the last and without the first word.
                fits = fits[:-1] & fits[1:]
            if (length - 1) // 2 < len(sketches):
                at = np.flatnonzero(fits)
                kept = sketches[(length - 1) // 2].reaches(self.prints(at, length))
                fits = np.zeros(len(fits), bool)
                fits[at[kept]] = True
            found.append(np.flatnonzero(fits))
        return found

    def phrases(self, places: list[np.ndarray]) -> dict[int, list[str]]:
        """By length from 2 on, the distinct phrases at ``places``, compared by the ids of their words."""
        size, ids = len(self.names), self.ids
        found, ranks = {}, ids
        for length in range(2, len(places) + 1):
            at = places[length - 1]
            # The rank of the part without the last word, among those of its length, and the last word.
            _, first, inverse = np.unique(ranks[at] * size + ids[at + length - 1], return_index=True, return_inverse=True)
            found[length] = [b" ".join([self.names[w] for w in ids[p : p + length].tolist()]).decode() for p in at[first].tolist()]
            ranks = np.zeros(len(ids), np.int64)
            ranks[at] = inverse
        return found


def shards(batches: Iterator[pa.RecordBatch], spelled: bool, words: int) -> Iterator[Shard]:
    """Closed shards of the (lang, text) rows of a partition."""
    held: dict[str, Shard] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            by_lang: dict[str, list[str]] = {}
            piece = batch.slice(at, 64)
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in held:
                    held[lang] = Shard(lang, spelled)
                held[lang].add(texts)
            if sum(s.words for s in held.values()) >= words:
                yield from _closed(held)
    yield from _closed(held)


def _closed(held: dict[str, Shard]) -> Iterator[Shard]:
    while held:
        shard = held.pop(next(iter(held)))
        shard.close()
        yield shard


def sketched(texts: DataFrame, before: list[Broadcast], lengths: tuple[int, ...], least: int, cell_bits: int, words: int) -> Sketch:
    """A sketch of all word sequences of ``lengths`` whose parts may be frequent by the sketches ``before``.

    A shard hands on its counters capped at ``least``, which decides alike; blocks of cells are summed as
    they stream by.  The driver gets a bit a cell at most.
    """
    low = np.int64((1 << BLOCK_BITS) - 1)
    kind = np.dtype("<u1") if least < 256 else np.dtype("<u8")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [b.value for b in before]
        for shard in shards(batches, False, words):
            places = shard.candidates(known, lengths[-1])
            prints = np.concatenate([shard.prints(places[n - 1], n) for n in lengths])
            for cells in cells_of(prints, cell_bits):
                cells, counts = np.unique(cells, return_counts=True)
                home = cells >> BLOCK_BITS
                starts = np.flatnonzero(np.append(True, home[1:] != home[:-1])[: len(home)])
                edges = np.append(starts, len(cells))
                places, counts = (cells & low).astype("<u2"), np.minimum(counts, least).astype(kind)

                def cut(values: np.ndarray) -> pa.Array:
                    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64) * values.itemsize), pa.py_buffer(values.tobytes())]).cast(pa.binary())

                yield pa.RecordBatch.from_arrays([pa.array(home[starts]), cut(places), cut(counts)], names=["block", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for home, places, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if home != block:
                    if block is not None and (total >= least).any():
                        yield closed()
                    block = home
                    total[:] = 0
                # The places of a row are distinct.
                total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, kind).astype(np.int64)
        if block is not None and (total >= least).any():
            yield closed()

    counted = texts.mapInArrow(count, "block long, places binary, counts binary")
    blocks = counted.repartition(2 * partitions(texts.sparkSession), "block").sortWithinPartitions("block")
    bits = np.zeros(SKETCH_ROWS << (cell_bits - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    # Bounded by the size of the sketch, however many texts there are.
    for row in saved(blocks.mapInArrow(add, "block long, bits binary"), "collocation-sketch").toLocalIterator():
        bits[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return Sketch(bits, cell_bits)


def counted(texts: DataFrame, sketches: list[Broadcast], longest: int, words: int) -> DataFrame:
    """(lang, phrase, words, f): what each shard's automata count; a row of 0 words holds the words of all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [b.value for b in sketches]
        for shard in shards(batches, True, words):
            places = shard.candidates(known, longest)
            single = np.bincount(shard.ids[places[0]], minlength=len(shard.names))
            seen = np.flatnonzero(single)
            phrases, lengths = ["", *[shard.names[w].decode() for w in seen.tolist()]], [0] + [1] * len(seen)
            base = len(phrases)
            for n, found in shard.phrases(places).items():
                phrases += found
                lengths += [n] * len(found)
            counts = np.zeros(len(phrases), np.int64)
            counts[0], counts[1:base] = shard.words, single[seen]
            texts, lang = shard.texts, shard.lang
            del shard, places
            if len(phrases) > base:
                automaton = ahocorasick.Automaton()
                for k in range(base, len(phrases)):
                    automaton.add_word(f" {phrases[k]} ", k)
                automaton.make_automaton()
                for text in texts:
                    counts += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(phrases))
                del automaton
            for at in range(0, len(phrases), 65_536):
                part = phrases[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(lengths[at : at + len(part)], pa.int32()), pa.array(counts[at : at + len(part)])], names=["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(scan, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _wide(name: str) -> str:
    return f"CAST({name} AS DECIMAL(20, 0))"


def judged(counts: DataFrame, top: int, share: int) -> DataFrame:
    """The best phrases of each language, by their weakest cut."""
    known = counts.where("words > 0")
    phrases = known.where("words > 1").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "words",
        "a",
        "k",
        F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    one = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    other = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(2000000 * {_wide('a')}) div ({_wide('l')} + {_wide('r')})")
    weakest = (
        cut.join(one, ["lang", "first"])
        .join(other, ["lang", "rest"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    inner = (
        phrases.where("words > 2")
        .withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)))
        .select("lang", F.array_join(F.slice(parts, F.col("at"), F.col("n")), " ").alias("phrase"), F.col("a").alias("outer"))
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.expr(f"outer IS NULL OR 100 * {_wide('outer')} < {share} * {_wide('a')}"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, cell_bits: int = CELL_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each ``lang``: lang, rank, phrase, a, l, r, n, score."""
    if least < 1 or longest < 2 or not BLOCK_BITS <= cell_bits <= 40:
        raise ValueError("phrases have two words and occur once at least; a sketch holds a block at least")
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketches: list[Broadcast] = []
    for n in range(1, longest + 1, 2):
        lengths = tuple(range(n, min(n + 1, longest) + 1))
        sketches.append(context.broadcast(sketched(texts, sketches.copy(), lengths, least, cell_bits, shard_words)))
    counts = saved(counted(texts, sketches, longest, shard_words).where((F.col("f") >= least) | (F.col("words") == 0)), "collocation-counts")
    return judged(counts, top, share)
