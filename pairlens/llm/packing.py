"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into full pieces and a remainder.  The histogram of
remainder lengths (at most ``size`` bins) is packed on the driver: lengths are placed
longest first, each into the open pattern with the fewest tokens, and a pattern's count
is split when a bin ends inside it.  Patterns then meet documents again through ranks:
the k-th piece of a length takes the k-th slot planned for that length.

Ranks come from a window over (length, salt); a length gets as many salts as its share
of all pieces asks for, so a length that a third of the rows have is dealt out evenly.

Defined results: a null text counts as empty and still gives the end token; a repeated
row is packed each time; a very long text is cut like any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.common import partitions, saved

SIZE = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"

#: Ids of a vocabulary of less than 65,536 travel as two bytes and leave as four.
_TRANSIT = "<u2"

PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(vocabulary: str = VOCABULARY, added_tokens: bool = False) -> Callable[[str], list[int]]:
    """Text to ids of ``<vocabulary>.json``.

    The rank file of the same vocabulary gives the same ids five times as fast; texts
    that its regular expression engine gives up on go to the JSON file's own tokenizer.
    With ``added_tokens`` so do texts that hold an added token of that file, which is one
    id then, as the file says; without, its characters are encoded like any others.
    """
    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(vocabulary_path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []
    added: list[str] = []
    if added_tokens:
        with open(vocabulary_path(f"{vocabulary}.json"), "rb") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return exact(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # a Rust panic isn't an Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return exact(text)

    def exact(text: str) -> list[int]:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(vocabulary_path(f"{vocabulary}.json")))
            slow[0].encode_special_tokens = not added_tokens
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", added_tokens: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids, in transit width in ``ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], "<u4").astype(_TRANSIT)
                    rows += [(doc_id, start, min(size, len(ids) - start), len(ids), ids[start : start + size].tobytes()) for start in range(0, len(ids), size)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold exactly these), for a histogram of lengths."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # by tokens used

    def put(pattern: tuple[int, ...], used: int, count: int) -> None:
        group = open_.setdefault(used, {})
        group[pattern] = group.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            used = min((u for u, group in open_.items() if group and u + length <= size), default=None)
            if used is None:
                # As many of the length as fit stand together, the rest of the bin in one more pattern.
                fit = size // length
                if left >= fit:
                    put((length,) * fit, length * fit, left // fit)
                if left % fit:
                    put((length,) * (left % fit), length * (left % fit), 1)
                break
            pattern, count = open_[used].popitem()
            taken = min(left, count)
            if taken < count:
                open_[used][pattern] = count - taken
            put((*pattern, length), used + length, taken)
            left -= taken
    return [(pattern, count) for used in sorted(open_, reverse=True) for pattern, count in open_[used].items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, first sequences and offsets of the runs of its planned slots."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            found.setdefault(length, []).append((rank, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in found.items()}


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", added_tokens: bool = False) -> DataFrame:
    """All documents as pieces in sequences: PIECES, then sequence_id and offset.

    ``ids`` holds little-endian unsigned 32-bit ids.

    The driver holds the histogram and the plan alone: at most ``size`` bins, and at most
    two patterns more for each bin.
    """
    pieces = saved(token_pieces(docs, size, vocabulary, id_column, text_column, added_tokens), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = slots(shortest_pack_first(histogram, size))
    total = sum(histogram.values())
    spread = 4 * partitions(docs.sparkSession)
    salts = {length: -(-count * spread // total) for length, count in histogram.items()}

    salt = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.element_at(F.lit([salts.get(i, 1) for i in range(1, size + 1)]), F.col("length")))
    salted = pieces.withColumn("salt", salt.cast("int"))
    # At most ``size`` + 4 x partitions groups: the rank where each one starts.
    groups = sorted((r["length"], r["salt"], r["count"]) for r in salted.groupBy("length", "salt").count().collect())
    first: dict[tuple[int, int], int] = {}
    for length, salt_, _ in groups:
        first[length, salt_] = 0
    seen: dict[int, int] = {}
    for length, salt_, count in groups:
        first[length, salt_] = seen.get(length, 0)
        seen[length] = seen.get(length, 0) + count

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, salts_, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "salt", "rank"))
            sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.lexsort((salts_, lengths))
            bounds = np.flatnonzero(np.append(True, (np.diff(lengths[order]) != 0) | (np.diff(salts_[order]) != 0))) if len(order) else order
            for part in np.split(order, bounds[1:]):
                length = int(lengths[part[0]])
                rank = ranks[part] + first[length, int(salts_[part[0]])]
                starts, sequence, offset = plan[length]
                run = np.searchsorted(starts, rank, "right") - 1
                sequences[part], offsets[part] = sequence[run] + rank - starts[run], offset[run]
            kept = [batch.column(batch.schema.get_field_index(f.split()[0])) for f in PIECES.split(", ")]
            kept[-1] = pa.array([np.frombuffer(x.as_buffer(), _TRANSIT).astype("<u4").tobytes() for x in kept[-1]], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences), pa.array(offsets)], names=[*(f.split()[0] for f in PIECES.split(", ")), "sequence_id", "offset"])

    order = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids")
    return salted.withColumn("rank", F.row_number().over(order) - 1).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
