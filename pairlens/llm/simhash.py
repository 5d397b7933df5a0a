"""SimHash near-duplicate detection over a Gray-order hierarchical index.

The distinct fingerprints are range-partitioned and sorted by Gray rank, so neighbours share
most bits.  Runs of LEAF_ROWS of them are the leaves of the index; FAN nodes in a row make a
node of the level above.  A node keeps the bit pattern that all its members share.  The search
descends pairs of nodes from the top, level by level, as tables: a pair goes as soon as the
differences on bits that both nodes share exceed the radius, and with it all pairs of their
members.  Pairs of leaves that are left meet in a task, which goes on the same way inside them
down to fingerprints.  There is no other path, at any size.

Leaves are ranges of sorted distinct fingerprints, so none is larger than the others, whatever
the data; a task holds two leaves, and emits a spanning forest of their links, never all pairs.

Defined results: a null or empty text has fingerprint zero and links like any other; equal
texts and repeated rows share a fingerprint; ties in doc_id are rows of one class; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import UPPER, fresh, if_small, partitions, runs, saved
from pairlens.llm.components import connected_components, spanning_forest

SEED = 42
#: Fingerprints of a leaf of the index, children of a node above leaves, and inside them.
LEAF_ROWS, FAN, INNER_FAN = 4096, 16, 4
SIMILARITY = 0.8
#: The two halves of a hash of a document's set of shingles.
SET_KEY = ("k0", "k1")
#: Bits by which linked fingerprints may differ.
RADIUS = 2
#: Candidates of a stage for pairs that differ in more bits than the index can search share one of BANDS groups of
#: BAND_ROWS least hashes.  Each least hash agrees with the probability of the Jaccard similarity, wherever the edits
#: lie: a pair of 0.8 is missed 6 times in 100,000.
BANDS, BAND_ROWS = 32, 6
#: Rounds of links along cells before all that is left is compared.
CHAIN_ROUNDS = 3
#: Nodes of a cell up to which its pairs go on as rows; a larger one is cut into blocks of so many nodes
#: and bytes of shingles, and pairs of blocks meet in tasks.
PAIR_NODES, BLOCK_NODES, BLOCK_BYTES = 32, 128, 1 << 24
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_CHUNK = 1 << 15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included."""
    # bytes.split() splits at exactly the white space of the contracts.
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, "<u8")
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half the hashes."""
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority_bits(shingle_hashes(t.as_py() or b"", words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string").cast("binary")).mapInArrow(hash_, "doc_id long, fp long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bits set in all and in any member of the nodes over sorted ``prints``, from single prints up to one node."""
    found = [(prints, prints)]
    while len(found[-1][0]) > 1:
        starts = np.arange(0, len(found[-1][0]), INNER_FAN)
        found.append((np.bitwise_and.reduceat(found[-1][0], starts), np.bitwise_or.reduceat(found[-1][1], starts)))
    return found


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of prints of two leaves, each sorted by Gray rank, that differ in ``radius`` bits at most;
    without ``right`` pairs i < j of one leaf."""
    same = right is None
    one = _levels(left)
    two = one if same else _levels(right)
    height = max(len(one), len(two))
    # The lower hierarchy's root stands for itself on the levels above it.
    one, two = (x + [x[-1]] * (height - len(x)) for x in (one, two))
    a = b = np.zeros(1, np.int64)
    child = np.arange(INNER_FAN)
    first, second = np.repeat(child, INNER_FAN), np.tile(child, INNER_FAN)
    for level in range(height - 1, -1, -1):
        if level < height - 1:
            a, b = (a[:, None] * INNER_FAN + first).ravel(), (b[:, None] * INNER_FAN + second).ravel()
        (all_a, any_a), (all_b, any_b) = one[level], two[level]
        inside = (a < len(all_a)) & (b < len(all_b))
        if same:
            inside &= a <= b if level else a < b
        a, b = a[inside], b[inside]
        shared = ~((all_a[a] ^ any_a[a]) | (all_b[b] ^ any_b[b]))
        near = np.bitwise_count((all_a[a] ^ all_b[b]) & shared) <= radius
        a, b = a[near], b[near]
    return a, b


def _gray_column(prints: DataFrame) -> DataFrame:
    """``prints`` with column r: its Gray rank, as a long whose signed order is that of the unsigned ranks."""
    rows = prints.withColumn("r", F.col("fp"))
    for shift in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("r", F.col("r").bitwiseXOR(F.shiftrightunsigned("r", shift)))
    return rows.withColumn("r", F.col("r").bitwiseXOR(F.lit(-(2**63))))


def _cut(leaf_rows: int):
    """Prints in order to leaves (ones, some, prints): runs of ``leaf_rows``."""

    def leaf(prints: np.ndarray) -> pa.RecordBatch:
        starts = np.arange(0, len(prints), leaf_rows)
        columns = [np.bitwise_and.reduceat(prints, starts).view(np.int64), np.bitwise_or.reduceat(prints, starts).view(np.int64), [prints[s : s + leaf_rows].tobytes() for s in starts]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.binary())], names=["ones", "some", "prints"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros(0, np.uint64)
        for batch in batches:
            rest = np.concatenate([rest, batch.column(0).to_numpy().view(np.uint64)])
            if whole := len(rest) // leaf_rows * leaf_rows:
                yield leaf(rest[:whole])
                rest = rest[whole:]
        if len(rest):
            yield leaf(rest)

    return leaves


def index_leaves(prints: DataFrame) -> tuple[DataFrame, int]:
    """The leaves (leaf, ones, some, prints) of the index over distinct ``prints`` (fp), numbered in Gray order; their number."""
    spark = prints.sparkSession
    ordered = _gray_column(prints.select("fp")).repartitionByRange(partitions(spark), "r").sortWithinPartitions("r").select("fp")
    # Range partitions and the rows of each come in order: the high bits of the id are the partition.
    leaves = saved(ordered.mapInArrow(_cut(LEAF_ROWS), "ones long, some long, prints binary").withColumn("at", F.monotonically_increasing_id()), "simhash-leaves")
    part = F.shiftright("at", 33)
    # A row a partition: numbers of leaves before it.
    sizes = sorted((r["part"], r["n"]) for r in leaves.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, first))
        first += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, first long"))
    numbered = leaves.withColumn("part", part).join(starts, "part").select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("leaf"), "ones", "some", "prints")
    return numbered, first


def close_leaves(leaves: DataFrame, count: int, radius: int) -> DataFrame:
    """Pairs (a <= b) of leaves whose shared bits allow members within ``radius``, by descent from the top."""
    height = 0
    while FAN**height < count:
        height += 1
    nodes = saved(leaves.select(F.col("leaf").alias("node"), "ones", "some"), "simhash-nodes")
    levels = [nodes]
    for _ in range(height):
        up = levels[-1].groupBy(F.expr(f"node DIV {FAN}").alias("node")).agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
        levels.append(saved(up, "simhash-nodes"))
    pairs = leaves.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in range(height - 1, -1, -1):
        kids = levels[level].groupBy(F.expr(f"node DIV {FAN}").alias("parent")).agg(F.collect_list(F.struct("node", "ones", "some")).alias("kids"))
        kids = if_small(kids, FAN ** (height - level - 1), 24 * FAN + 32)
        left, right = kids.select(F.col("parent").alias("a"), F.col("kids").alias("x")), kids.select(F.col("parent").alias("b"), F.col("kids").alias("y"))
        near = "bit_count((p.ones ^ q.ones) & ~((p.ones ^ p.some) | (q.ones ^ q.some)))"
        below = F.expr(f"flatten(transform(x, p -> transform(filter(y, q -> p.node <= q.node AND {near} <= {radius}), q -> struct(p.node AS a, q.node AS b))))")
        # Both sides of a hot node are plain columns, which adaptive execution can split.
        pairs = saved(pairs.join(left, "a").join(right, "b").select(F.explode(below).alias("p")).select("p.*"), "simhash-pairs")
    return pairs


def _leaf_links(radius: int):
    """Rows (x, y: prints of two leaves; y null: one leaf) to a forest of the links between their fingerprints."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                left = np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64) if y.is_valid else None
                a, b = close_pairs(left, right, radius)
                if not len(a):
                    continue
                prints = left if right is None else np.concatenate([left, right])
                b = b if right is None else b + len(left)
                kept = spanning_forest(len(prints), a, b, np.zeros(len(a), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(prints[v[kept]].view(np.int64)) for v in (a, b)], names=["a", "b"])

    return links


def close_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints`` (fp) that connect them as all pairs within ``radius`` do."""
    leaves, count = index_leaves(prints)
    pairs = close_leaves(leaves, count, radius)
    left = leaves.select(F.col("leaf").alias("a"), F.col("prints").alias("x"))
    right = leaves.select(F.col("leaf").alias("b"), F.col("prints").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("x", F.when(F.col("a") != F.col("b"), F.col("y")).alias("y"))
    # Leaves are of one size and pairs independent of each other: any even spread will do.
    return met.repartition(partitions(prints.sparkSession)).mapInArrow(_leaf_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable)."""
    prints = saved(fingerprints(docs, words, id_column, text_column), "simhash-prints")
    return components_of(prints, radius)


def components_of(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id."""
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    labels = connected_components(close_links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = classes.join(labels, "fp")
    smallest = linked.groupBy("rep").agg(F.min("first").alias("component_id"))
    joined = linked.join(saved(smallest, "simhash-smallest"), "rep").select("fp", "component_id")
    ids = saved(classes.join(saved(joined, "simhash-linked"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(prints: Column) -> Column:
    return F.lpad(F.lower(F.hex(prints)), 16, "0")


def least_hashes(hashes: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The least of ``hashes`` under each of several hash functions."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[at : at + 256, None] ^ masks) * factors).min(0), out=least)
    return least


def banded(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, h, size, k0, k1, fp, cells): a hash of the text; of its set of shingles the size, a 128-bit hash, the
    fingerprint and the cells of least hashes."""
    chooser = np.random.default_rng(SEED)
    factors, masks = (chooser.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
    factors |= np.uint64(1)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for text in batch.column(2):
                hashes = np.unique(shingle_hashes(text.as_py() or b"", words))
                key = xxhash.xxh3_128_intdigest(hashes.tobytes(), SEED)
                rows.append([len(hashes), key >> 64, key & (1 << 64) - 1, majority_bits(hashes)])
                bands = least_hashes(hashes, factors, masks).reshape(BANDS, BAND_ROWS)
                cells.append(np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(bands)], np.uint64).view(np.int64))
            columns = np.array(rows, np.uint64).reshape(-1, 4).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), pa.array(cells, pa.list_(pa.int64()))], names=["doc_id", "h", "size", *SET_KEY, "fp", "cells"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long"), F.xxhash64(text), text.cast("binary"))
    return rows.mapInArrow(hash_, "doc_id long, h long, size long, k0 long, k1 long, fp long, cells array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell, those that aren't alone in their cell."""
    for rows in runs(batches, "cell"):
        cells = rows["cell"].to_numpy()
        same = cells[1:] == cells[:-1]
        yield from rows.filter(pa.array(np.append(False, same) | np.append(same, False))).to_batches()


def _unlinked(similarity: float, step: int | None):
    """Rows (cell, node, size, comp) sorted by cell to pairs of unlike comp of a cell whose sizes allow for
    ``similarity``: neighbours in an order that changes with the step, or all pairs if it is None."""
    names = ["a", "b", "ca", "cb"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], comp[i], comp[j])], names=names)

        for rows in runs(batches, "cell"):
            cell, node, size, comp = (rows[c].to_numpy() for c in ("cell", "node", "size", "comp"))
            ranks = size.astype(np.uint64) if not step else _mixed(node.astype(np.uint64), step)
            order = np.lexsort((node, ranks, cell))
            cell, node, size, comp = (x[order] for x in (cell, node, size, comp))
            if step is not None:
                i = np.flatnonzero((cell[1:] == cell[:-1]) & (comp[1:] != comp[:-1]))
                yield out(i, i + 1)
                continue
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            ends = np.append(starts[1:], len(cell))
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if (comp[s:e] == comp[s]).all():
                    continue
                for i in range(s, e - 1):
                    j = i + 1 + np.flatnonzero(comp[i + 1 : e] != comp[i])
                    if len(j):
                        waiting.append((np.full(len(j), i), j))
                    if sum(len(w[0]) for w in waiting[-64:]) > _CHUNK or len(waiting) >= 4096:
                        yield out(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                        waiting = []
            if waiting:
                yield out(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return pairs


def _mixed(hashes: np.ndarray, step: int) -> np.ndarray:
    """Other hashes from hashes: a step and a bijective mix."""
    x = hashes + np.uint64(step)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text as bytes): the sorted distinct hashes as bytes."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", words)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(shingles, "node long, shingles binary")


def verified_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b, ca, cb) whose ``sets`` (node, shingles) have that exact Jaccard similarity, or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return links.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "x", "y").mapInArrow(compare, "a long, b long, ca long, cb long")


def block_links(rows: DataFrame, bands: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (ca, cb) between the components of large cells ``rows`` (cell, node, size, comp, count, bytes) that a
    pair of nodes of a cell with that exact Jaccard similarity, or more, joins.

    A pair of nodes is compared in the first of its common ``bands`` (node, cells) alone.
    """
    names = ["cell", "i", "j", "node", "comp", "side", "cells", "shingles"]

    def compare(group: pa.Table) -> pa.Table:
        cell, i, j = (group[c][0].as_py() for c in ("cell", "i", "j"))
        comp, side = (group[c].to_numpy() for c in ("comp", "side"))
        cells = np.array(group["cells"].to_pylist(), np.int64)
        values = [np.frombuffer(x.as_buffer(), "<u8") for x in group["shingles"]]
        sizes = np.array([len(v) for v in values])
        owner = np.repeat(np.arange(len(values)), sizes)
        columns = np.unique(np.concatenate(values), return_inverse=True)[1]
        order = np.argsort(columns, kind="stable")
        owner, columns = owner[order], columns[order]
        # Sizes of all intersections: a matrix product over a part of the shingles at a time.
        both, width = np.zeros((len(values),) * 2, np.float32), max(1, (1 << 24) // len(values))
        for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
            part = slice(*np.searchsorted(columns, [at, at + width]))
            held = np.zeros((len(values), width), np.float32)
            held[owner[part], columns[part] - at] = 1
            both += held @ held.T
        both = both.astype(float)
        alike = both >= similarity * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(np.triu(alike & (comp[:, None] != comp[None, :]), 1))
        if i != j:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        common = cells[a] == cells[b]
        first = cells[a, common.argmax(1)] == cell
        a, b = a[first], b[first]
        kinds, index = np.unique(comp, return_inverse=True)
        kept = spanning_forest(len(kinds), index[a], index[b], np.zeros(len(a), np.int64))
        return pa.table({"ca": comp[a[kept]], "cb": comp[b[kept]]})

    blocks = F.greatest(F.ceil(F.col("count") / BLOCK_NODES), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")))
    met = own.select("cell", "node", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return met.join(bands, "node").join(sets, "node").select(*names).groupBy("cell", "i", "j").applyInArrow(compare, "ca long, cb long")


def linked_nodes(cells: DataFrame, bands: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, rep) of the nodes of ``cells`` (cell, node, size): the components of all pairs of a cell that
    have the exact ``similarity``.

    Rounds compare neighbours in each cell and join what is confirmed; a last one compares all pairs of a
    cell that aren't joined by then, those of large cells in blocks.
    """
    labels = saved(cells.select("node").distinct().withColumn("comp", F.col("node")), "simhash-labels")
    checked: DataFrame | None = None
    for step in (*range(CHAIN_ROUNDS), None):
        rows = cells.join(labels, "node").select("cell", "node", "size", "comp")
        blocked: DataFrame | None = None
        if step is None:
            # Cells whose nodes are all joined are done.
            rows = saved(rows, "simhash-open")
            sizes = rows.groupBy("cell").agg(F.count("*").alias("count"), (8 * F.sum("size")).alias("bytes"), F.min("comp").alias("least"), F.max("comp").alias("most"))
            sizes = saved(sizes.where("least < most").select("cell", "count", "bytes"), "simhash-sizes")
            large = saved(rows.join(sizes.where(F.col("count") > PAIR_NODES), "cell"), "simhash-large")
            blocked = saved(block_links(large, bands, sets, similarity), "simhash-blocked")
            rows = rows.join(sizes.where(F.col("count") <= PAIR_NODES).select("cell"), "cell", "left_semi")
        new = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_unlinked(similarity, step), "a long, b long, ca long, cb long").distinct()
        new = saved(new if checked is None else new.join(checked, ["a", "b"], "left_anti"), "simhash-links")
        checked = new.select("a", "b") if checked is None else checked.union(new.select("a", "b"))
        good = saved(verified_links(new, sets, similarity), "simhash-verified").select("ca", "cb")
        good = good if blocked is None else good.union(blocked)
        moves = connected_components(good.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")))
        moves = moves.select(F.col("node").alias("comp"), "rep")
        labels = saved(labels.join(moves, "comp", "left").select("node", F.coalesce("rep", "comp").alias("comp")), "simhash-labels")
    return labels.withColumnRenamed("comp", "rep")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with one document of each group of near copies: the one with the smallest id.

    A group is held together by links whose sets of ``words``-word shingles have the exact Jaccard
    ``similarity``, or more.  The first candidates are the components of the sets' fingerprints, by the
    Gray-order index; pairs of that similarity whose fingerprints differ in more bits share a band of least
    hashes.  Every candidate is compared, in the first cell that it has in common, unless links join it already.
    """
    rows = saved(banded(docs, words, id_column, text_column), "simhash-bands")
    # Documents of a class have one set of shingles; all others meet the exact check.
    classes = rows.groupBy(*SET_KEY).agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("cells").alias("cells"))
    # Ids are fixed by the write, whatever is computed again later on.
    classes = saved(classes.select(*SET_KEY, "size", "fp", "cells", F.col("first.doc_id").alias("first"), F.col("first.h").alias("first_h"), F.monotonically_increasing_id().alias("node")), "simhash-classes")
    # Before the bands, which are hashes that know their number, comes the component of the fingerprint.
    near = components_of(classes.select(F.col("node").alias("doc_id"), "fp"), RADIUS).select(F.col("doc_id").alias("node"), F.xxhash64(F.lit("fp"), "component_id").alias("near"))
    classes = saved(classes.join(near, "node").withColumn("cells", F.concat(F.array("near"), "cells")).drop("near", "fp"), "simhash-classes")
    cells = classes.select(F.explode("cells").alias("cell"), "node", "size").repartition("cell").sortWithinPartitions("cell")
    cells = saved(cells.mapInArrow(_shared, "cell long, node long, size long"), "simhash-cells")

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # The caller's columns stay as they are, whatever their names.
    id_, hash_, text_ = fresh(docs, "id", "h", "shingled")
    marked = docs.withColumns({id_: F.col(id_column).cast("long"), hash_: F.xxhash64(text)})
    named = saved(cells.select("node").distinct().join(classes, "node").select("node", "first", "first_h"), "simhash-named")
    same = F.col(id_).eqNullSafe(F.col("n.first")) & (F.col(hash_) == F.col("n.first_h"))
    texts = marked.select(id_, hash_, text.alias(text_)).join(named.alias("n"), same).groupBy("n.node").agg(F.min(text_).cast("binary").alias("text"))
    bands = classes.select("node", "cells")
    labels = linked_nodes(cells, bands, saved(shingle_sets(texts, words), "simhash-shingles"), similarity)

    linked = classes.select("node", "first").join(labels, "node")
    smallest = saved(linked.groupBy("rep").agg(F.min("first").alias("keep_id")), "simhash-smallest")
    linked = linked.join(smallest, "rep").select("node", "keep_id")
    kept = classes.select("node", *SET_KEY, "first").join(saved(linked, "simhash-linked"), "node", "left")
    kept = saved(kept.select(*SET_KEY, F.coalesce("keep_id", "first").alias("keep_id")), "simhash-kept")
    gone = rows.select("doc_id", "h", *SET_KEY).join(kept, [*SET_KEY]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", F.col("h").alias("gone_h"))
    gone = saved(gone.toDF("gone_id", "gone_h"), "simhash-gone").alias("gone")
    return marked.join(gone, F.col(id_).eqNullSafe(F.col("gone.gone_id")) & (F.col(hash_) == F.col("gone.gone_h")), "left_anti").drop(id_, hash_)
