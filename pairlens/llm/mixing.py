"""Mixing sources to target weights, with column expressions alone.

Documents get hash-random keys.  Keys are cut into equal ranges; token counts are summed
by (source, range), prefix sums over the ranges give each range its start, and a window
inside the range gives each document the tokens before it.  A source whose target is e
times its size or more takes e whole epochs and then documents in key order, up to the
exact budget.  No range holds more rows than its share of the hash space, whatever a
source's size.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source
of its own, last in order; rows that share a doc_id are each rows of the mix, equal keys
fall in order of doc_id and size (rows that agree in both are interchangeable); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.common import SPACE, WORD, partitions, power_of_two, saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Times its own size that a source may be taken.
MOST_EPOCHS = 3
#: Rows that a range of keys holds on average, at most.
RANGE_ROWS = 65_536
KEY_BITS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, seed: str = "") -> Column:
    """60 bits of a hash of the id: the same on every run, in any order of the rows."""
    text = F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """A row for each source of ``sizes``: source_size and target.

    Shares of the total by weight, cut at ``most`` times the source's size; what is cut
    off is shared again among the others.  With sources in order of limit over weight
    that has a closed form: the first one that stays below its limit fixes the level.
    """
    all_, by_name = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("limit")
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", full / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("stays", F.min(F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(all_))
        .withColumn("fixed", F.max(F.when(F.col("place") == F.col("stays"), F.col("level"))).over(all_))
        .select("source", "source_size", F.when((F.col("stays").isNull()) | (F.col("place") < F.col("stays")), full.cast("double")).otherwise(F.col("fixed") * F.col("weight")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "", carry: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, and the columns of ``carry``."""
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        words(F.col(text_column)).alias("size"),
        random_key(F.col(id_column), seed).alias("key"),
        *carry,
    )
    sizes = saved(narrow, "mix-sizes")
    ranges = power_of_two(max(8 * partitions(docs.sparkSession), sizes.count() // RANGE_ROWS))
    sizes = sizes.withColumn("range", F.shiftright("key", KEY_BITS - (ranges.bit_length() - 1)))
    targets = source_targets(sizes, weights, most)
    by_range = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sizes.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("before_range", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
        .alias("r")
        .join(targets.alias("t"), F.expr("r.source <=> t.source"))
        .select("r.source", "range", "before_range", "source_size", "target")
    )
    inside = W.partitionBy("s.source", "s.range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before_range") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        sizes.alias("s")
        .join(starts.alias("r"), F.expr("s.range = r.range AND s.source <=> r.source"))
        .withColumn("before", before)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id",
            F.col("s.source").alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))).alias("taken"),
            *[F.col(f"s.{c}") for c in carry],
        )
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: rows once for each epoch that takes them.

    Rows that no epoch takes are left out, and the row at which a source's budget ends is
    cut to the words that it still takes (joined by spaces; a column n_chars follows).
    """
    row = docs.select(id_column, text_column, source_column, F.struct("*").alias("_row"))
    taken = mix(row, weights, most, seed, ("_row",), id_column, text_column, source_column)
    whole = F.when(F.col("size") > 0, F.expr("taken DIV size")).otherwise(F.lit(0))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    counted = taken.select("_row", whole.alias("whole"), part.cast("int").alias("part")).where("whole > 0 OR part > 0")
    copies = counted.select("_row", "whole", "part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0))).alias("copy"))
    last = F.col("copy") > F.col("whole")
    text = F.col(f"_row.`{text_column}`")
    trimmed = F.regexp_replace(text, f"^{SPACE}", "")
    changed = {text_column: F.when(last, F.array_join(F.slice(F.split(trimmed, SPACE), 1, F.col("part")), " ")).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(last, F.length(changed[text_column]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return copies.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
