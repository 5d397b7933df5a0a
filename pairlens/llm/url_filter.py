"""URL verdicts from listed host and path prefixes, with column expressions alone.

A listed entry is a host (it fits its subdomains) and a path prefix.  Canonical entries are
hashed into a blocked Bloom filter: a key sets PROBES bits of one 64-bit block, so a test reads
one word.  The filter is a table of its blocks, which a URL's keys meet by the number of the
block: broadcast while its counted size allows, shuffled beyond, the same plan at any size.  A
URL's keys are its host's suffixes with the path lengths that the list uses for that many
labels.  Possible hits go on to an exact hash join, which removes false positives.  The longest
entry decides; a URL that none fits is allowed.

Defined results: a null URL or one without ``://`` has empty host and path; hosts and
paths are compared as they stand but for A to Z in hosts; repeated rows each get their
verdict; of entries of equal length the one with the longer host wins, of the same entry
listed twice the block; an empty list allows all; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import ascii_lower, if_small, power_of_two, saved

#: (host, path prefix, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BITS_PER_KEY = 16
PROBES = 5


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _mask(key: Column) -> Column:
    """PROBES bits of a block, six bits of a second hash each."""
    hashed = F.xxhash64(key, F.lit(1))
    return _or([F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)])


def _or(columns: list[Column]) -> Column:
    found = columns[0]
    for c in columns[1:]:
        found = found.bitwiseOR(c)
    return found


def bloom_filter(keys: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """The filter's blocks (block, word) that hold bits, and the number of all its blocks."""
    blocks = power_of_two(max(1, entries * BITS_PER_KEY // 64))
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word")), blocks


def possible_hits(keys: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` (row, key) that the filter lets pass."""
    mask = _mask(F.col("key"))
    probed = keys.withColumn("block", _block(F.col("key"), blocks)).join(if_small(words, blocks, 48), "block")
    return probed.where(F.col("word").bitwiseAND(mask) == mask).select("row", "key")


def listed_keys(host: str, path: str, lengths: dict[int, list[int]]) -> Column:
    """The keys that a list with these path lengths by number of labels may hold for a URL."""
    # An index is a number of labels; the arrays are literals that the limits on hosts and URLs bound.
    table = "array(" + ", ".join(f"CAST(array({', '.join(map(str, lengths.get(c, [])))}) AS array<int>)" for c in range(1, max(lengths) + 1)) + ")"
    counts = f"filter(sequence(1, least(size(split({host}, '[.]', -1)), {max(lengths)})), c -> size(element_at({table}, c)) > 0)"
    prefixes = f"transform(filter(element_at({table}, c), n -> n <= length({path})), n -> concat(substring_index({host}, '.', -c), left({path}, n)))"
    return F.expr(f"array_distinct(flatten(transform({counts}, c -> {prefixes})))")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none fits), verdict."""
    listed = (
        rules.where("path = '' OR path LIKE '/%'")
        .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("key"), F.length("host").alias("host_length"), "verdict", labels(F.col("host")).alias("labels"), F.length("path").alias("path_length"))
    )
    host, path = host_and_path(F.col(url_column))
    urls = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = saved(listed, "url-list")
    entries = listed.count()
    if not entries:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    lengths: dict[int, list[int]] = {}
    for shape in sorted(listed.select("labels", "path_length").distinct().collect()):
        lengths.setdefault(shape["labels"], []).append(shape["path_length"])
    # Numbers of rows are fixed by the write.
    urls = saved(urls.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    words, blocks = bloom_filter(listed, entries)
    keys = urls.select("row", F.explode(listed_keys("host", "path", lengths)).alias("key"))
    entry = F.struct(F.length("key").alias("length"), "host_length", "key", "verdict")
    hits = (
        possible_hits(keys, saved(words, "url-filter"), blocks)
        .join(if_small(listed.select("key", "host_length", "verdict"), entries, 256), "key")
        .groupBy("row")
        .agg(F.max(entry).alias("entry"))
    )
    return urls.join(hits, "row", "left").select("page_id", "host", "path", F.col("entry.key").alias("rule"), F.coalesce("entry.verdict", F.lit("allow")).alias("verdict"))
