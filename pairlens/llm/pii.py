"""Personal data: validated base matches, and bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are seeds.  Patterns are the one and the two words
to the left of an identifier; seeds induce patterns, and so do the identifiers discovered
later.  Identifier-like tokens outside all base matches of their text are open.  Patterns
and what they introduce form a graph that is scored in rounds:

* a pattern's support for a kind is its distinct seeds of the kind plus what its discovered
  tokens are worth; its confidence is the support over all distinct seeds and open tokens
  it introduces, plus one; it counts from LEAST_SEEDS and PATTERN_CONFIDENCE on;
* a token's worth for a kind that its shape allows is one less the product of (1 - confidence)
  of the patterns that introduce it; from TOKEN_CONFIDENCE on it is discovered, as the kind
  it is worth most for, and supports all its patterns in the next round.

Worth only grows, and rounds end when one discovers nothing, after ROUNDS at most.  All
occurrences of discovered tokens are added as spans.

One pass reads the texts; all that follows works on narrow tables of matches.  The main
path has column expressions alone.  Patterns of base matches are written so that they match
in linear time (possessive loops, and a start only where a run of the same characters starts
or the match before it ended), and find what the plain patterns find.

Defined results: a null text counts as empty; a document without matches has an empty
span list; repeated rows each get theirs; positions are code points, the end exclusive;
the context of a match is the 80 characters before it; of kinds of equal worth the first
counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.common import if_small, saved
from pairlens.llm.spans import locate, quoted

#: Kinds in the order in which they are listed, with their patterns.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: a digit or an at sign somewhere, and the shape of the kind.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]{1,3}([.:][0-9]{1,3}){3}$",
    "card": r"^[0-9]([0-9-]*[0-9])?$",
    "phone": r"^[0-9+(][0-9().-]*[0-9]$",
}
SHAPE_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}
LEAST_TOKEN = 5
ROUNDS = 8
LEAST_SEEDS, PATTERN_CONFIDENCE, TOKEN_CONFIDENCE, MOST_CONFIDENCE = 5, 0.5, 0.7, 0.95
#: Worth is counted in millionths, so that sums don't depend on their order.
UNIT = 1_000_000

#: Checks of a hit x.
VALID = {
    "email": "true",
    "ip": "forall(split(x.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(CAST(right(p, 3) AS INT), 0) <= 255)",
    "card": "length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 14 AND 19 AND luhn_check(regexp_replace(x.hit, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 10 AND 15",
}
_WS = r"\x20\x09-\x0D"
_WORD, _WORDS = (quoted(p) for p in (rf"([^{_WS}]+)[{_WS}]*$", rf"([^{_WS}]+[{_WS}]+[^{_WS}]+)[{_WS}]*$"))
#: The patterns of a context x.tail: two words and one word, told apart, that hold a letter.
_PATTERNS = (
    f"filter(array(concat('2 ', regexp_replace(regexp_extract(lower(x.tail), {_WORDS}, 1), {quoted(f'[{_WS}]+')}, ' ')),"
    f" concat('1 ', regexp_extract(lower(x.tail), {_WORD}, 1))), p -> p RLIKE {quoted(r'\p{L}')})"
)
_KEY = ["doc_id", "h", "h2"]


def _tokens() -> str:
    """SQL for a hit x of TOKEN: marks around it cut off, the kinds of its shape, its patterns."""
    body = "regexp_replace(x.hit, '^[^A-Za-z0-9+(]+', '')"
    token = f"regexp_replace({body}, '[^A-Za-z0-9)]+$', '')"
    shapes = ", ".join(f"CASE WHEN length({token}) >= {LEAST_TOKEN} AND {token} RLIKE {quoted(SHAPES[k])} AND length(regexp_replace({token}, '[^0-9]', '')) >= {SHAPE_DIGITS[k]} THEN {i} END" for i, k in enumerate(KINDS))
    return f"named_struct('start', x.stop - length({body}), 'token', {token}, 'kinds', filter(array({shapes}), k -> k IS NOT NULL), 'patterns', {_PATTERNS})"


def matches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, two text hashes, the valid matches (start, kind, stop, seed, patterns) and the other
    identifier-like tokens (start, token, kinds, patterns)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.xxhash64("text", F.lit(1)).alias("h2"),
        # Every kind of match holds a digit or an at sign.
        F.expr("CASE WHEN text RLIKE '[0-9@]' THEN text ELSE '' END").alias("text"),
    )
    for k, (name, pattern) in enumerate(KINDS.items()):
        rows = locate(rows, pattern, name, keep=VALID[name], out=f"named_struct('start', x.start, 'kind', {k}, 'stop', x.stop, 'seed', xxhash64(x.hit), 'patterns', {_PATTERNS})")
    # What every shape asks for, before the rest is looked at.
    rows = locate(rows, TOKEN, "tokens", keep="x.hit LIKE '%@%' OR length(regexp_replace(x.hit, '[^0-9]+', '')) >= 4", out=_tokens())
    return rows.select(*_KEY, F.concat(*KINDS).alias("base"), F.expr("filter(tokens, t -> size(t.kinds) > 0)").alias("tokens"))


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.stop)), ',')")


def open_tokens(found: DataFrame) -> DataFrame:
    """Tokens that no base match of their text overlaps: doc_id, h, h2, start, stop, token, kinds, patterns."""
    blank = "named_struct('start', b.start, 'stop', b.stop, 'token', CAST(NULL AS STRING), 'kinds', CAST(NULL AS ARRAY<INT>), 'patterns', CAST(NULL AS ARRAY<STRING>))"
    token = "named_struct('start', t.start, 'stop', t.start + length(t.token), 'token', t.token, 'kinds', t.kinds, 'patterns', t.patterns)"
    rows = found.where(F.size("tokens") > 0).select(*_KEY, F.explode(F.expr(f"concat(transform(base, b -> {blank}), transform(tokens, t -> {token}))")).alias("x"))
    # In order of start, with base matches first, only the farthest end before and the next start behind can overlap.
    # Both are running values: a frame that looks ahead would begin anew at each row.
    token = F.col("x.token").isNotNull()
    order = W.partitionBy(*_KEY).orderBy("x.start", token).rowsBetween(W.unboundedPreceding, 0)
    against = W.partitionBy(*_KEY).orderBy(F.col("x.start").desc(), token.desc()).rowsBetween(W.unboundedPreceding, -1)
    base = F.col("x.token").isNull()
    before = F.max(F.when(base, F.col("x.stop"))).over(order)
    behind = F.min(F.when(base, F.col("x.start"))).over(against)
    rows = rows.withColumns({"before": F.coalesce(before, F.lit(-1)), "behind": behind})
    free = F.col("x.token").isNotNull() & (F.col("before") <= F.col("x.start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("x.stop")))
    return rows.where(free).select(*_KEY, "x.*")


def pattern_graph(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pattern, token, kind, own, total): for each kind that a token's shape allows, its patterns with their
    distinct seeds of that kind and all that they introduce, of patterns that introduce LEAST_SEEDS at least."""
    seeds = found.select(F.explode("base").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.kind", "x.seed").distinct()
    counts = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))]
    seeds = seeds.groupBy("pattern").agg(F.count("*").alias("seeds"), *counts)
    links = saved(tokens.select(F.explode("patterns").alias("pattern"), "token", "kinds").distinct(), "pii-links")
    sizes = links.groupBy("pattern").agg(F.count("*").alias("tokens")).join(seeds, "pattern", "left")
    total = F.col("tokens") + F.coalesce("seeds", F.lit(0))
    sizes = sizes.select("pattern", total.alias("total"), *[F.coalesce(f"k{k}", F.lit(0)).alias(f"k{k}") for k in range(len(KINDS))]).where(F.col("total") >= LEAST_SEEDS)
    own = F.element_at(F.array(*[f"k{k}" for k in range(len(KINDS))]), F.col("kind") + 1)
    return links.join(sizes, "pattern").select("*", F.explode("kinds").alias("kind")).select("pattern", "token", "kind", own.alias("own"), "total")


def discovered(edges: DataFrame) -> DataFrame | None:
    """(token, kind, worth in millionths) of the tokens that confident patterns introduce; None if there are none."""
    known, count = None, 0
    for _ in range(ROUNDS):
        worth = F.lit(0) if known is None else F.coalesce("worth", F.lit(0))
        linked = edges if known is None else edges.join(if_small(known, count, 128), ["token", "kind"], "left")
        scored = linked.groupBy("pattern", "kind").agg((F.max("own") * UNIT + F.sum(worth)).alias("support"), F.max("total").alias("total"))
        scored = scored.withColumn("confidence", F.least(F.lit(MOST_CONFIDENCE), F.col("support") / (UNIT * (F.col("total") + 1))))
        sure = saved(scored.where((F.col("support") >= LEAST_SEEDS * UNIT) & (F.col("confidence") >= PATTERN_CONFIDENCE)).select("pattern", "kind", "confidence"), "pii-patterns")
        doubts = F.sum(F.round(-F.log(1 - F.col("confidence")) * UNIT).cast("long"))
        tokens = edges.join(if_small(sure, sure.count(), 192), ["pattern", "kind"]).groupBy("token", "kind").agg(F.round((1 - F.exp(-doubts / UNIT)) * UNIT).cast("long").alias("worth"))
        best = tokens.where(F.col("worth") >= TOKEN_CONFIDENCE * UNIT).groupBy("token").agg(F.max(F.struct("worth", -F.col("kind"))).alias("best"))
        known = saved(best.select("token", (-F.col("best.col2")).cast("int").alias("kind"), "best.worth"), "pii-known")
        before, count = count, known.count()
        if count == before:
            break
    return known if count else None


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base (spans), added (spans), as arrays of (start, kind, stop)."""
    found = saved(matches(docs, id_column, text_column), "pii-matches")
    tokens = saved(open_tokens(found), "pii-open")
    span = "CAST(named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop) AS struct<start:bigint,kind:int,stop:bigint>)"
    rows = found.select(*_KEY, F.expr(f"array_sort(transform(base, x -> {span}))").alias("base"))
    empty = F.expr("CAST(array() AS array<struct<start:bigint,kind:int,stop:bigint>>)")
    known = discovered(saved(pattern_graph(found, tokens), "pii-graph"))
    if known is None:
        return rows.select("doc_id", "base", empty.alias("added"))
    new = tokens.join(if_small(known, known.count(), 128), "token").where("array_contains(kinds, kind)").groupBy(*_KEY).agg(F.collect_set(F.expr(span.replace("x.", ""))).alias("added"))
    same = F.expr("f.doc_id <=> n.doc_id AND f.h = n.h AND f.h2 = n.h2")
    return rows.alias("f").join(new.alias("n"), same, "left").select("f.doc_id", "base", F.coalesce("added", empty).alias("added"))
