"""Session and pipeline reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.functions.text import micros


def series_stats(snapshots: DataFrame, key: str, ts: str, edge: str, order: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """Per series: count, highest and lowest edge with the first time each was reached, means."""
    first_high = F.max(F.struct(F.col(edge).alias("v"), *[(-micros(c) if c == ts else -F.col(c)).alias(f"o{i}") for i, c in enumerate(order)], F.col(ts).alias("t")))
    first_low = F.min(F.struct(F.col(edge).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(ts).alias("t")))
    return (
        snapshots.groupBy(key)
        .agg(F.count("*").alias("n"), first_high.alias("hi"), first_low.alias("lo"), F.avg(edge).alias("avg_edge"), *[F.avg(m).alias(f"avg_{m}") for m in means])
        .select(key, "n", F.col("hi.v").alias("max_edge"), F.col("hi.t").alias("max_edge_time"), F.col("lo.v").alias("min_edge"), F.col("lo.t").alias("min_edge_time"), "avg_edge", *[f"avg_{m}" for m in means])
    )


def running_extremes(snapshots: DataFrame, key: str, edge: str, order: Sequence[str]) -> DataFrame:
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return snapshots.withColumns({"max_so_far": F.max(edge).over(by), "min_so_far": F.min(edge).over(by)})


def live_status(snapshots: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last snapshot of each series with its status."""
    last = snapshots.groupBy(key).agg(F.max_by(F.struct("gross_edge", "net_edge"), F.struct(*order)).alias("x")).select(key, "x.*")
    return last.withColumn("status", F.when(F.col("net_edge") > 0, "ARB").when(F.col("gross_edge") > 0, "EDGE").otherwise("---"))


def session_counts(snapshots: DataFrame, key: str, least_profit: float = 5.0) -> DataFrame:
    """Series with any net edge, any profit, and any budget profit above the threshold."""
    per = snapshots.groupBy(key).agg(F.bool_or(F.col("net_edge") > 0).alias("arb"), (F.max("pnl") > 0).alias("profit"), F.bool_or(F.col("pnl_budget") > least_profit).alias("budget"))
    return per.agg(F.count("*").alias("pairs"), F.count_if("arb").alias("arb_pairs"), F.count_if("profit").alias("profit_pairs"), F.count_if("budget").alias("budget_pairs"))


def best_snapshots(opportunities: DataFrame, tops: DataFrame, at: Column) -> DataFrame:
    """A snapshot for each pair: the opportunity with the highest gross edge, else the plain asks with no profit.

    ``tops``: pair_key, ask_a (yes of A), ask_b (no of B).
    """
    best = opportunities.groupBy("pair_key").agg(F.max_by(F.struct("side_a", "side_b", "ask_a", "ask_b", "gross_edge", "net_profit_1", "pnl_at_budget", "daily_yield_bps"), F.struct("gross_edge", F.col("side_a") == "yes")).alias("x"))
    rows = tops.where("ask_a IS NOT NULL AND ask_b IS NOT NULL").join(best, "pair_key", "left")

    def value(name: str, else_: Column) -> Column:
        return F.when(F.col("x").isNotNull(), F.col(f"x.{name}")).otherwise(else_).alias(name)

    plain = 1 - (F.col("ask_a") + F.col("ask_b"))
    zero = F.lit(0.0)
    return rows.select("pair_key", at.alias("timestamp"), value("side_a", F.lit("yes")), value("side_b", F.lit("no")), value("gross_edge", plain), F.coalesce("x.net_profit_1", zero).alias("net_edge"), F.coalesce("x.pnl_at_budget", zero).alias("pnl_budget"), F.coalesce("x.daily_yield_bps", zero).alias("daily_yield_bps"))


def stage_metrics(samples: DataFrame, stage: str, value: str, failed: Column, uptime_seconds: Column | None = None) -> DataFrame:
    """Per stage: count, errors, sum and extremes; a rate a minute only after a minute."""
    out = samples.groupBy(stage).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.sum(value).alias("total"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out if uptime_seconds is None else out.withColumn("per_minute", F.when(uptime_seconds > 60, F.col("n") / uptime_seconds * 60))


def error_rate(calls: DataFrame, api: str, failed: Column) -> DataFrame:
    counts = calls.groupBy(api).agg(F.count_if(failed).alias("errors"), F.count("*").alias("calls"))
    return counts.withColumn("error_rate", F.coalesce(F.try_divide("errors", "calls"), F.lit(0.0)))


def grouped_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key)


def verdict_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("verdict").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def chart_panels(snapshots: DataFrame) -> DataFrame:
    """The chart's data in tidy form: pair_key, timestamp, panel, series, value."""
    panels = (("edge", "gross_edge"), ("edge", "net_edge"), ("pnl", "pnl_budget"), ("asks", "ask_a"), ("asks", "ask_b"))
    used = [(p, c) for p, c in panels if c in snapshots.columns]
    cells = F.array(*[F.struct(F.lit(p).alias("panel"), F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for p, c in used])
    return snapshots.select("pair_key", "timestamp", F.explode(cells).alias("x")).select("pair_key", "timestamp", "x.*")


def recent(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def pipeline_counters(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of the ten counters of a run.

    ``events``: duplicate, failed (boolean), candidates (null before retrieval); ``pairs``:
    verdict, persisted (boolean).  Null flags count as false; a failed event isn't processed.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    done = ~flag("duplicate") & ~flag("failed") & F.col("candidates").isNotNull()
    of_events = events.agg(
        F.count("*").alias("events_received"),
        F.count_if(flag("duplicate")).alias("events_deduplicated"),
        F.count_if(done).alias("events_processed"),
        F.count_if(flag("failed")).alias("events_failed"),
        F.count_if(done & (F.col("candidates") == 0)).alias("events_no_candidates"),
    )
    verdicts = [F.count_if(F.col("verdict") == v).alias(f"pairs_{v}") for v in ("equivalent", "needs_review", "not_equivalent")]
    of_pairs = pairs.agg(F.count("*").alias("pairs_found"), *verdicts, F.count_if(flag("persisted")).alias("pairs_persisted"))
    # Both sides are one row.
    return of_events.join(F.broadcast(of_pairs))


def cache_stats(lookups: DataFrame, key: str) -> DataFrame:
    """What a cache without a bound would do: the first lookup of a key misses, later ones hit."""
    per = lookups.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    both = per.agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("hits"), F.count("*").alias("misses"))
    return both.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def opportunity_lines(ranked: DataFrame, width: int = 40) -> DataFrame:
    """A line of text for each ranked opportunity: section, pair, sides, asks, edge, profit, yield; for a console."""
    money = lambda c: F.coalesce(F.format_number(c, 2), F.lit("N/A"))
    ask = lambda c: F.coalesce(F.format_number(c, 4), F.lit("N/A"))
    label = F.when(F.length("pair_key") > width, F.concat(F.substring("pair_key", 1, width - 3), F.lit("..."))).otherwise(F.col("pair_key"))
    parts = (
        F.rpad("section", 10, " "),
        F.rpad(label, width, " "),
        F.concat(F.lit("A "), F.rpad("side_a", 3, " "), F.lit(" "), ask("ask_a")),
        F.concat(F.lit("B "), F.rpad("side_b", 3, " "), F.lit(" "), ask("ask_b")),
        F.concat(F.lit("edge "), ask("gross_edge")),
        F.concat(F.lit("net "), ask("net_profit_1")),
        F.concat(F.lit("at budget "), money("pnl_at_budget")),
        F.concat(F.lit("bps a day "), money("daily_yield_bps")),
        F.concat(F.lit("days "), F.coalesce(F.col("days_to_resolution").cast("string"), F.lit("N/A"))),
    )
    return ranked.select("pair_key", "side_a", "side_b", F.concat_ws("  ", *parts).alias("line"))
