"""Orderbook depth, profit curves, capital ladders and ranked opportunities.

Books are worked on in long form: one row per level.  Cumulative schedules are windows in
order of price.  A quantity lies in exactly one segment of a schedule.  Both schedules of a
key are folded into lists (as long as a book is deep) that keep the windows' partitioning,
so curves and ladders read each book once and need no further shuffle; quantities of another
table meet schedules by an equality join and a range condition.  Money is turned into
quantity exactly: total outlay is piecewise linear between the knots of both books.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.functions import fees

EPS = 1e-9


def schedule(asks: DataFrame, keys: Sequence[str], rate: Column | None = None) -> DataFrame:
    """Segments of each book: quantity, cost and fee before and after each level."""
    order = W.partitionBy(*keys).orderBy("price", "size").rowsBetween(W.unboundedPreceding, 0)
    fee = fees.entry_fee(F.col("size"), F.col("price"), rate) if rate is not None else F.lit(0.0)
    parts = {"qty": F.col("size"), "cost": F.col("price") * F.col("size"), "fee": fee}
    rows = asks.where("size > 0").withColumns({f"_{k}": v for k, v in parts.items()})
    rows = rows.withColumns({f"cum_{k}": F.sum(f"_{k}").over(order) for k in parts})
    step = W.partitionBy(*keys).orderBy("price", "size")
    rows = rows.withColumns({f"prev_{k}": F.lag(f"cum_{k}", 1, 0.0).over(step) for k in parts})
    return rows.drop(*[f"_{k}" for k in parts])


def interpolated(points: DataFrame, segments: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """``points`` (keys, q) with the cost and fee of q contracts, as <prefix>_cost and <prefix>_fee."""
    s = segments.select(*keys, *[f"{a}_{b}" for a in ("prev", "cum") for b in ("qty", "cost", "fee")])
    share = (F.col("q") - F.col("prev_qty")) / (F.col("cum_qty") - F.col("prev_qty"))
    joined = points.join(s, list(keys)).where("q > prev_qty AND q <= cum_qty")
    values = {f"{prefix}_{k}": F.col(f"prev_{k}") + share * (F.col(f"cum_{k}") - F.col(f"prev_{k}")) for k in ("cost", "fee")}
    return joined.select(*points.columns, *[v.alias(k) for k, v in values.items()])


_SEGMENT = ("prev_qty", "cum_qty", "prev_cost", "cum_cost", "prev_fee", "cum_fee")


def folded(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both schedules of each key as lists a and b, and the quantity that both can fill."""
    lists = [s.groupBy(*keys).agg(F.collect_list(F.struct(*_SEGMENT)).alias(n), F.max("cum_qty").alias(f"_{n}")) for s, n in ((a, "a"), (b, "b"))]
    return lists[0].join(lists[1], list(keys)).select(*keys, "a", "b", F.least("_a", "_b").alias("max_qty"))


def priced(rows: DataFrame) -> DataFrame:
    """``rows`` (a, b: the segments that hold q, and others) with the cost and fee of q contracts in place of the segments."""

    def value(name: str, what: str) -> Column:
        s = F.col(name)
        share = (F.col("q") - s["prev_qty"]) / (s["cum_qty"] - s["prev_qty"])
        return (s[f"prev_{what}"] + share * (s[f"cum_{what}"] - s[f"prev_{what}"])).alias(f"{name}_{what}")

    return rows.select(*[c for c in rows.columns if c not in ("a", "b")], *[value(n, w) for n in "ab" for w in ("cost", "fee")])


def valued(points: DataFrame) -> DataFrame:
    """``points`` (a, b, q and others) with the cost and fee of q contracts of both sides in place of the lists."""

    def segment(name: str) -> Column:
        return F.get(F.filter(name, lambda s: (F.col("q") > s["prev_qty"]) & (F.col("q") <= s["cum_qty"])), F.lit(0)).alias(name)

    return priced(points.select(*[c for c in points.columns if c not in ("a", "b")], segment("a"), segment("b")))


def outcome(points: DataFrame, digits: tuple[int, int, int] = (2, 4, 2)) -> DataFrame:
    """Profit and return of holding q of both sides: one of them pays 1 per contract."""
    outlay = F.col("a_cost") + F.col("b_cost") + F.col("a_fee") + F.col("b_fee")
    profit = F.col("q") - outlay
    kept = [c for c in points.columns if c not in ("a_cost", "a_fee", "b_cost", "b_fee")]
    return points.select(
        *kept,
        F.round("q", digits[0]).alias("quantity"),
        F.round(outlay, digits[1]).alias("total_cost"),
        F.round(profit, digits[1]).alias("guaranteed_profit"),
        F.round(F.when(outlay > 0, profit / outlay * 100).otherwise(0.0), digits[2]).alias("roi_pct"),
    )


def pnl_curve(a: DataFrame, b: DataFrame, keys: Sequence[str], settings: Settings = Settings(), digits: tuple[int, int, int] = (2, 4, 2)) -> DataFrame:
    """Profit at evenly spaced quantities up to what both books can fill (keys, step, ...)."""
    points = folded(a, b, keys).where("max_qty > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(settings.curve_steps))))
    points = points.select(*keys, "a", "b", "step", (F.col("max_qty") * F.col("step") / settings.curve_steps).alias("q"))
    return outcome(valued(points), digits).drop("q")


def optimal_size(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first point of the curve with the highest profit; zeros if none is positive."""
    best = curve.groupBy(*keys).agg(F.max(F.struct("guaranteed_profit", -F.col("step"), "quantity", "total_cost", "roi_pct")).alias("best"))
    gain = F.col("best.guaranteed_profit") > 0

    def value(name: str) -> Column:
        return F.when(gain, F.col(f"best.{name}")).otherwise(0.0)

    return best.select(*keys, value("quantity").alias("optimal_qty"), value("guaranteed_profit").alias("max_profit"), value("total_cost").alias("optimal_capital"), value("roi_pct").alias("optimal_roi_pct"))


def diminishing_returns(curve: DataFrame, keys: Sequence[str], shares: tuple[int, ...] = (50, 80, 95)) -> DataFrame:
    """The first quantity of the curve that reaches each share of its highest profit."""
    top = F.max("guaranteed_profit").over(W.partitionBy(*keys))
    rows = curve.withColumn("top", top).where("top > 0")
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("guaranteed_profit") >= F.col("top") * (s / 100), F.col("quantity"))).alias(f"qty_{s}") for s in shares])


def outlay_segments(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total outlay between neighbouring knots of both books: q0, q1, out0, out1 and the key's max_out.

    Both schedules are read once, from the deepest knot down: the segment of a side that holds a
    knot is the last one of that side whose end has been met.
    """
    ends = [s.where("cum_qty > prev_qty").select(*keys, F.col("cum_qty").alias("q"), F.struct(*_SEGMENT).alias(n)) for s, n in ((a, "a"), (b, "b"))]
    down = W.partitionBy(*keys).orderBy(F.col("q").desc())
    met = down.rangeBetween(W.unboundedPreceding, W.currentRow)
    both = ends[0].unionByName(ends[1], allowMissingColumns=True).withColumns({n: F.last(n, ignorenulls=True).over(met) for n in "ab"})
    out = F.col("a_cost") + F.col("b_cost") + F.col("a_fee") + F.col("b_fee")
    knots = priced(both.where("a IS NOT NULL AND b IS NOT NULL")).select(*keys, F.col("q").alias("q1"), out.alias("out1"))
    down = W.partitionBy(*keys).orderBy(F.col("q1").desc())
    before = {"q0": F.lead("q1", 1, 0.0).over(down), "out0": F.lead("out1", 1, 0.0).over(down)}
    # An end of both books comes twice, once with nothing between.
    return knots.withColumns({**before, "max_out": F.first("out1").over(down)}).where("q1 > q0")


def _bought(segments: DataFrame, capital: Column) -> DataFrame:
    """The segment in which the capital ends, with the quantity that it buys as q."""
    share = (F.col("capital") - F.col("out0")) / (F.col("out1") - F.col("out0"))
    found = segments.withColumn("capital", capital).where("capital > out0 AND capital <= out1")
    return found.withColumn("q", F.col("q0") + share * (F.col("q1") - F.col("q0")))


def budget_point(a: DataFrame, b: DataFrame, keys: Sequence[str], capital: float, digits: tuple[int, int, int] = (2, 4, 4)) -> DataFrame:
    """Profit of spending ``capital``, or all that the depth takes; keys that buy less than half a contract go."""
    segments = outlay_segments(a, b, keys)
    found = _bought(segments, F.least(F.lit(float(capital)), F.col("max_out"))).where("q >= 0.5")
    profit = F.col("q") - F.col("capital")
    return found.select(
        *keys,
        F.round("capital", digits[0]).alias("capital"),
        F.round("q", digits[0]).alias("quantity"),
        F.round(profit, digits[1]).alias("guaranteed_profit"),
        F.round(profit / F.col("capital") * 100, digits[2]).alias("roi_pct"),
    )


def capital_ladder(a: DataFrame, b: DataFrame, keys: Sequence[str], settings: Settings = Settings(), digits: int = 2) -> DataFrame:
    """Rungs of rising capital (keys, rung, ...), up to the rung at which profit has failed to rise
    ``ladder_declines`` times in a row, or ``ladder_rungs``."""
    step, declines = settings.ladder_step, settings.ladder_declines
    segments = outlay_segments(a, b, keys)
    rungs = F.least(F.floor((F.col("max_out") + EPS) / step), F.lit(settings.ladder_rungs)).cast("int")
    tops = segments.groupBy(*keys).agg(F.max("max_out").alias("max_out")).withColumn("rungs", rungs).where("rungs > 0")
    wanted = tops.select(*keys, F.explode(F.sequence(F.lit(1), F.col("rungs"))).alias("rung"))
    joined = segments.join(wanted, list(keys))
    found = _bought(joined, F.least(F.col("rung") * F.lit(step), F.col("max_out")))
    profit = F.round(F.col("q") - F.col("capital"), 4)
    rows = found.select(*keys, "rung", F.round(F.col("rung") * F.lit(step), 2).alias("capital"), "q", profit.alias("p"), F.col("capital").alias("spent"))
    order = W.partitionBy(*keys).orderBy("rung")
    before = F.max("p").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("rises", F.coalesce(F.col("p") > before, F.lit(True)))
    last_rise = F.max(F.when(F.col("rises"), F.col("rung"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("falls", F.col("rung") - last_rise)
    ended = F.coalesce(F.max(F.when(F.col("falls") >= declines, 1)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("ended", ended).where("ended = 0")
    return rows.select(*keys, "rung", "capital", F.round("q", digits).alias("quantity"), F.round("p", digits).alias("guaranteed_profit"), F.round(F.col("p") / F.col("spent") * 100, digits).alias("roi_pct"))


def tops(books: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best ask of each outcome and the depth behind it: (keys, yes_ask, no_ask, yes_depth, no_depth)."""
    ask = lambda o: F.min(F.when(F.col("outcome") == o, F.col("price")))
    depth = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("size"))), F.lit(0.0))
    return books.groupBy(*keys).agg(ask("yes").alias("yes_ask"), ask("no").alias("no_ask"), depth("yes").alias("yes_depth"), depth("no").alias("no_depth"))


#: (side bought on A, side bought on B) of the two directions, by whether the mapping crosses.
DIRECTIONS = {False: (("yes", "no"), ("no", "yes")), True: (("yes", "yes"), ("no", "no"))}


def opportunities(pairs: DataFrame, books: DataFrame, as_of: Column, settings: Settings = Settings()) -> DataFrame:
    """Both directions of each pair with edge, curve optimum, budget profit and yield.

    ``pairs``: pair_key, venue_a, vmid_a, venue_b, vmid_b, inverted, date_a, date_b;
    ``books``: venue, vmid, outcome, price, size (asks).  Pairs with a missing or
    unbelievable book, an empty side or a gross edge below -0.10 give no row.
    """
    top = tops(books, ["venue", "vmid"]).where(fees.book_sane(F.col("yes_ask"), F.col("no_ask"), settings))
    a, b = (top.select(*[F.col(c).alias(f"{c}_{s}") for c in top.columns]) for s in "ab")
    both = pairs.join(a, ["venue_a", "vmid_a"]).join(b, ["venue_b", "vmid_b"])
    sides = F.when(F.col("inverted"), F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in DIRECTIONS[True]]))
    sides = sides.otherwise(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in DIRECTIONS[False]]))
    rows = both.withColumn("side", F.explode(sides)).withColumns({"side_a": F.col("side.a"), "side_b": F.col("side.b")}).drop("side")
    rows = rows.withColumns({f"ask_{s}": F.when(F.col(f"side_{s}") == "yes", F.col(f"yes_ask_{s}")).otherwise(F.col(f"no_ask_{s}")) for s in "ab"})
    rows = rows.where("ask_a IS NOT NULL AND ask_b IS NOT NULL").withColumn("gross_edge", F.round(1 - (F.col("ask_a") + F.col("ask_b")), 4)).where("gross_edge >= -0.10")
    fee = fees.entry_fee(F.lit(1.0), F.col("ask_a"), fees.fee_rate(F.col("venue_a"))) + fees.entry_fee(F.lit(1.0), F.col("ask_b"), fees.fee_rate(F.col("venue_b")))
    rows = rows.withColumn("net_profit_1", F.round(1 - (F.col("ask_a") + F.col("ask_b")) - fee, 4))

    keys = ["pair_key", "side_a", "side_b"]
    sched = []
    for s in "ab":
        wanted = rows.select(*keys, F.col(f"venue_{s}").alias("venue"), F.col(f"vmid_{s}").alias("vmid"), F.col(f"side_{s}").alias("outcome"))
        sched.append(schedule(wanted.join(books, ["venue", "vmid", "outcome"]), keys, fees.fee_rate(F.col("venue"))))
    best = optimal_size(pnl_curve(*sched, keys, settings), keys)
    budget = budget_point(*sched, keys, settings.budget).select(*keys, F.col("guaranteed_profit").alias("pnl_at_budget"))
    days = fees.days_to_resolution(F.col("date_a"), F.col("date_b"), as_of)
    pnl = F.coalesce("pnl_at_budget", F.lit(0.0))
    return (
        rows.join(best, keys, "left")
        .join(budget, keys, "left")
        .withColumn("days_to_resolution", days)
        .select(
            *keys,
            "venue_a",
            "vmid_a",
            "venue_b",
            "vmid_b",
            "ask_a",
            "ask_b",
            F.round(F.col("ask_a") + F.col("ask_b"), 4).alias("total_cost_1"),
            "gross_edge",
            "net_profit_1",
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("optimal_qty", "max_profit", "optimal_capital", "optimal_roi_pct")],
            "days_to_resolution",
            F.round(pnl, 2).alias("pnl_at_budget"),
            F.round(fees.daily_yield_bps(pnl, F.col("days_to_resolution"), settings), 4).alias("daily_yield_bps"),
            F.round(fees.annual_roi_pct(pnl, F.col("days_to_resolution"), settings), 2).alias("annualized_roi_pct"),
        )
    )


def ranked(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Positive opportunities: actionable before dust, each by daily yield."""
    rows = found.where("net_profit_1 > 0").withColumn("section", F.when(F.col("pnl_at_budget") >= settings.least_profit, "actionable").otherwise("dust"))
    return rows.orderBy("section", F.col("daily_yield_bps").desc(), "pair_key", "side_a", "side_b")


def near_misses(found: DataFrame, n: int = 5) -> DataFrame:
    return found.where("net_profit_1 <= 0 AND gross_edge > -0.03").orderBy(F.col("gross_edge").desc(), "pair_key", "side_a", "side_b").limit(n)


def portfolio(found: DataFrame) -> DataFrame:
    gains = found.where("net_profit_1 > 0")
    soon = F.col("days_to_resolution") <= 30
    return gains.agg(
        F.count("*").alias("opportunities"),
        F.sum("max_profit").alias("profit"),
        F.sum("optimal_capital").alias("capital"),
        F.sum(F.when(soon, F.col("optimal_capital")).otherwise(0.0)).alias("recyclable_capital"),
        F.min("days_to_resolution").alias("first_days"),
        F.max("days_to_resolution").alias("last_days"),
    )
