"""Parsers of venue payloads: raw JSON text in, rows of the logical tables out.

A payload that can't be read gives no row; nothing raises.  Connections, signatures and
rate limits belong to the ingest job that lands payloads as files or a topic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import fees
from pairlens.functions.text import micros, parse_timestamp
from pairlens.schemas import LEVEL, OUTCOME

YES_NO = f"CAST(array(named_struct('outcome_id', 'YES', 'label', 'Yes'), named_struct('outcome_id', 'NO', 'label', 'No')) AS array<{OUTCOME}>)"
_EVENT = ("venue", "venue_market_id", "event_type", "title", "description", "resolution_criteria", "end_date", "outcomes", "raw_payload", "received_at")


def _j(path: str, of: str = "payload") -> Column:
    return F.get_json_object(of, f"$.{path}")


def _or(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _events(rows: DataFrame, venue: str, **columns: Column) -> DataFrame:
    filled = {"venue": F.lit(venue), "raw_payload": F.col("payload"), "received_at": F.col("received_at"), **columns}
    return rows.select(*[filled[c].alias(c) for c in _EVENT])


def kalshi_listing(pages: DataFrame, max_markets: int = 0) -> DataFrame:
    """Markets of listing pages (payload, received_at): open ones, no multi-game parlays."""
    m = "array<struct<ticker:string,status:string,title:string,subtitle:string,rules_primary:string,rules_secondary:string,close_time:string,expiration_time:string,expected_expiration_time:string>>"
    rows = pages.withColumn("m", F.explode(F.from_json(_j("markets"), m))).withColumn("payload", F.to_json("m"))
    kept = rows.where(F.lower("m.status").isin("active", "open") & (F.col("m.ticker") != "") & ~F.upper("m.ticker").contains("MULTIGAME"))
    found = _events(
        kept,
        "kalshi",
        venue_market_id=F.col("m.ticker"),
        event_type=F.lit("updated"),
        title=_or(F.col("m.title"), F.col("m.subtitle"), F.col("m.ticker")),
        description=_or(F.col("m.rules_primary"), F.col("m.rules_secondary")),
        resolution_criteria=F.col("m.rules_primary"),
        end_date=F.coalesce(*[parse_timestamp(F.col(f"m.{c}")) for c in ("close_time", "expiration_time", "expected_expiration_time")]),
        outcomes=F.expr(YES_NO),
    )
    return found.limit(max_markets) if max_markets else found


def kalshi_messages(messages: DataFrame) -> DataFrame:
    """Lifecycle messages (payload, received_at); acknowledgements, errors and other types give nothing."""
    kind, what = _j("type"), F.lower(F.coalesce(_j("msg.event_type"), F.lit("")))
    market = (kind == "market_lifecycle_v2") & (F.coalesce(_j("msg.market_ticker"), F.lit("")) != "") & ~F.upper(_j("msg.market_ticker")).contains("MULTIGAME") & ~what.isin("deactivated", "determined", "settled")
    event = (kind == "event_lifecycle") & (F.coalesce(_j("msg.event_ticker"), F.lit("")) != "")

    def either(a: Column, b: Column) -> Column:
        return F.when(kind == "market_lifecycle_v2", a).otherwise(b)

    meta = "msg.additional_metadata."
    return _events(
        messages.where(market | event),
        "kalshi",
        venue_market_id=either(_j("msg.market_ticker"), _j("msg.event_ticker")),
        event_type=either(F.when(what == "created", "created").otherwise("updated"), F.lit("created")),
        title=either(_or(_j(meta + "title"), _j(meta + "name"), _j("msg.market_ticker")), _or(_j("msg.title"), _j("msg.subtitle"), _j("msg.event_ticker"))),
        description=either(_or(_j(meta + "rules_primary"), _j(meta + "rules_secondary")), _j("msg.subtitle")),
        resolution_criteria=either(_j(meta + "rules_primary"), F.lit(None).cast("string")),
        end_date=either(F.timestamp_seconds(_j("msg.close_ts").try_cast("bigint")), F.lit(None).cast("timestamp")),
        outcomes=F.expr(YES_NO),
    )


def listed_outcomes(names: Column, tokens: Column) -> Column:
    """Labels with their tokens; both may be lists or lists written as text; a missing token is empty."""
    n, t = (F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in (names, tokens))
    return F.transform(n, lambda x, i: F.struct(F.coalesce(F.get(t, i), F.lit("")).alias("outcome_id"), x.alias("label")))


def polymarket_listing(pages: DataFrame, max_markets: int = 0) -> DataFrame:
    """Markets of listing pages (payload: a list, or an object with data): active, not closed, with id and question."""
    items = F.coalesce(F.from_json("payload", "array<string>"), F.from_json(_j("data"), "array<string>"))
    rows = pages.withColumn("payload", F.explode(items))
    open_ = (F.coalesce(F.lower(_j("closed")), F.lit("")) != "true") & F.lower(_j("active")).isin("true", "1")
    id_ = _or(_j("condition_id"), _j("id"))
    found = _events(
        rows.where(open_ & id_.isNotNull() & (F.coalesce(_j("question"), F.lit("")) != "")),
        "polymarket",
        venue_market_id=id_,
        event_type=F.lit("updated"),
        title=_j("question"),
        description=_j("description"),
        resolution_criteria=_j("resolutionSource"),
        end_date=parse_timestamp(_or(_j("endDate"), _j("end_date_iso"))),
        outcomes=listed_outcomes(_j("outcomes"), _j("clobTokenIds")),
    )
    return found.limit(max_markets) if max_markets else found


def polymarket_messages(messages: DataFrame, prices: bool = True) -> DataFrame:
    """Market messages and, unless left out, price updates as rows without a title.

    ``created`` marks markets that are neither resolved nor closed; a batch or stream that
    has seen the market before calls it an update (see :func:`first_created`).
    """
    kind = _j("type")
    price = kind.isin("orderbook", "price") & _or(_j("market"), _j("market_id"), _j("condition_id")).isNotNull()
    market = (kind == "market") & _j("data").isNotNull()
    named = F.from_json(_j("data.outcomes"), "array<struct<token:string,name:string>>")
    labels = F.transform(F.coalesce(named, F.expr("CAST(array() AS array<struct<token:string,name:string>>)")), lambda o: F.struct(F.coalesce(o["token"], F.lit("")).alias("outcome_id"), F.coalesce(o["name"], F.lit("")).alias("label")))
    is_market = kind == "market"
    status = F.coalesce(_j("data.status"), F.lit(""))

    def only(c: Column) -> Column:
        return F.when(is_market, c)

    return _events(
        messages.where((market | price) if prices else market),
        "polymarket",
        venue_market_id=F.when(is_market, F.coalesce(_j("data.id"), F.lit(""))).otherwise(_or(_j("market"), _j("market_id"), _j("condition_id"))),
        event_type=F.when(~is_market, "updated").when(status == "resolved", "resolved").when(status == "closed", "closed").otherwise("created"),
        title=F.when(is_market, F.coalesce(_j("data.question"), F.lit(""))).otherwise(""),
        description=only(_j("data.description")),
        resolution_criteria=only(_j("data.resolutionSource")),
        end_date=only(parse_timestamp(_j("data.endDate"))),
        outcomes=F.when(is_market, labels).otherwise(F.expr(f"CAST(array() AS array<{OUTCOME}>)")),
    )


def first_created(events: DataFrame) -> DataFrame:
    """Of the rows that call a market created, the first one does and later ones are updates."""
    from pyspark.sql import Window as W

    order = W.partitionBy("venue_market_id", F.col("event_type") == "created").orderBy("received_at")
    again = (F.col("event_type") == "created") & (F.row_number().over(order) > 1)
    return events.withColumn("event_type", F.when(again, "updated").otherwise(F.col("event_type")))


def kalshi_top(payloads: DataFrame) -> DataFrame:
    """Top of book of market endpoint payloads, cents to dollars; a missing No price follows from the other Yes price."""
    def cents(name: str) -> Column:
        return _j(f"market.{name}").try_cast("int") / 100.0

    yes_bid, yes_ask = cents("yes_bid"), cents("yes_ask")
    rows = payloads.where(yes_bid.isNotNull() | yes_ask.isNotNull())
    return rows.select(
        *[c for c in payloads.columns if c != "payload"],
        yes_bid.alias("yes_bid"),
        yes_ask.alias("yes_ask"),
        F.coalesce(cents("no_bid"), F.round(1 - yes_ask, 4)).alias("no_bid"),
        F.coalesce(cents("no_ask"), F.round(1 - yes_bid, 4)).alias("no_ask"),
        F.coalesce(_j("market.volume").try_cast("double"), F.lit(0.0)).alias("volume"),
        parse_timestamp(_or(_j("market.close_time"), _j("market.expiration_time"))).alias("close_time"),
    )


_EMPTY_LEVELS = f"CAST(array() AS array<{LEVEL}>)"


def kalshi_book(rows: DataFrame) -> DataFrame:
    """Books from (payload, yes_bid, yes_ask, no_bid, no_ask, volume, close_time): depth turned from
    bids into asks if it agrees with the top of book, else one assumed level a side."""
    raw = "array<array<double>>"
    yes, no = (fees.levels(F.coalesce(F.from_json(_j(f"orderbook.{o}"), raw), F.array().cast(raw)), 100.0) for o in ("yes", "no"))
    rows = rows.withColumns({"_yes": yes, "_no": no})
    rows = rows.withColumns({"_yes_asks": fees.inverted_asks(F.col("_no")), "_no_asks": fees.inverted_asks(F.col("_yes"))})

    def first(c: str) -> Column:
        return F.get(c, F.lit(0))["price"]

    deep = (F.size("_yes") + F.size("_no") > 0) & fees.agrees_with_top(first("_yes_asks"), F.col("yes_ask")) & fees.agrees_with_top(first("_no_asks"), F.col("no_ask"))

    def single(top: str) -> Column:
        level = F.array(F.struct(F.col(top).alias("price"), fees.top_depth(F.col("volume")).alias("size")))
        return F.when(F.coalesce(F.col(top), F.lit(0.0)) != 0, level).otherwise(F.expr(_EMPTY_LEVELS))

    chosen = {"yes_asks": (F.col("_yes_asks"), "yes_ask"), "yes_bids": (F.reverse("_yes"), "yes_bid"), "no_asks": (F.col("_no_asks"), "no_ask"), "no_bids": (F.reverse("_no"), "no_bid")}
    out = rows.withColumns({k: F.when(deep, d).otherwise(single(t)) for k, (d, t) in chosen.items()} | {"source": F.when(deep, "orderbook").otherwise("top_of_book")})
    return out.drop("_yes", "_no", "_yes_asks", "_no_asks", "payload")


def gamma_market(payloads: DataFrame) -> DataFrame:
    """Tokens, prices (those that are numbers) and end date of market payloads."""
    tokens, prices = (F.coalesce(F.from_json(_j(c), "array<string>"), F.array().cast("array<string>")) for c in ("clobTokenIds", "outcomePrices"))
    numbers = F.filter(F.transform(prices, lambda p: p.try_cast("double")), lambda p: p.isNotNull())
    return payloads.select(
        *[c for c in payloads.columns if c != "payload"],
        F.get(tokens, F.lit(0)).alias("yes_token"),
        F.get(tokens, F.lit(1)).alias("no_token"),
        F.when(F.size(numbers) > 0, numbers).alias("prices"),
        parse_timestamp(_or(_j("endDate"), _j("end_date_iso"))).alias("end_date"),
    )


def clob_levels(side: str, descending: bool) -> Column:
    """Levels of one side of a book payload, best first."""
    entries = F.coalesce(F.from_json(_j(side), "array<struct<price:string,size:string>>"), F.expr("CAST(array() AS array<struct<price:string,size:string>>)"))
    pairs = F.transform(entries, lambda e: F.array(e["price"].try_cast("double"), e["size"].try_cast("double")))
    return fees.levels(pairs, descending=descending)


def polymarket_book(rows: DataFrame) -> DataFrame:
    """Books from (yes_bids, yes_asks, no_bids, no_asks, prices): depth, else the mid price at size 100,
    else the other outcome's bids turned round; rows that end without any ask go."""
    e = F.expr(_EMPTY_LEVELS)
    has = lambda c: F.size(c) > 0
    deep = has("yes_asks") | has("no_asks")

    def mid(i: int) -> Column:
        p = F.get("prices", F.lit(i))
        return F.when((p > 0) & (p < 1), F.array(F.struct(p.alias("price"), F.lit(100.0).alias("size")))).otherwise(e)

    rows = rows.withColumn("source", F.when(deep, "orderbook").otherwise("gamma_mid"))
    for side, i in (("yes", 0), ("no", 1)):
        asks, bids = f"{side}_asks", f"{side}_bids"
        use = ~has(asks) & (F.size(mid(i)) > 0)
        if side == "yes":  # a mid price on the Yes side names the source, on the No side only without depth
            rows = rows.withColumn("source", F.when(use, "gamma_mid").otherwise(F.col("source")))
        rows = rows.withColumns({bids: F.when(use, mid(i)).when(has(asks), F.col(bids)).otherwise(e), asks: F.when(use, mid(i)).otherwise(F.col(asks))})
    for side, other in (("no", "yes"), ("yes", "no")):
        use = ~has(f"{side}_asks") & has(f"{other}_bids")
        source = F.when(use & (F.col("source") == "orderbook"), "orderbook_partial").otherwise(F.col("source"))
        rows = rows.withColumns({"source": source, f"{side}_asks": F.when(use, fees.inverted_asks(F.col(f"{other}_bids"))).otherwise(F.col(f"{side}_asks"))})
    return rows.where(has("yes_asks") | has("no_asks"))


def exploded(books: DataFrame) -> DataFrame:
    """Books in long form: venue, vmid, outcome, side, price, size."""

    def side(outcome: str, kind: str) -> Column:
        return F.transform(f"{outcome}_{kind}s", lambda x: F.struct(F.lit(outcome).alias("outcome"), F.lit(kind).alias("side"), x["price"].alias("price"), x["size"].alias("size")))

    sides = [side(o, k) for o in ("yes", "no") for k in ("ask", "bid")]
    return books.select("venue", F.col("venue_market_id").alias("vmid"), F.explode(F.concat(*sides)).alias("x")).select("venue", "vmid", "x.*")


def resolve_market(markets: DataFrame, slug: str) -> DataFrame:
    """(market_id, yes_token, no_token) of the market with exactly that slug."""
    rows = markets.where(_j("slug") == slug)
    return gamma_market(rows.withColumn("market_id", _or(_j("condition_id"), _j("conditionId"), _j("id")))).select("market_id", "yes_token", "no_token")


def game_state(messages: DataFrame, slug: str | None = None) -> DataFrame:
    fields = {"game_id": "gameId", "league": "leagueAbbreviation", "slug": "slug", "status": "status", "score": "score", "period": "period"}
    rows = messages.select(*[c for c in messages.columns if c != "payload"], *[_j(p).alias(n) for n, p in fields.items()], F.coalesce(_j("live").try_cast("boolean"), F.lit(False)).alias("live"))
    return rows.where(F.col("slug") == slug) if slug else rows


def series_games(markets: DataFrame, title: str = "title", most: int = 5) -> DataFrame:
    """The first market of each game number in a series."""
    number = F.regexp_extract(title, r"(?i)game\s+(\d+)", 1).try_cast("int")
    rows = markets.withColumn("game_number", number).where(F.col("game_number").between(1, most))
    return rows.groupBy("game_number").agg(F.min_by(F.struct("market_id", title), "market_id").alias("m")).select("game_number", "m.*", F.lit("scheduled").alias("status")).orderBy("game_number")


def series_status(games: DataFrame, period: Column, status: Column) -> DataFrame:
    """Games before the current one are completed, it has the feed's status, later ones are scheduled."""
    now = F.regexp_extract(period, r"^(\d+)/(\d+)", 1).try_cast("int")
    found = F.when(now.isNull(), F.col("status")).when(F.col("game_number") == now, F.coalesce(F.lower(status), F.lit("unknown"))).when(F.col("game_number") < now, "completed").otherwise("scheduled")
    return games.withColumns({"status": found, "is_current": F.coalesce(F.col("game_number") == now, F.lit(False))})


#: Event types of a match timeline that move prices.
SIGNIFICANT = ("CHAMPION_KILL", "BUILDING_KILL", "ELITE_MONSTER_KILL", "DRAGON_KILL", "BARON_KILL", "INHIBITOR_KILL")


def timeline_events(timelines: DataFrame) -> DataFrame:
    """Significant events of match timelines (payload, match_id, game_start), each once; times are offsets from the start."""
    frames = F.from_json(_j("info.frames"), "array<struct<events:array<struct<type:string,timestamp:bigint,killerId:string,victimId:string>>>>")
    rows = timelines.select("match_id", "game_start", F.explode(F.flatten(F.transform(frames, lambda f: f["events"]))).alias("e")).where(F.col("e.type").isin(*SIGNIFICANT))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    event_id = F.concat_ws("-", "match_id", F.col("e.timestamp").cast("string"), "e.type", blank("e.killerId"), blank("e.victimId"))
    at = F.timestamp_micros(micros("game_start") + F.col("e.timestamp") * 1000)
    return rows.select(event_id.alias("event_id"), F.col("e.type").alias("event_type"), at.alias("event_timestamp"), "match_id").dropDuplicates(["event_id"])


def fetched(responses: DataFrame) -> DataFrame:
    """Responses (status, body) with their outcome: found, absent (404), limited (429, to be asked again) or failed."""
    status = F.col("status")
    outcome = F.when(status.between(200, 299), "found").when(status == 404, "absent").when(status == 429, "limited").otherwise("failed")
    return responses.withColumns({"outcome": outcome, "body": F.when(outcome == "found", F.col("body"))})


#: Parsers by venue; add a venue by registering its own.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"kalshi": kalshi_messages, "polymarket": polymarket_messages}


def register_venue(venue: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[venue] = parser


def venue_events(venue: str, messages: DataFrame) -> DataFrame:
    if venue not in PARSERS:
        raise ValueError(f"unknown venue {venue!r}; known are {sorted(PARSERS)}")
    return PARSERS[venue](messages)


def subscription(venue: str, tickers: list[str] | None = None) -> dict:
    """Options of a subscription, for the ingest job."""
    channels = {"kalshi": ["market_lifecycle_v2", "event_lifecycle"], "polymarket": ["market"]}
    return {"venue": venue, "channels": channels.get(venue, []), "markets": tickers or []}
