"""Order-flow summaries and factor columns. Names follow the 50-column contract; the
formulas are published microstructure definitions of our choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import imbalance

#: The contract's names, in order: 21 market, 7 order and trade, 22 full-book factors.
MARKET = [
    "factor_hermes_permille", "factor_tr_sqrt_positive", "factor_spread", "factor_mid_return", "factor_fee_on_tick", "factor_bid_volume_change_ratio", "factor_ask_volume_change_ratio",
    "factor_weighted_return_1", "factor_weighted_return_2", "factor_weighted_return_3", "factor_weighted_return_4", "factor_weighted_return_5", "factor_weighted_ask", "factor_weighted_bid",
    "factor_weighted_ask_return", "factor_weighted_bid_return", "factor_weighted_volume_imbalance", "factor_volume_imbalance", "factor_percent_turnover", "factor_ask_l1_share", "factor_bid_l1_share",
]
FLOW = ["factor_order_flow", "factor_market", "factor_cancel_buy", "factor_cancel_sell", "factor_trade_buy", "factor_trade_sell", "factor_trade_total"]
FULL_BOOK = [
    "factor_positive_fill_rate", "factor_negative_fill_rate", "factor_order_flow_imbalance", "factor_cfr_imbalance", "factor_book_fixdist_imbalance_1pct", "factor_book_fixdist_imbalance_5pct",
    "factor_book_fixdist_weighted_1pct", "factor_book_fixdist_weighted_5pct", "factor_book_avg_size_imbalance", "factor_book_avg_size_imbalance_l1", "factor_book_avg_size_imbalance_l5",
    "factor_book_count_imbalance", "factor_book_count_imbalance_l1", "factor_book_count_imbalance_l5", "factor_book_life_imbalance", "factor_book_life_imbalance_l1", "factor_book_life_imbalance_l5",
    "factor_max_bid_distance_ratio", "factor_max_ask_distance_ratio", "factor_max_vol_distance_imbalance", "factor_book_young_imbalance_1pct", "factor_book_fixdist_hermes",
]


def order_flow(events: DataFrame, by: list[str]) -> DataFrame:
    """Eleven conditional sums of one window by direction.

    events: kind (order, trade or cancel), side ('B' or 'S': the order's, or the trade's active one),
    is_market, price, volume. Sums: volumes of limit orders on either side and of market orders
    (bought less sold); numbers and amounts of trades by active side; cancelled volumes; volumes
    of all orders.
    """
    buys, volume, market = F.col("side") == "B", F.col("volume"), F.col("is_market")
    of = lambda kind, side: (F.col("kind") == kind) & (buys if side == "B" else ~buys)
    total = lambda which, what=volume: F.sum(F.when(which, what).otherwise(0))
    signed = F.when(buys, volume).otherwise(-volume)
    amount = F.col("price") * volume
    return events.groupBy(*by).agg(
        total(of("order", "B") & ~market).alias("order_pf"), total(of("order", "S") & ~market).alias("order_nf"), total((F.col("kind") == "order") & market, signed).alias("order_mf"),
        F.count_if(of("trade", "B")).alias("trade_pcf"), F.count_if(of("trade", "S")).alias("trade_ncf"), total(of("trade", "B"), amount).alias("trade_pt"), total(of("trade", "S"), amount).alias("trade_nt"),
        total(of("cancel", "B")).alias("cxl_buy_flow"), total(of("cancel", "S")).alias("cxl_sell_flow"), total(of("order", "B")).alias("buy_order_volume"), total(of("order", "S")).alias("sell_order_volume"))


def flow_factors(flow: DataFrame, history: str = "history_amount") -> DataFrame:
    """flow with the seven factors of FLOW: its sums over the instrument's usual amount."""
    base = F.when(F.col(history) > 0, F.col(history))
    per = lambda c: F.coalesce(c / base, F.lit(0.0))
    c = F.col
    sums = [c("order_pf") - c("order_nf"), c("order_mf"), c("cxl_buy_flow"), c("cxl_sell_flow"), c("trade_pt"), c("trade_nt"), c("trade_pt") + c("trade_nt")]
    return flow.select("*", *[per(x).alias(n) for n, x in zip(FLOW, sums)])


def _ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.when(y != 0, x / y)


def market_factors(snapshots: DataFrame, by: list[str], order: list[str], tick: float = 0.01, fee_share: float = 0.0005) -> DataFrame:
    """snapshots (bid/ask prices and volumes as arrays of five, turnover) with the market factors; those
    that need the snapshot before are null on the first of a group."""
    b, a, bv, av = (F.col(c) for c in ("bid_prices", "ask_prices", "bid_volumes", "ask_volumes"))
    mid = (a[0] + b[0]) / 2
    # The five levels are written out, so that they are compiled.
    total = lambda v, k=5: _added([v[i].cast("double") for i in range(k)])
    vwap = lambda p, v: _ratio(_added([p[i] * v[i] for i in range(5)]), total(v))
    micro = lambda k: _ratio(a[0] * total(bv, k) + b[0] * total(av, k), total(bv, k) + total(av, k))
    rows = snapshots.select("*", mid.alias("mid"), total(bv).alias("bid_total"), total(av).alias("ask_total"), vwap(b, bv).alias("vwap_bid"), vwap(a, av).alias("vwap_ask"), *[micro(k).alias(f"micro_{k}") for k in range(1, 6)])
    w = W.partitionBy(*by).orderBy(*order)
    was = lambda c: F.lag(c).over(w)
    weighted = lambda v: _added([v[i] * (1.0 / (i + 1)) for i in range(5)])
    permille = lambda x, y: (_ratio(x, y) - 1) * 1000
    m = F.col("mid")
    return rows.select(
        "*", permille(F.col("micro_1"), m).alias("factor_hermes_permille"), (_ratio(a[0] - b[0], m) * 1000).alias("factor_spread"), permille(m, was("mid")).alias("factor_mid_return"), F.sqrt(F.greatest(permille(m, was("mid")), F.lit(0.0)) + 0 * was("mid")).alias("factor_tr_sqrt_positive"),
        _ratio(F.col("turnover") - was("turnover"), F.col("turnover")).alias("factor_percent_turnover"), (m * fee_share / tick).alias("factor_fee_on_tick"),
        imbalance("bid_total", was("bid_total")).alias("factor_bid_volume_change_ratio"), imbalance("ask_total", was("ask_total")).alias("factor_ask_volume_change_ratio"),
        *[permille(F.col(f"micro_{k}"), was("mid")).alias(f"factor_weighted_return_{k}") for k in range(1, 6)],
        permille(F.col("vwap_ask"), m).alias("factor_weighted_ask"), permille(F.col("vwap_bid"), m).alias("factor_weighted_bid"),
        permille(F.col("vwap_ask"), was("vwap_ask")).alias("factor_weighted_ask_return"), permille(F.col("vwap_bid"), was("vwap_bid")).alias("factor_weighted_bid_return"),
        imbalance(weighted(bv), weighted(av)).alias("factor_weighted_volume_imbalance"), imbalance("bid_total", "ask_total").alias("factor_volume_imbalance"),
        _ratio(av[0], F.col("ask_total")).alias("factor_ask_l1_share"), _ratio(bv[0], F.col("bid_total")).alias("factor_bid_l1_share"),
    ).drop("bid_total", "ask_total", "vwap_bid", "vwap_ask", *[f"micro_{k}" for k in range(1, 6)])


def full_book_factors(book: DataFrame) -> DataFrame:
    """A full-book aggregate (book.full_book_aggregate) beside the order flow of its window
    (order_flow), with the factors of FULL_BOOK and ``valid``: both sides hold orders.

    Fill rates: amounts traded over what was ordered, at the mid. Cancel ratios: volumes
    cancelled over ordered. Averages are per order. A ratio over nothing is 0.
    """
    c = F.col
    per = lambda x, y: F.coalesce(_ratio(x, y), F.lit(0.0))
    both = lambda zone, what: imbalance(f"bid_{zone}_{what}", f"ask_{zone}_{what}")
    mean = lambda zone, what: imbalance(*[per(c(f"{s}_{zone}_{what}"), c(f"{s}_{zone}_count")) for s in ("bid", "ask")])
    far = lambda s: per(F.abs(c(f"{s}_max_tick") - c("mid")), c("mid"))
    near = c("bid_pct1_volume") + c("ask_pct1_volume")
    micro = _ratio(c("a1") * c("bid_pct1_volume") + c("b1") * c("ask_pct1_volume"), near)
    levels = ("all", "l1", "l5")
    values = [
        per(c("trade_pt"), c("buy_order_volume") * c("mid")), per(c("trade_nt"), c("sell_order_volume") * c("mid")), imbalance("order_pf", "order_nf"),
        imbalance(per(c("cxl_buy_flow"), c("buy_order_volume")), per(c("cxl_sell_flow"), c("sell_order_volume"))),
        both("pct1", "volume"), both("pct5", "volume"), both("pct1", "amount"), both("pct5", "amount"),
        *[mean(z, "volume") for z in levels], *[both(z, "count") for z in levels], *[mean(z, "age") for z in levels],
        far("bid"), far("ask"), imbalance(far("bid"), far("ask")), imbalance("bid_young_volume", "ask_young_volume"), F.coalesce((_ratio(micro, c("mid")) - 1) * 1000, F.lit(0.0)),
    ]
    return book.select("*", *[x.alias(n) for n, x in zip(FULL_BOOK, values, strict=True)], ((c("bid_all_count") > 0) & (c("ask_all_count") > 0)).alias("valid"))


#: Our names of the 36 floats of a pair of snapshots.
PAIRED = [
    *[f"level_{c}_{i}" for i in range(1, 6) for c in ("imbalance", "change")], *[f"{s}_return_{i}" for i in range(1, 6) for s in ("bid", "ask")], "interval_volume", "interval_turnover",
    *[f"{s}_{c}" for s in ("bid", "ask") for c in ("added", "new_levels", "removed", "gone_levels", "shift")], "best_order_flow", "interval_price", "matched_order_flow", "matched_imbalance",
]


def _added(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms)


def _matched(side: str) -> dict[str, Column]:
    """Volumes added to and removed from a side between two snapshots, and levels that came and
    went, by price: of the prices that both snapshots can see, which end at the nearer fifth."""
    now, then = [(F.col(f"{p}{side}_prices"), F.col(f"{p}{side}_volumes")) for p in ("", "p.")]
    worst = (F.greatest if side == "bid" else F.least)(now[0][4], then[0][4])
    out = {}
    for names, (price, volume), (other, held) in ((("added", "new_levels"), now, then), (("removed", "gone_levels"), then, now)):
        seen = [(price[i] >= worst if side == "bid" else price[i] <= worst) for i in range(5)]
        there = [_added([F.when(other[j] == price[i], held[j]).otherwise(0) for j in range(5)]) for i in range(5)]
        out[f"{side}_{names[0]}"] = _added([F.when(seen[i], F.greatest(volume[i] - there[i], F.lit(0))).otherwise(0) for i in range(5)])
        out[f"{side}_{names[1]}"] = _added([F.when(seen[i] & ~F.array_contains(other, price[i]), 1).otherwise(0) for i in range(5)]).cast("long")
    return out


def paired_factors(snapshots: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The 36 floats of PAIRED of adjacent accepted snapshots; the first of a group has no pair.

    By position: the volume imbalance of each level, its change, the prices' returns. By price:
    volumes added and removed, levels come and gone, and the order flow and imbalance that these
    make (bids added and asks removed against the reverse). At the best prices the order flow
    of the first level alone. Over the interval: volume, turnover, their price against the mid,
    and the shift of each side's volume-weighted price, both in permille.
    """
    w = W.partitionBy(*by).orderBy(*order)
    rows = snapshots.withColumn("p", F.lag(F.struct("bid_prices", "ask_prices", "bid_volumes", "ask_volumes", "volume", "turnover")).over(w)).where("p is not null")
    out = []
    for i in range(5):
        now = imbalance(F.col("bid_volumes")[i], F.col("ask_volumes")[i])
        then = imbalance(F.col("p.bid_volumes")[i], F.col("p.ask_volumes")[i])
        out += [now.alias(f"level_imbalance_{i + 1}"), (now - then).alias(f"level_change_{i + 1}")]
        out += [((_ratio(F.col(f"{s}_prices")[i], F.col(f"p.{s}_prices")[i]) - 1) * 1000).alias(f"{s}_return_{i + 1}") for s in ("bid", "ask")]
    traded, amount = F.col("volume") - F.col("p.volume"), F.col("turnover") - F.col("p.turnover")
    mid = (F.col("ask_prices")[0] + F.col("bid_prices")[0]) / 2
    vwap = lambda s, p="": _ratio(_added([F.col(f"{p}{s}_prices")[i] * F.col(f"{p}{s}_volumes")[i] for i in range(5)]), _added([F.col(f"{p}{s}_volumes")[i] for i in range(5)]))

    def best(s: str) -> Column:
        price, was = F.col(f"{s}_prices")[0], F.col(f"p.{s}_prices")[0]
        volume, before = F.col(f"{s}_volumes")[0], F.col(f"p.{s}_volumes")[0]
        nearer, farther = (price > was, price < was) if s == "bid" else (price < was, price > was)
        return F.when(nearer, volume).when(farther, -before).otherwise(volume - before)

    out += [traded.alias("interval_volume"), amount.alias("interval_turnover"), *[x.alias(n) for s in ("bid", "ask") for n, x in _matched(s).items()]]
    out += [*[(_ratio(vwap(s), vwap(s, "p.")) * 1000 - 1000).alias(f"{s}_shift") for s in ("bid", "ask")], (best("bid") - best("ask")).alias("best_order_flow"), (_ratio(_ratio(amount, traded), mid) * 1000 - 1000).alias("interval_price")]
    rows, c = rows.select("*", *out).drop("p"), F.col
    flow = c("bid_added") - c("bid_removed") - c("ask_added") + c("ask_removed")
    return rows.withColumns({"matched_order_flow": flow, "matched_imbalance": imbalance(c("bid_added") + c("ask_removed"), c("bid_removed") + c("ask_added"))})
