"""L2 orders and trades as events of one form, or the reason why a row is none (our rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_finite, round_price
from tidemark.operators.static import first_failure

DAY_US = 86_400_000_000


def day_of(time_us: Column) -> Column:
    """yyyymmdd of microseconds since 1970, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(time_us / DAY_US).cast("int"))
    return F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)


def _events(rows: DataFrame, rules: list[tuple[Column, str]], fields: dict[str, Column]) -> DataFrame:
    """appl_seq_num and reject_reason of every row, and the event's fields where there is no reason."""
    judged = rows.withColumn("reject_reason", first_failure(rules))
    return judged.select("appl_seq_num", "reject_reason", *[F.when(F.col("reject_reason").isNull(), x).alias(n) for n, x in fields.items()])


def _common(time: Column, day: Column) -> tuple[list[tuple[Column, str]], dict[str, Column]]:
    volume = F.col("volume")
    rules = [(day_of(time) == day, "day"), (F.col("appl_seq_num") > 0, "sequence"), (is_finite(volume) & (volume > 0) & (volume == F.floor(volume)), "volume")]
    symbol = F.lpad(F.col("instrument_id").cast("string"), 6, "0")
    return rules, {"symbol": symbol, "trading_day": day, "exchange_time_us": time % DAY_US, "sequence": F.col("appl_seq_num"), "tick": round_price("price"), "qty": volume.cast("long")}


def normalize_orders(orders: DataFrame, day: Column) -> DataFrame:
    """Order events of the trading day. order_kind: 1 new, 2 cancel; ord_type: 1 market, 2 limit.

    Rules in order: the time is on the day, a positive sequence, a whole positive volume, known
    kinds, and a positive price unless it is a market order. A null fails its rule.
    """
    kind, market, price = F.col("order_kind"), F.col("ord_type") == 1, F.col("price")
    rules, fields = _common(F.col("order_time"), day)
    rules += [(kind.isin(1, 2) & F.col("ord_type").isin(1, 2), "kind"), (market | (is_finite(price) & (price > 0)), "price")]
    return _events(orders, rules, fields | {"tick": F.when(~market, fields["tick"]), "kind": F.when(kind == 2, "cancel").when(market, "market").otherwise("limit")})


def normalize_trades(trades: DataFrame, day: Column) -> DataFrame:
    """Trade events of the trading day. order_kind: 1 trade, 4 cancel.

    Rules in order: as for orders; then a known kind, both linked orders for a trade and one for
    a cancel, and a positive price for a trade.
    """
    bid, offer, price = F.coalesce("bid_appl_seq_num", F.lit(0)) > 0, F.coalesce("offer_appl_seq_num", F.lit(0)) > 0, F.col("price")
    cancel = F.col("order_kind") == 4
    rules, fields = _common(F.col("trade_time"), day)
    rules += [(F.col("order_kind").isin(1, 4), "kind"), (F.when(cancel, bid != offer).otherwise(bid & offer), "link"), (cancel | (is_finite(price) & (price > 0)), "price")]
    linked = {"tick": F.when(~cancel, fields["tick"]), "kind": F.when(cancel, "cancel").otherwise("trade"), "bid_sequence": F.when(bid, F.col("bid_appl_seq_num")), "ask_sequence": F.when(offer, F.col("offer_appl_seq_num"))}
    return _events(trades, rules, fields | linked)
