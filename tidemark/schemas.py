"""Schemas of the domain tables. Missing values are SQL NULL; times of day are microseconds."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "array<double>": T.ArrayType(T.DoubleType()), "array<long>": T.ArrayType(T.LongType()),
}


def schema(spec: str) -> T.StructType:
    """A schema from "name type, ..."; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in spec.split(", "))])


L2_ORDER = schema(
    "order_time long, exchange_id long, instrument_id long, price double, volume double, order_kind long, ord_type long, "
    "appl_seq_num long, biz_index long, order_no long, rank long, is_last long"
)
L2_TRADE = schema(
    "trade_time long, exchange_id long, instrument_id long, price double, volume double, order_kind long, order_bs_flag long, turnover double, "
    "bid_appl_seq_num long, offer_appl_seq_num long, appl_seq_num long, biz_index long, rank long, is_last long"
)
_LEVELS = ", ".join(f"{side}_price{i} double, {side}_volume{i} int" for side in ("bid", "ask") for i in range(1, 6))
SNAPSHOT_WIDE = schema(
    "update_time long, instrument_id string, exchange_id string, last double, pre_close double, open double, high double, low double, "
    f"volume int, turnover double, {_LEVELS}, rank long"
)
SNAPSHOT = schema(
    "symbol string, trading_day int, exchange_time_ms long, last_price double, volume long, turnover double, "
    "ask_prices array<double>, ask_volumes array<long>, bid_prices array<double>, bid_volumes array<long>"
)
DATAGRAM = schema("ts_ns long, monotonic_ns long, channel string, source_ip string, source_port int, length int, prefix_hex string")
SAMPLE = schema(
    "instrument string, exchange_time_us long, local_time_us long, app_sequence long, cut_index long, row_in_stock_day long, "
    "window_start_exchange_time_us long, window_start_app_sequence long, window_start_cut_index long, last_price double, "
    "amount_trigger boolean, time_trigger boolean, change_trigger boolean, source string, framework_receive_time long, "
    "raw_prediction double, model_latency_ns long, factor_0 double, factor_1 double"
)
FEED_EVENT = schema("event_id long, feed_sequence long, symbol string, payload_size int, payload binary")
INSTRUMENT_STATIC = schema(
    "Close double, HistoryAmount double, FreeShare double, HpUpperPrice double, HpLowerPrice double, HistoryVolatility20d double, Date int, static_position int"
)
CANDIDATE = schema("symbol string, source int, trading_day int, exchange_time_us long, turnover double, sequence long, valid boolean, full_runtime_valid boolean")
