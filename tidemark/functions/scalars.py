"""Column functions: markets and codes, positions and risk, times, prices, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- markets and codes ------------------------------------------------------------


def classify_market(code, convertible: bool = False) -> Column:
    """SH, SZ, BJ or NONE by the code's prefix; ``convertible`` for convertible bonds."""
    two, three = F.substring(_c(code), 1, 2), F.substring(_c(code), 1, 3)
    if convertible:
        return F.when(two == "11", "SH").when(two == "12", "SZ").otherwise("NONE")
    return F.when(two.isin("60", "68"), "SH").when(two.isin("00", "30", "31"), "SZ").when(three == "920", "BJ").otherwise("NONE")


def in_universe(code) -> Column:
    return _c(code).rlike("^(000|001|002|003|300|301)[0-9]{3}$")


def exclusion_reason(name, include_st: bool = False) -> Column:
    """The first reason to leave an instrument out, by its name; else keep."""
    out = F.when(F.contains(_c(name), F.lit("退")), "delisting").when(F.substring(_c(name), 1, 1).isin("N", "C"), "new_listing")
    if not include_st:
        out = out.when(F.contains(F.upper(_c(name)), F.lit("ST")), "st")
    return out.otherwise("keep")


def normalize_symbol(symbol) -> Column:
    """Six digits: what stands before a suffix, zero-padded."""
    return F.lpad(F.regexp_extract(_c(symbol), "^([0-9]*)", 1), 6, "0")


def wire_price(raw) -> Column:
    return _c(raw) / 10000


def wire_quantity(raw) -> Column:
    return _c(raw) / 100


def wire_turnover(raw) -> Column:
    return _c(raw) / 1000000


def is_auction_time(us) -> Column:
    """Opening auction 09:15 to 09:25 and closing auction 14:57 to 15:00 (our rule)."""
    minute = _c(us) / 60_000_000
    return ((minute >= 555) & (minute < 565)) | ((minute >= 897) & (minute < 900))


def valid_snapshot(last="last_price", bids="bid_prices", asks="ask_prices", bid_sizes="bid_volumes", ask_sizes="ask_volumes", volume="volume", turnover="turnover") -> Column:
    """Positive prices, an uncrossed book, no negative size or cumulative value (our rule)."""
    positive = lambda x: x > 0
    not_negative = lambda x: x >= 0
    return (
        (_c(last) > 0) & F.forall(_c(bids), positive) & F.forall(_c(asks), positive) & (_c(asks)[0] > _c(bids)[0])
        & F.forall(_c(bid_sizes), not_negative) & F.forall(_c(ask_sizes), not_negative) & (_c(volume) >= 0) & (_c(turnover) >= 0)
    )


def is_finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(vector) -> Column:
    return F.forall(_c(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def valid_candidate() -> Column:
    return F.col("valid") & (F.col("trading_day") >= 20000101) & (F.col("exchange_time_us") != 0) & (F.col("sequence") != 0) & is_finite("turnover") & (F.col("turnover") >= 0)


# --- positions and risk -----------------------------------------------------------


def startup_position(static, total, available) -> Column:
    """Struct of total, available and delta at startup."""
    whole = F.greatest(_c(total), F.lit(0))
    return F.struct(whole.alias("total"), F.least(F.greatest(_c(available), F.lit(0)), whole).alias("available"), (whole - _c(static)).alias("delta"))


def max_can_buy(shortable, limit, delta, pending) -> Column:
    return F.greatest(F.least(_c(shortable), _c(limit)) - _c(delta) - _c(pending), F.lit(0))


def max_can_sell(static, shortable, limit, delta, pending) -> Column:
    room = F.least(_c(shortable), _c(limit) + _c(delta)) - _c(pending)
    return F.greatest(F.least(room, _c(static) + _c(delta) - _c(pending)), F.lit(0))


def bias(notional, base, factor) -> Column:
    return F.when(_c(base) > 0, _c(notional) / _c(base) * _c(factor)).otherwise(0.0)


def unit_bias(offset, factor, last, base) -> Column:
    return F.when(_c(base) > 0, _c(offset) * _c(factor) * _c(last) / _c(base)).otherwise(0.0)


def after_cutoff(hhmmss, cutoff) -> Column:
    return _c(hhmmss) >= _c(cutoff)


def target_permille(mid, *later) -> Column:
    """Mean return of the later mids in thousandths; null where a mid is not positive."""
    good = _c(mid) > 0
    for x in later:
        good = good & (_c(x) > 0)
    returns = [(_c(x) / _c(mid) - 1) * 1000 for x in later]
    return F.when(good, sum(returns[1:], returns[0]) / len(returns))


def lot_round(quantity, unit=100, least=100, most=1_000_000) -> Column:
    """Whole lots; nothing below ``least``, ``most`` at most."""
    lots = F.floor(_c(quantity) / unit) * unit
    return F.when(lots < least, F.lit(0)).otherwise(F.least(lots, F.lit(most)))


def can_buy(virtual_short) -> Column:
    return _c(virtual_short) == 0


def can_sell(virtual_long) -> Column:
    return _c(virtual_long) == 0


def imbalance(a, b) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0 (our form of the imbalance factors)."""
    return F.when(_c(a) + _c(b) == 0, 0.0).otherwise((_c(a) - _c(b)) / (_c(a) + _c(b)))


# --- times, text, prices ----------------------------------------------------------


def time_text_to_ms(text) -> Column:
    """Milliseconds of a day from HH:MM:SS.mmm."""
    part = F.split(_c(text), "[:.]")
    n = lambda i: part[i].cast("long")
    return ((n(0) * 60 + n(1)) * 60 + n(2)) * 1000 + n(3)


def format_us(us) -> Column:
    """HH:MM:SS.ffffff of microseconds of a day."""
    return F.date_format(F.timestamp_micros(_c(us)), "HH:mm:ss.SSSSSS")


def parse_ns(text) -> Column:
    """Nanoseconds since the epoch of YYYY-MM-DD HH:MM:SS[.ffffff] in the session's zone."""
    return F.unix_micros(F.to_timestamp(_c(text))) * 1000


def hhmmss(us) -> Column:
    second = F.floor(_c(us) / 1_000_000)
    return (F.floor(second / 3600) * 10000 + F.floor(second / 60) % 60 * 100 + second % 60).cast("int")


def rjust(text, width: int, fill: str = " ") -> Column:
    """Padded on the left, never cut."""
    return F.when(F.length(_c(text)) >= width, _c(text)).otherwise(F.lpad(_c(text), width, fill))


def round_price(price, scale: int = 100) -> Column:
    """Price as a whole number of ticks."""
    return F.round(_c(price) * scale).cast("long")


def parse_date(text) -> Column:
    """Date of YYYY-MM-DD or YYYYMMDD; null for anything else."""
    t = _c(text)
    shaped = t.rlike("^([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$")
    return F.when(shaped, F.try_to_date(F.regexp_replace(t, "-", ""), "yyyyMMdd"))


def format_decimal(x) -> Column:
    """Ten places, without trailing zeros or point."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", _c(x)), "0+$", ""), "\\.$", "")


def to_float(text) -> Column:
    return _c(text).try_cast("double")


def gbk_to_utf8(raw) -> Column:
    """Text of GBK bytes; needs spark.sql.legacy.javaCharsets=true."""
    return F.decode(_c(raw), "GBK")


def endpoint(text) -> Column:
    return F.struct(F.split_part(_c(text), F.lit(":"), F.lit(1)).alias("host"), F.split_part(_c(text), F.lit(":"), F.lit(2)).try_cast("int").alias("port"))


def hex_prefix(payload, size: int = 64) -> Column:
    return F.lower(F.hex(F.substring(_c(payload), 1, size)))


# --- hashes and vectors -----------------------------------------------------------


def fnv1a32(text) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.aggregate(F.filter(F.split(_c(text), ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def worker_of(text, cpus: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cpus]), (fnv1a32(text) % len(cpus)).cast("int") + 1)


def zscore(values, mean, std, order: list[int] | None = None) -> Column:
    """Standardised vector, its entries taken in ``order``."""
    z = F.zip_with(F.zip_with(_c(values), _c(mean), lambda x, m: x - m), _c(std), lambda x, s: x / s)
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(z, i)) if order else z


def softsign(x) -> Column:
    return _c(x) / (1 + F.abs(_c(x)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))
