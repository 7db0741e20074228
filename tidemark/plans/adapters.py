"""The domain tables as the given tables can provide them.

There is no order-book data at hand, so each table is derived by fixed rules: events
stand for the feed, orders and lineitem for L2 orders and trades, part and customer for
static data and positions. ``CTES`` has the same rules as DuckDB SQL. Operators know
nothing of this: they take any table with the columns they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Kinds of feed events by event_type.
KINDS = {"click": "buy", "view": "sell", "purchase": "trade", "signup": "cancel", "error": "malformed"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
#: Code prefixes given to parts in turn.
PREFIXES = ["000", "001", "002", "003", "300", "301", "600", "688", "110", "123", "920", "302"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed events; ticks are whole prices, so that price levels meet several orders."""
    e = read(spark, sf_dir, "events").withColumn("ts_us", micros("ts"))
    return e.select(
        "event_id", F.col("event_id").alias("feed_sequence"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").cast("int").alias("trading_day"), "ts_us", (F.col("ts_us") % DAY_US).alias("exchange_time_us"),
        F.col("value").alias("price"), F.round("value").cast("long").alias("tick"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("volume"),
        F.expr(_KIND).alias("kind"), (F.col("user_id") % 8).cast("int").alias("shard"), "event_type")


def book_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, side, tick, ts_us, sequence, qty, orders): inserts add; trades take from the
    buy side and cancels from the sell side."""
    f = feed(spark, sf_dir).where("kind <> 'malformed'")
    sign = F.when(F.col("kind").isin("buy", "sell"), 1).otherwise(-1)
    return f.select("symbol", F.when(F.col("kind").isin("buy", "trade"), "B").otherwise("S").alias("side"), "tick", "ts_us", F.col("event_id").alias("sequence"), (sign * F.col("volume")).alias("qty"), sign.alias("orders"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided snapshots made from trades: a ladder of five levels around each price."""
    f = feed(spark, sf_dir).where("kind in ('trade', 'buy')")
    level = lambda sign: F.array(*[F.round(F.col("price") + sign * i * (0.5 + F.col("volume") % 3), 2) for i in range(1, 6)])
    size = lambda k: F.array(*[(F.col("volume") * i + k * (F.col("event_id") % 7)).cast("long") for i in range(1, 6)])
    return f.select(
        "symbol", "trading_day", "ts_us", "event_id", F.col("price").alias("last_price"), F.col("event_id").alias("volume"), F.round(F.col("event_id") * 10.0, 2).alias("turnover"),
        level(1).alias("ask_prices"), size(1).alias("ask_volumes"), level(-1).alias("bid_prices"), size(2).alias("bid_volumes"))


def l2_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        (micros("o_orderdate") + F.col("o_orderkey") % 86400 * 1_000_000).alias("order_time"), (F.col("o_orderkey") % 2 + 1).alias("exchange_id"), F.col("o_custkey").alias("instrument_id"),
        (F.floor(F.col("o_totalprice") / 10 + 0.5) / 100).alias("price"), (F.col("o_orderkey") % 50 + 1).cast("double").alias("volume"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).cast("long").alias("order_kind"),
        F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(2).cast("long").alias("ord_type"), F.col("o_orderkey").alias("appl_seq_num"))


def l2_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        (micros("l_shipdate") + F.col("l_linenumber") * 1_000_000).alias("trade_time"), F.col("l_suppkey").alias("instrument_id"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000 + 0.5) / 10000).alias("price"),
        F.col("l_quantity").cast("double").alias("volume"), F.when(F.col("l_returnflag") == "R", 4).otherwise(1).cast("long").alias("order_kind"), F.col("l_orderkey").alias("bid_appl_seq_num"),
        F.col("l_partkey").alias("offer_appl_seq_num"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("appl_seq_num"), F.round("l_extendedprice", 2).alias("turnover"))


def order_side() -> F.Column:
    """A third of the orders sell."""
    return F.when(F.col("appl_seq_num") % 3 == 0, "S").otherwise("B")


def l2_book_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes of orders and trades: new limit orders add their volume, and a trade takes its
    volume from the level of either linked limit order."""
    limits = l2_orders(spark, sf_dir).where("ord_type = 2 and order_kind = 1").select(F.col("appl_seq_num").alias("_order"), F.col("instrument_id").alias("symbol"), order_side().alias("side"), F.round(F.col("price") * 100).cast("long").alias("tick"), "order_time", F.col("volume").cast("long").alias("qty"))
    trades = l2_trades(spark, sf_dir).where("order_kind = 1")
    links = [trades.select(F.lit(side).alias("side"), F.col(link).alias("_order"), "trade_time", F.col("appl_seq_num").alias("sequence"), F.col("volume").cast("long").alias("_taken")) for side, link in (("B", "bid_appl_seq_num"), ("S", "offer_appl_seq_num"))]
    level = ["symbol", "side", "tick"]
    taken = links[0].union(links[1]).join(limits.drop("qty", "order_time"), ["_order", "side"]).select(*level, F.col("trade_time").alias("ts_us"), "sequence", (-F.col("_taken")).alias("qty"), F.lit(0).alias("orders"))
    return limits.select(*level, F.col("order_time").alias("ts_us"), F.col("_order").alias("sequence"), "qty", F.lit(1).alias("orders")).union(taken)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static data of one instrument per part."""
    p = read(spark, sf_dir, "part")
    prefix = F.element_at(F.array(*[F.lit(x) for x in PREFIXES]), (F.col("p_partkey") % len(PREFIXES)).cast("int") + 1)
    return p.select(
        F.concat(prefix, F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("code"), "p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("close"),
        (F.col("p_size") * 1000.0).alias("free_share"), (F.col("p_retailprice") * F.col("p_size") * 100).alias("history_amount"), (F.col("p_partkey") % 8).cast("int").alias("shard"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker positions of one row per customer, some of them short, empty or unknown."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.lpad(k.cast("string"), 6, "0").alias("symbol"), (k % 11 * 100).alias("static_position"), ((k * 7) % 13 * 100 - 100).alias("total_position"), ((k * 5) % 17 * 100 - 200).alias("available_position"),
        (k % 5 * 300).alias("shortable"), (k % 4 * 400).alias("position_limit"), (k % 3 * 100).alias("pending_buy"), (k % 2 * 100).alias("pending_sell"), F.col("c_acctbal").alias("balance"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two sources: trades and buys come from the full book, others from snapshots.
    A twentieth arrives with an older time or day."""
    f = feed(spark, sf_dir)
    late = F.when(F.col("event_id") % 20 == 7, F.lit(5 * 3_600_000_000)).otherwise(0)
    return f.select(
        "symbol", F.when(F.col("kind").isin("trade", "buy"), 1).otherwise(2).alias("source"), F.when(F.col("event_id") % 50 == 3, F.col("trading_day") - 1).otherwise(F.col("trading_day")).alias("trading_day"),
        F.greatest(F.col("exchange_time_us") - late, F.lit(0)).alias("exchange_time_us"), F.col("price").alias("turnover"), F.col("event_id").alias("sequence"), (F.col("event_type") != "error").alias("valid"),
        (F.col("event_id") % 9 != 0).alias("full_runtime_valid"), F.col("event_id").alias("arrival"))


CTES = {
    "feed": f"""feed AS (SELECT event_id, event_id AS feed_sequence, lpad(user_id::VARCHAR, 6, '0') AS symbol, strftime(ts, '%Y%m%d')::INT AS trading_day, epoch_us(ts) AS ts_us,
  epoch_us(ts) % {DAY_US} AS exchange_time_us, value AS price, round(value)::BIGINT AS tick, (props->>'$.k')::BIGINT + 1 AS volume, {_KIND} AS kind, (user_id % 8)::INT AS shard, event_type FROM events)""",
    "book_changes": """book_changes AS (SELECT symbol, CASE WHEN kind IN ('buy', 'trade') THEN 'B' ELSE 'S' END AS side, tick, ts_us, event_id AS sequence,
  CASE WHEN kind IN ('buy', 'sell') THEN 1 ELSE -1 END * volume AS qty, CASE WHEN kind IN ('buy', 'sell') THEN 1 ELSE -1 END AS orders FROM feed WHERE kind <> 'malformed')""",
    "snapshots": """snapshots AS (SELECT symbol, trading_day, ts_us, event_id, price AS last_price, event_id AS volume, round(event_id * 10.0, 2) AS turnover,
  [round(price + i * (0.5 + volume % 3), 2) FOR i IN range(1, 6)] AS ask_prices, [(volume * i + event_id % 7)::BIGINT FOR i IN range(1, 6)] AS ask_volumes,
  [round(price - i * (0.5 + volume % 3), 2) FOR i IN range(1, 6)] AS bid_prices, [(volume * i + 2 * (event_id % 7))::BIGINT FOR i IN range(1, 6)] AS bid_volumes FROM feed WHERE kind IN ('trade', 'buy'))""",
    "l2_orders": """l2_orders AS (SELECT epoch_us(o_orderdate) + o_orderkey % 86400 * 1000000 AS order_time, o_orderkey % 2 + 1 AS exchange_id, o_custkey AS instrument_id, floor(o_totalprice / 10 + 0.5) / 100 AS price,
  (o_orderkey % 50 + 1)::DOUBLE AS volume, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END::BIGINT AS order_kind, CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE 2 END::BIGINT AS ord_type, o_orderkey AS appl_seq_num FROM orders)""",
    "l2_trades": """l2_trades AS (SELECT epoch_us(l_shipdate) + l_linenumber * 1000000 AS trade_time, l_suppkey AS instrument_id, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS price, l_quantity::DOUBLE AS volume,
  CASE WHEN l_returnflag = 'R' THEN 4 ELSE 1 END::BIGINT AS order_kind, l_orderkey AS bid_appl_seq_num, l_partkey AS offer_appl_seq_num, l_orderkey * 10 + l_linenumber AS appl_seq_num, round(l_extendedprice, 2) AS turnover FROM lineitem)""",
    "l2_book": """l2_sided AS (SELECT *, CASE WHEN appl_seq_num % 3 = 0 THEN 'S' ELSE 'B' END AS side FROM l2_orders),
l2_limits AS (SELECT appl_seq_num AS o, instrument_id AS symbol, side, round(price * 100)::BIGINT AS tick, order_time, volume::BIGINT AS qty FROM l2_sided WHERE ord_type = 2 AND order_kind = 1),
l2_links AS (SELECT 'B' AS side, bid_appl_seq_num AS o, * FROM l2_trades WHERE order_kind = 1 UNION ALL SELECT 'S', offer_appl_seq_num, * FROM l2_trades WHERE order_kind = 1),
l2_changes AS (SELECT symbol, side, tick, order_time AS ts_us, o AS sequence, qty FROM l2_limits UNION ALL SELECT symbol, side, tick, trade_time, t.appl_seq_num, -t.volume::BIGINT FROM l2_links t JOIN l2_limits USING (o, side)),
l2_states AS (SELECT symbol, side, tick, ts_us AS valid_from, sum(qty) OVER w AS q, lead(ts_us) OVER w AS valid_to FROM l2_changes WINDOW w AS (PARTITION BY symbol, side, tick ORDER BY ts_us, sequence)),
l2_levels AS (SELECT * FROM l2_states WHERE q > 0 AND (valid_to IS NULL OR valid_to > valid_from))""",
    "instruments": f"""instruments AS (SELECT {PREFIXES}[p_partkey % {len(PREFIXES)} + 1] || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS code, p_partkey, p_name AS name, p_retailprice AS close,
  p_size * 1000.0::DOUBLE AS free_share, p_retailprice * p_size * 100 AS history_amount, (p_partkey % 8)::INT AS shard FROM part)""",
    "positions": """positions AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS symbol, c_custkey % 11 * 100 AS static_position, (c_custkey * 7) % 13 * 100 - 100 AS total_position, (c_custkey * 5) % 17 * 100 - 200 AS available_position,
  c_custkey % 5 * 300 AS shortable, c_custkey % 4 * 400 AS position_limit, c_custkey % 3 * 100 AS pending_buy, c_custkey % 2 * 100 AS pending_sell, c_acctbal AS balance FROM customer)""",
    "candidates": """candidates AS (SELECT symbol, CASE WHEN kind IN ('trade', 'buy') THEN 1 ELSE 2 END AS source, CASE WHEN event_id % 50 = 3 THEN trading_day - 1 ELSE trading_day END AS trading_day,
  greatest(exchange_time_us - CASE WHEN event_id % 20 = 7 THEN 18000000000 ELSE 0 END, 0) AS exchange_time_us, price AS turnover, event_id AS sequence, event_type <> 'error' AS valid, event_id % 9 <> 0 AS full_runtime_valid, event_id AS arrival FROM feed)""",
}
_NEEDS = {"l2_book": ["l2_orders", "l2_trades"], "book_changes": ["feed"], "snapshots": ["feed"], "candidates": ["feed"]}


def with_ctes(sql: str, *names: str) -> str:
    """``sql`` behind the named tables' definitions; it may go on with CTEs of its own after 'WITH '."""
    wanted: list[str] = []
    for name in names:
        wanted += [x for x in [*_NEEDS.get(name, []), name] if x not in wanted]
    head = "WITH " + ",\n".join(CTES[x] for x in wanted)
    sql = sql.strip()
    return f"{head},\n{sql[5:]}" if sql.startswith("WITH ") else f"{head}\n{sql}"
