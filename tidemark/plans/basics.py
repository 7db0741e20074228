"""Queries of sources, projections, filters, sets, sorting and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import scalars as S
from tidemark.operators import normalize, quality, sampling, static
from tidemark.plans import adapters as A
from tidemark.plans.adapters import with_ctes
from tidemark.plans.registry import part, query
from tidemark.sources import readers, sinks
from tidemark.sources.shared import shared_dir

# --- sources and sinks ------------------------------------------------------------


def _written(rows: DataFrame, schema: T.StructType, fmt: str = "parquet") -> str:
    """A fresh folder with rows in the given form; columns that they lack are null."""
    path = shared_dir(rows.sparkSession, "table")
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*columns).write.format(fmt).option("header", True).save(path)
    return path


@query(with_ctes("SELECT order_time, exchange_id, instrument_id, price, volume, order_kind, ord_type, appl_seq_num FROM l2_orders WHERE volume > 10", "l2_orders"))
def s1_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = readers.read_orders(spark, _written(A.l2_orders(spark, d), schemas.L2_ORDER))
    return orders.where("volume > 10").select("order_time", "exchange_id", "instrument_id", "price", "volume", "order_kind", "ord_type", "appl_seq_num")


@query(with_ctes("SELECT instrument_id, count(*) AS n, round(sum(turnover), 2) AS turnover FROM l2_trades GROUP BY 1", "l2_trades"))
def s2_trades(spark: SparkSession, d: str) -> DataFrame:
    trades = readers.read_trades(spark, _written(A.l2_trades(spark, d), schemas.L2_TRADE, "csv"), "csv")
    return trades.groupBy("instrument_id").agg(F.count("*").alias("n"), F.round(F.sum("turnover"), 2).alias("turnover"))


@query(with_ctes("SELECT symbol, event_id, b.u.p AS bid_price, b.u.v AS bid_volume, b.i AS level FROM (SELECT symbol, event_id, unnest([{'u': {'p': bid_prices[i], 'v': bid_volumes[i]}, 'i': i} FOR i IN range(1, 6)]) AS b FROM snapshots)", "snapshots"))
def s3_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = A.snapshots(spark, d)
    wide = s.select(F.col("symbol").alias("instrument_id"), F.col("event_id").alias("rank"), *[F.col(f"{side}_{k}s")[i - 1].alias(f"{side}_{k}{i}") for side in ("bid", "ask") for k in ("price", "volume") for i in range(1, 6)])
    rows = readers.read_snapshots(spark, _written(wide, schemas.SNAPSHOT_WIDE)).select(F.col("instrument_id").alias("symbol"), F.col("rank").alias("event_id"), F.posexplode("bids").alias("level", "b"))
    return rows.select("symbol", "event_id", (F.col("level") + 1).cast("long").alias("level"), F.col("b.price").alias("bid_price"), F.col("b.volume").cast("long").alias("bid_volume"))


@query("""SELECT (event_id % 10 <> 0 AND event_id % 7 <> 0) AS good, count(*) AS n, max(CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 0 THEN event_id * 1000 END) AS last_ns FROM events WHERE event_id % 13 <> 0 GROUP BY 1""")
def s4_datagrams(spark: SparkSession, d: str) -> DataFrame:
    """Event rows written as JSON lines: some blank, some cut off, some without a channel."""
    e = A.read(spark, d, "events")
    whole = F.to_json(F.struct((F.col("event_id") * 1000).alias("ts_ns"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("channel"), F.lit("10.0.0.1").alias("source_ip")))
    line = F.when(F.col("event_id") % 13 == 0, "  ").when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    rows = readers.parse_datagrams(e.select(line.alias("value")))
    return rows.groupBy("good").agg(F.count("*").alias("n"), F.max(F.when(F.col("good"), F.col("ts_ns"))).alias("last_ns"))


@query(with_ctes("SELECT code AS symbol, round(close, 4) AS close, free_share FROM instruments", "instruments"))
def s6_static(spark: SparkSession, d: str) -> DataFrame:
    i = A.instruments(spark, d)
    params = F.create_map("code", F.struct(F.col("close").alias("Close"), F.col("free_share").alias("FreeShare"), F.col("history_amount").alias("HistoryAmount")))
    documents = i.select(F.to_json(F.struct(params.alias("ins_params"))).alias("value"))
    return readers.parse_static(documents).select("symbol", F.round("Close", 4).alias("close"), F.col("FreeShare").alias("free_share"))


@query(with_ctes("SELECT symbol, event_id, price, volume, shard, 'full' AS kind FROM feed WHERE symbol IN (SELECT symbol FROM feed WHERE shard = 3) UNION ALL SELECT symbol, event_id, price, NULL, NULL, 'compact' FROM feed WHERE symbol NOT IN (SELECT symbol FROM feed WHERE shard = 3)", "feed"))
def s9_split(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d).select("symbol", "event_id", "price", "volume", "shard")
    full, compact = sinks.split_samples(f, f.where("shard = 3"), ["symbol", "event_id", "price"])
    return full.withColumn("kind", F.lit("full")).unionByName(compact.withColumn("kind", F.lit("compact")), allowMissingColumns=True)


@query(with_ctes("SELECT document, sha256(document) AS sha256 FROM (SELECT '[' || string_agg('{\"code\":\"' || code || '\",\"p_partkey\":' || p_partkey || ',\"shard\":' || shard || '}', ',' ORDER BY p_partkey) || ']' AS document FROM instruments)", "instruments"))
def s10_daily(spark: SparkSession, d: str) -> DataFrame:
    return sinks.daily_document(A.instruments(spark, d).select("code", "p_partkey", "shard"), "p_partkey")


@query("SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN round(max(value), 2) END AS greatest FROM events GROUP BY 1")
def s12_exports(spark: SparkSession, d: str) -> DataFrame:
    out = sinks.log_exports(A.read(spark, d, "events"), ["click", "view"], "event_type")
    best = out["click"].groupBy("event_type").agg(F.round(F.max("value"), 2).alias("greatest"))
    return out["summary"].withColumnRenamed("count", "n").join(best, "event_type", "left")


@query("SELECT DISTINCT 'day_journal_' || strftime(o_orderdate, '%Y%m%d') AS name, (o_orderdate::DATE)::VARCHAR AS day FROM orders WHERE o_orderdate::DATE < DATE '1996-06-15' - 30 AND o_orderkey % 9 <> 0")
def s13_retention(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    name = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "day_journal_x").otherwise("day_journal_"), F.date_format("o_orderdate", "yyyyMMdd"))
    return sinks.retention(o.select(name.alias("name")).distinct(), F.lit("1996-06-15").cast("date"), 30).select("name", F.col("day").cast("string").alias("day"))


# --- projections and filters ------------------------------------------------------


@query(with_ctes("""SELECT CASE WHEN substr(code, 1, 2) IN ('60', '68') THEN 'SH' WHEN substr(code, 1, 2) IN ('00', '30', '31') THEN 'SZ' WHEN substr(code, 1, 3) = '920' THEN 'BJ' ELSE 'NONE' END AS market,
  CASE substr(code, 1, 2) WHEN '11' THEN 'SH' WHEN '12' THEN 'SZ' ELSE 'NONE' END AS bond_market, count(*) AS n FROM instruments GROUP BY 1, 2""", "instruments"))
def p1_market(spark: SparkSession, d: str) -> DataFrame:
    return A.instruments(spark, d).groupBy(S.classify_market("code").alias("market"), S.classify_market("code", convertible=True).alias("bond_market")).agg(F.count("*").alias("n"))


@query(with_ctes("SELECT code, p_partkey FROM instruments WHERE regexp_matches(code, '^(000|001|002|003|300|301)[0-9]{3}$')", "instruments"))
def p2_universe(spark: SparkSession, d: str) -> DataFrame:
    return A.instruments(spark, d).where(S.in_universe("code")).select("code", "p_partkey")


_NAME = "CASE p_partkey % 5 WHEN 0 THEN 'N' || p_name WHEN 1 THEN p_name || '退' WHEN 2 THEN '*st ' || p_name ELSE p_name END"


@query(f"""SELECT p_partkey, CASE WHEN contains(n, '退') THEN 'delisting' WHEN substr(n, 1, 1) IN ('N', 'C') THEN 'new_listing' WHEN contains(upper(n), 'ST') THEN 'st' ELSE 'keep' END AS reason,
  CASE WHEN contains(n, '退') THEN 'delisting' WHEN substr(n, 1, 1) IN ('N', 'C') THEN 'new_listing' ELSE 'keep' END AS reason_with_st FROM (SELECT p_partkey, {_NAME} AS n FROM part)""")
def p3_exclusion(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part").withColumn("n", F.expr(_NAME))
    return p.select("p_partkey", S.exclusion_reason("n").alias("reason"), S.exclusion_reason("n", include_st=True).alias("reason_with_st"))


@query(with_ctes("""WITH raw AS (SELECT ' ' || lower(code) || CASE WHEN p_partkey % 4 = 0 THEN '.sh' ELSE '.sz' END AS ts_code, CASE WHEN p_partkey % 6 = 0 THEN 'n/a' WHEN p_partkey % 6 = 1 THEN '-1' ELSE (p_partkey / 8.0)::DECIMAL(18, 3)::VARCHAR END AS free_share FROM instruments),
clean AS (SELECT upper(trim(ts_code)) AS code, try_cast(free_share AS DOUBLE) AS x FROM raw)
SELECT code, regexp_replace(regexp_replace(printf('%.10f', x), '0+$', ''), '\\.$', '') AS free_share, count(*) OVER (PARTITION BY code) AS copies FROM clean WHERE regexp_matches(code, '^(000|001|002|003|300|301)[0-9]{3}\\.SZ$') AND x > 0""", "instruments"))
def p4_free_share(spark: SparkSession, d: str) -> DataFrame:
    i, k = A.instruments(spark, d), F.col("p_partkey")
    code = F.concat(F.lit(" "), F.lower("code"), F.when(k % 4 == 0, ".sh").otherwise(".sz"))
    value = F.when(k % 6 == 0, "n/a").when(k % 6 == 1, "-1").otherwise((k / 8).cast("decimal(18,3)").cast("string"))
    return static.clean_free_share(i.select(code.alias("ts_code"), value.alias("free_share")))


def _events_sql(rows: str, time: str, rules: str, fields: dict[str, str]) -> str:
    """Rows with their time's day, judged by ``rules``; the fields of those that pass."""
    common = {"symbol": "lpad(instrument_id::VARCHAR, 6, '0')", "trading_day": "day", "exchange_time_us": f"{time} % 86400000000", "sequence": "appl_seq_num", "qty": "volume::BIGINT"}
    passed = ", ".join(f"CASE WHEN reject_reason IS NULL THEN {x} END AS {n}" for n, x in (common | fields).items())
    return f"""WITH r AS ({rows}), t AS (SELECT *, strftime(DATE '1970-01-01' + ({time} // 86400000000)::INT, '%Y%m%d')::INT AS own FROM r), d AS (SELECT *, own - CASE WHEN appl_seq_num % 50 = 3 THEN 1 ELSE 0 END AS day FROM t),
j AS (SELECT *, CASE WHEN own <> day THEN 'day' WHEN appl_seq_num <= 0 THEN 'sequence' WHEN volume <= 0 OR volume <> floor(volume) THEN 'volume' {rules} END AS reject_reason FROM d)
SELECT appl_seq_num, reject_reason, {passed} FROM j"""


def _other_day(time: str) -> F.Column:
    """The row's day, but one earlier for a fiftieth of them."""
    return normalize.day_of(F.col(time)) - F.when(F.col("appl_seq_num") % 50 == 3, 1).otherwise(0)


@query(with_ctes(_events_sql(
    "SELECT * REPLACE (CASE WHEN appl_seq_num % 40 = 7 THEN 0 ELSE price END AS price, volume - 3 AS volume, CASE WHEN appl_seq_num % 60 = 13 THEN 9 ELSE order_kind END AS order_kind, CASE WHEN appl_seq_num % 70 = 6 THEN NULL ELSE ord_type END AS ord_type) FROM l2_orders", "order_time",
    "WHEN coalesce(order_kind NOT IN (1, 2) OR ord_type NOT IN (1, 2), true) THEN 'kind' WHEN ord_type <> 1 AND price <= 0 THEN 'price'",
    {"tick": "CASE WHEN ord_type <> 1 THEN round(price * 100)::BIGINT END", "kind": "CASE WHEN order_kind = 2 THEN 'cancel' WHEN ord_type = 1 THEN 'market' ELSE 'limit' END"}), "l2_orders"))
def p5_normalize_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders, some without a price, volume or known kind, or of another day."""
    k = F.col("appl_seq_num")
    o = A.l2_orders(spark, d).withColumn("order_kind", F.when(k % 60 == 13, 9).otherwise(F.col("order_kind"))).withColumn("ord_type", F.when(k % 70 != 6, F.col("ord_type")))
    o = o.withColumn("price", F.when(F.col("appl_seq_num") % 40 == 7, 0.0).otherwise(F.col("price"))).withColumn("volume", F.col("volume") - 3)
    return normalize.normalize_orders(o, _other_day("order_time"))


@query(with_ctes(_events_sql(
    "SELECT * REPLACE (CASE WHEN order_kind = 4 AND appl_seq_num % 3 > 0 THEN 0 ELSE offer_appl_seq_num END AS offer_appl_seq_num, volume - 2 AS volume, CASE WHEN appl_seq_num % 45 = 4 THEN 7 ELSE order_kind END AS order_kind) FROM l2_trades", "trade_time",
    "WHEN order_kind NOT IN (1, 4) THEN 'kind' WHEN CASE WHEN order_kind = 4 THEN (bid_appl_seq_num > 0) = (offer_appl_seq_num > 0) ELSE bid_appl_seq_num <= 0 OR offer_appl_seq_num <= 0 END THEN 'link' WHEN order_kind <> 4 AND price <= 0 THEN 'price'",
    {"tick": "CASE WHEN order_kind <> 4 THEN round(price * 100)::BIGINT END", "kind": "CASE WHEN order_kind = 4 THEN 'cancel' ELSE 'trade' END", "bid_sequence": "bid_appl_seq_num", "ask_sequence": "nullif(offer_appl_seq_num, 0)"}), "l2_trades"))
def p6_normalize_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades and cancels, some cancels with one linked order, some with two, some of an unknown kind."""
    one = (F.col("order_kind") == 4) & (F.col("appl_seq_num") % 3 > 0)
    t = A.l2_trades(spark, d).withColumn("offer_appl_seq_num", F.when(one, 0).otherwise(F.col("offer_appl_seq_num"))).withColumn("volume", F.col("volume") - 2)
    t = t.withColumn("order_kind", F.when(F.col("appl_seq_num") % 45 == 4, 7).otherwise(F.col("order_kind")))
    return normalize.normalize_trades(t, _other_day("trade_time"))


@query("SELECT event_id, event_id / 10000 AS price, event_id / 100 AS quantity, event_id / 1000000 AS turnover FROM events")
def p7_wire(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", S.wire_price("event_id").alias("price"), S.wire_quantity("event_id").alias("quantity"), S.wire_turnover("event_id").alias("turnover"))


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') AS symbol FROM part")
def p8_symbols(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").select("p_partkey", S.normalize_symbol(F.concat(F.col("p_partkey").cast("string"), F.lit(".SZ"))).alias("symbol"))


@query(with_ctes("SELECT kind = 'buy' AS is_buy, kind = 'sell' AS is_sell, kind IN ('buy', 'sell') AS is_insert, kind = 'cancel' AS is_cancel, count(*) AS n FROM feed GROUP BY ALL", "feed"))
def p9_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kind")
    return A.feed(spark, d).groupBy((k == "buy").alias("is_buy"), (k == "sell").alias("is_sell"), k.isin("buy", "sell").alias("is_insert"), (k == "cancel").alias("is_cancel")).agg(F.count("*").alias("n"))


@query(with_ctes("SELECT (m >= 555 AND m < 565) OR (m >= 897 AND m < 900) AS auction, count(*) AS n, sum(volume)::BIGINT AS volume FROM (SELECT volume, exchange_time_us / 60000000 AS m FROM feed) GROUP BY 1", "feed"))
def p10_auction(spark: SparkSession, d: str) -> DataFrame:
    return A.feed(spark, d).groupBy(S.is_auction_time("exchange_time_us").alias("auction")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query(with_ctes("SELECT t.appl_seq_num, o.ord_type = 1 AND t.order_kind = 4 AS market_cancel FROM l2_trades t JOIN l2_orders o ON t.bid_appl_seq_num = o.appl_seq_num", "l2_trades", "l2_orders"))
def p11_market_cancels(spark: SparkSession, d: str) -> DataFrame:
    t, o = A.l2_trades(spark, d), A.l2_orders(spark, d).select(F.col("appl_seq_num").alias("bid_appl_seq_num"), "ord_type")
    return t.join(o, "bid_appl_seq_num").select("appl_seq_num", ((F.col("ord_type") == 1) & (F.col("order_kind") == 4)).alias("market_cancel"))


@query(with_ctes("SELECT event_id, last_price > 0 AND list_min(bid_prices) > 0 AND list_min(ask_prices) > 0 AND ask_prices[1] > bid_prices[1] AND list_min(bid_volumes) >= 0 AND list_min(ask_volumes) >= 0 AND volume >= 0 AND turnover >= 0 AS valid FROM snapshots", "snapshots"))
def p12_valid_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return A.snapshots(spark, d).select("event_id", S.valid_snapshot().alias("valid"))


@query(with_ctes("SELECT symbol, sequence FROM candidates WHERE valid AND trading_day >= 20000101 AND exchange_time_us <> 0 AND sequence <> 0 AND turnover >= 0", "candidates"))
def p13_valid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).where(S.valid_candidate()).select("symbol", "sequence")


@query(with_ctes("SELECT forwarded, count(*) AS n FROM (SELECT symbol IN (SELECT DISTINCT lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier WHERE s_nationkey < 10) AS forwarded FROM feed) GROUP BY 1", "feed"))
def p14_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    wanted = A.read(spark, d, "supplier").where("s_nationkey < 10").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol")).distinct().withColumn("forwarded", F.lit(True))
    return A.feed(spark, d).join(wanted, "symbol", "left").groupBy(F.coalesce("forwarded", F.lit(False)).alias("forwarded")).agg(F.count("*").alias("n"))


@query(with_ctes("SELECT shard, kind, count(*) AS n FROM feed WHERE (shard, kind) IN (SELECT (n_nationkey % 8)::INT, CASE WHEN n_nationkey % 2 = 0 THEN 'buy' ELSE 'trade' END FROM nation) GROUP BY ALL", "feed"))
def p15_codes_by_source(spark: SparkSession, d: str) -> DataFrame:
    allowed = A.read(spark, d, "nation").select((F.col("n_nationkey") % 8).cast("int").alias("shard"), F.when(F.col("n_nationkey") % 2 == 0, "buy").otherwise("trade").alias("kind"))
    return A.feed(spark, d).join(allowed, ["shard", "kind"], "left_semi").groupBy("shard", "kind").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN props->>'$.k' IS NULL THEN 'k is required' WHEN (props->>'$.k')::INT < 5 THEN 'k must be 5 or more' WHEN event_type <> 'click' AND event_type <> 'view' THEN 'wrong market' END AS message FROM events""")
def p16_config_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    rules = [(k.isNotNull(), "k is required"), (k.try_cast("int") >= 5, "k must be 5 or more"), (F.col("event_type").isin("click", "view"), "wrong market")]
    return A.read(spark, d, "events").select("event_id", static.first_failure(rules).alias("message"))


@query(with_ctes("SELECT o.appl_seq_num, o.order_time // 86400000000 AS order_day, t.trade_time // 86400000000 AS trade_day FROM l2_orders o JOIN l2_trades t ON t.bid_appl_seq_num = o.appl_seq_num WHERE o.order_time // 86400000000 <> t.trade_time // 86400000000", "l2_orders", "l2_trades"))
def p17_dates_agree(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.floor(F.col(c) / A.DAY_US)
    both = A.l2_orders(spark, d).join(A.l2_trades(spark, d).select(F.col("bid_appl_seq_num").alias("appl_seq_num"), "trade_time"), "appl_seq_num")
    return both.select("appl_seq_num", day("order_time").alias("order_day"), day("trade_time").alias("trade_day")).where("order_day <> trade_day")


@query("SELECT doc_id, lower(substr(hex(encode(text)), 1, 128)) AS prefix FROM documents")
def p18_hex(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents")
    return docs.select("doc_id", S.hex_prefix(F.encode("text", "UTF-8")).alias("prefix"))


@query(with_ctes("SELECT CASE WHEN kind IN ('buy', 'sell') THEN 'order' WHEN kind IN ('trade', 'cancel') THEN 'execution' ELSE 'other' END AS status, count(*) AS n FROM feed GROUP BY 1", "feed"))
def p19_decode_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("kind").isin("buy", "sell"), "order").when(F.col("kind").isin("trade", "cancel"), "execution").otherwise("other")
    return A.feed(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# --- sorting and sets -------------------------------------------------------------


@query(with_ctes("SELECT event_id, row_number() OVER (PARTITION BY shard ORDER BY ts_us, volume, feed_sequence, event_id) AS place, shard FROM feed", "feed"))
def l1_event_order(spark: SparkSession, d: str) -> DataFrame:
    order = ["ts_us", "volume", F.coalesce("feed_sequence", "event_id"), "event_id"]
    return sampling.numbered(A.feed(spark, d), ["shard"], order, "place", large=True).select("event_id", "place", "shard")


@query(with_ctes("SELECT event_id, price FROM feed ORDER BY price DESC, event_id LIMIT 100", "feed"))
def l5_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.feed(spark, d).orderBy(F.desc("price"), "event_id").limit(100).select("event_id", "price")


@query(with_ctes("SELECT kind, count(*) AS n FROM (SELECT kind, shard FROM feed WHERE shard < 4 UNION ALL SELECT kind, shard FROM feed WHERE shard >= 4) GROUP BY 1", "feed"))
def u1_union(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d)
    return f.where("shard < 4").unionByName(f.where("shard >= 4")).groupBy("kind").agg(F.count("*").alias("n"))


@query(with_ctes("SELECT DISTINCT symbol FROM positions WHERE static_position <> 0 AND symbol NOT IN (SELECT symbol FROM feed)", "positions", "feed"))
def u2_orphans(spark: SparkSession, d: str) -> DataFrame:
    return static.orphan_positions(A.feed(spark, d).select("symbol").distinct(), A.positions(spark, d))


@query("""WITH a AS (SELECT substr(column_name, 3) AS c FROM (DESCRIBE customer)), b AS (SELECT substr(column_name, 3) AS c FROM (DESCRIBE supplier)), x AS (SELECT string_agg(c, ',' ORDER BY c) AS names FROM a WHERE c NOT IN (SELECT c FROM b)), y AS (SELECT string_agg(c, ',' ORDER BY c) AS names FROM b WHERE c NOT IN (SELECT c FROM a))
SELECT x.names IS NULL AND y.names IS NULL AS same, coalesce(x.names, '') AS only_first, coalesce(y.names, '') AS only_second FROM x, y""")
def u3_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Columns of customers and suppliers, without the tables' prefixes."""
    a, b = (t.toDF(*[c[2:] for c in t.columns]) for t in (A.read(spark, d, n) for n in ("customer", "supplier")))
    return quality.schema_diff(a, b)


@query("SELECT ticker, count(*) AS n FROM (SELECT c_nationkey || '@' || c_mktsegment AS ticker FROM customer UNION SELECT s_nationkey || '@' || 'BUILDING' FROM supplier) GROUP BY 1")
def u4_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    a = A.read(spark, d, "customer").select(F.concat_ws("@", F.col("c_nationkey"), "c_mktsegment").alias("ticker"))
    b = A.read(spark, d, "supplier").select(F.concat_ws("@", F.col("s_nationkey"), F.lit("BUILDING")).alias("ticker"))
    return a.union(b).distinct().groupBy("ticker").agg(F.count("*").alias("n"))


@query("SELECT ps AS symbol, count(DISTINCT sh) AS shards FROM (SELECT l_partkey AS ps, l_suppkey % 8 AS sh FROM lineitem) GROUP BY 1 HAVING count(DISTINCT sh) > 1")
def u5_shared_symbols(spark: SparkSession, d: str) -> DataFrame:
    return static.shared_symbols(A.read(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), (F.col("l_suppkey") % 8).alias("shard")))


# --- scalar functions -------------------------------------------------------------

_POS = with_ctes("""SELECT symbol, greatest(total_position, 0) AS total, least(greatest(available_position, 0), greatest(total_position, 0)) AS available, greatest(total_position, 0) - static_position AS delta,
  greatest(least(shortable, position_limit) - (greatest(total_position, 0) - static_position) - pending_buy, 0) AS can_buy,
  greatest(least(least(shortable, position_limit + greatest(total_position, 0) - static_position) - pending_sell, static_position + greatest(total_position, 0) - static_position - pending_sell), 0) AS can_sell,
  round(CASE WHEN balance > 0 THEN total_position / balance * 2 ELSE 0 END, 9) AS bias, round(CASE WHEN balance > 0 THEN 0.001 * 2 * 10 / balance ELSE 0 END, 9) AS unit_bias,
  pending_buy = 0 AS buy_flag, pending_sell = 0 AS sell_flag, CASE WHEN shortable // 100 * 100 < 200 THEN 0 ELSE least(shortable // 100 * 100, 1000) END AS lots FROM positions""", "positions")


@query(_POS)
def f1_position_risk(spark: SparkSession, d: str) -> DataFrame:
    """F1 to F5, F9 and F22 over the positions."""
    p = A.positions(spark, d).withColumn("s", S.startup_position("static_position", "total_position", "available_position"))
    return p.select(
        "symbol", "s.total", "s.available", "s.delta", S.max_can_buy("shortable", "position_limit", "s.delta", "pending_buy").alias("can_buy"),
        S.max_can_sell("static_position", "shortable", "position_limit", "s.delta", "pending_sell").alias("can_sell"),
        F.round(S.bias("total_position", "balance", 2), 9).alias("bias"), F.round(S.unit_bias(0.001, 2, 10, "balance"), 9).alias("unit_bias"),
        S.can_buy("pending_buy").alias("buy_flag"), S.can_sell("pending_sell").alias("sell_flag"), S.lot_round("shortable", 100, 200, 1000).alias("lots"))


@query(with_ctes("SELECT event_id, hms, hms >= 93100 AS after FROM (SELECT event_id, (exchange_time_us // 3600000000 * 10000 + exchange_time_us // 60000000 % 60 * 100 + exchange_time_us // 1000000 % 60)::INT AS hms FROM feed)", "feed"))
def f6_cutoff(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d).withColumn("hms", S.hhmmss("exchange_time_us"))
    return f.select("event_id", "hms", S.after_cutoff("hms", 93100).alias("after"))


def _fnv(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({text}, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(f"SELECT p_partkey, {_fnv('s')} AS hash, [2, 4, 6][({_fnv('s')} % 3 + 1)::INT] AS worker FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') || '.SZ' AS s FROM part)")
def f8_fnv(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part").withColumn("s", F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".SZ")))
    return p.select("p_partkey", S.fnv1a32("s").alias("hash"), S.worker_of("s", [2, 4, 6]).alias("worker"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S.%f') AS text, epoch_us(date_trunc('second', ts)) * 1000 AS ns, epoch_us(ts) % 86400000000 // 1000 AS ms FROM events")
def f10_times(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").withColumn("us", A.micros("ts") % A.DAY_US)
    text = S.format_us("us")
    return e.select("event_id", text.alias("text"), S.parse_ns(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ns"), S.time_text_to_ms(F.substring(text, 1, 12)).alias("ms"))


@query("SELECT p_partkey, lpad(p_brand, greatest(12, length(p_brand))::INT, ' ') AS padded, round(p_retailprice * 100)::BIGINT AS tick, regexp_replace(regexp_replace(printf('%.10f', p_retailprice), '0+$', ''), '\\.$', '') AS dec, try_cast(p_brand AS DOUBLE) AS number FROM part")
def f12_text(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part")
    return p.select("p_partkey", S.rjust("p_brand", 12).alias("padded"), S.round_price("p_retailprice").alias("tick"), S.format_decimal("p_retailprice").alias("dec"), S.to_float("p_brand").alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE (o_orderdate::DATE)::VARCHAR END AS day FROM orders")
def f14_dates(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o.select("o_orderkey", S.parse_date(text).cast("string").alias("day"))


@query("""SELECT vec_id, i AS position, round((embedding[64 - i]::DOUBLE - (64 - i) / 100.0::DOUBLE) / (1 + (63 - i) % 3), 6) AS z, round(embedding[i + 1]::DOUBLE / (1 + abs(embedding[i + 1]::DOUBLE)), 6) AS soft, round(1 / (1 + exp(-embedding[i + 1]::DOUBLE)), 6) AS sig FROM embeddings, range(0, 64) t(i)""")
def f16_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All entries of each vector: standardised and taken in the reverse order, and squashed."""
    e = A.read(spark, d, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    mean, std = F.array(*[F.lit((i + 1) / 100) for i in range(64)]), F.array(*[F.lit(1.0 + i % 3) for i in range(64)])
    z = S.zscore("x", mean, std, order=list(range(63, -1, -1)))
    each = e.select("vec_id", F.posexplode(F.arrays_zip(z.alias("z"), "x")).alias("position", "v"))
    values = {"z": F.col("v.z"), "soft": S.softsign("v.x"), "sig": S.sigmoid("v.x")}
    return each.select("vec_id", F.col("position").cast("long").alias("position"), *[F.round(x, 6).alias(n) for n, x in values.items()])


@query("SELECT vec_id, vec_id % 7 > 3 OR len(embedding) <= vec_id % 64 AS finite FROM embeddings")
def f18_is_finite(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which some hold a NaN, an infinity of either sign or a null at some place."""
    k = F.col("vec_id")
    odd = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 7 == 1, F.lit(float("inf"))).when(k % 7 == 2, F.lit(float("-inf"))).when(k % 7 == 3, F.lit(None).cast("double"))
    planted = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((i == k % 64) & (k % 7 <= 3), odd).otherwise(x))
    return A.read(spark, d, "embeddings").select("vec_id", S.all_finite(planted).alias("finite"))


@query("SELECT s_suppkey, '10.0.' || s_nationkey || '.1' AS host, 9000 + s_suppkey::INT AS port FROM supplier")
def f21_endpoint(spark: SparkSession, d: str) -> DataFrame:
    s = A.read(spark, d, "supplier")
    text = F.concat(F.lit("10.0."), F.col("s_nationkey"), F.lit(".1:"), F.col("s_suppkey") + 9000)
    return s.select("s_suppkey", S.endpoint(text).alias("e")).select("s_suppkey", "e.*")


@query(with_ctes("SELECT symbol, round(CASE WHEN b + s = 0 THEN 0 ELSE (b - s) / (b + s) END, 9) AS imbalance FROM (SELECT symbol, sum(CASE WHEN kind = 'buy' THEN volume ELSE 0 END) AS b, sum(CASE WHEN kind = 'sell' THEN volume ELSE 0 END) AS s FROM feed GROUP BY 1)", "feed"))
def f23_imbalance(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("volume")).otherwise(0))
    return A.feed(spark, d).groupBy("symbol").agg(side("buy").alias("b"), side("sell").alias("s")).select("symbol", F.round(S.imbalance("b", "s"), 9).alias("imbalance"))


@query("SELECT c_custkey, c_name || '退市' AS back, length(c_name) + 4 AS n_bytes FROM customer")
def f20_gbk(spark: SparkSession, d: str) -> DataFrame:
    """Names as GBK bytes, two to a Chinese character, and back."""
    own = spark.newSession()
    own.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = A.read(own, d, "customer").select("c_custkey", F.encode(F.concat("c_name", F.lit("退市")), "GBK").alias("bytes"))
    return rows.select("c_custkey", S.gbk_to_utf8("bytes").alias("back"), F.octet_length("bytes").cast("long").alias("n_bytes"))


@query("SELECT event_id, event_type AS instrument, value AS raw_prediction FROM events")
def s5_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of which one file is absent: an absent file is an empty relation."""
    e = A.read(spark, d, "events").select(F.col("event_id").alias("app_sequence"), F.col("event_type").alias("instrument"), F.col("value").alias("raw_prediction"))
    paths = [_written(e, schemas.SAMPLE, "csv"), f"{d}/no_such_samples.csv"]
    there, absent = (readers.read_samples(spark, path).select(F.col("app_sequence").alias("event_id"), "instrument", "raw_prediction") for path in paths)
    return there.unionByName(absent)


for _name, _of, *_columns in [
    ("f1_startup_position", "f1_position_risk", "symbol", "total", "available", "delta"),
    ("f2_max_can_buy", "f1_position_risk", "symbol", "can_buy"), ("f3_max_can_sell", "f1_position_risk", "symbol", "can_sell"),
    ("f4_bias", "f1_position_risk", "symbol", "bias"), ("f5_unit_bias", "f1_position_risk", "symbol", "unit_bias"),
    ("f9_lot_round", "f1_position_risk", "symbol", "lots"), ("f22_flags", "f1_position_risk", "symbol", "buy_flag", "sell_flag"),
    ("f11_time_text", "f10_times", "event_id", "ms"), ("f13_round_price", "f12_text", "p_partkey", "tick"), ("f15_format_decimal", "f12_text", "p_partkey", "dec"),
    ("f19_to_float", "f12_text", "p_partkey", "number"), ("f17_softsign_sigmoid", "f16_vectors", "vec_id", "position", "soft", "sig"),
]:
    part(_name, _of, *_columns)
