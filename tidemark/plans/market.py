"""Queries of joins, aggregations and windows over the feed, orders, trades and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import arbiter, asof, book, factors, quality, sampling, static, stats
from tidemark.plans import adapters as A
from tidemark.plans.adapters import with_ctes
from tidemark.plans.registry import part, query

# --- as-of and equi joins ---------------------------------------------------------

_NEAREST = """WITH snap AS (SELECT shard, event_id, ts_us FROM feed WHERE kind = 'buy'), tick AS (SELECT shard, ts_us AS o FROM feed WHERE kind = 'trade'),
both_ AS (SELECT shard, event_id, ts_us, NULL AS o, 1 AS r FROM snap UNION ALL SELECT shard, NULL, o, o, 0 FROM tick),
near AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY shard ORDER BY ts_us, r ROWS UNBOUNDED PRECEDING) AS p, first_value(o IGNORE NULLS) OVER (PARTITION BY shard ORDER BY ts_us, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM both_)"""


@query(with_ctes("""WITH snap AS (SELECT shard, event_id, ts_us FROM feed WHERE kind = 'buy' AND shard <> 6), tick AS (SELECT shard, ts_us AS o FROM feed WHERE kind = 'trade' AND shard <> 5),""" + _NEAREST.split("AS o FROM feed WHERE kind = 'trade'),", 1)[1] + """
SELECT shard, event_id, least(abs(ts_us - p), abs(ts_us - q)) AS delta, 'ok' AS status FROM near WHERE r = 1 AND shard IN (SELECT shard FROM tick)
UNION ALL SELECT coalesce(a.shard, b.shard), NULL, NULL, 'insufficient' FROM (SELECT DISTINCT shard FROM snap) a FULL JOIN (SELECT DISTINCT shard FROM tick) b ON a.shard = b.shard WHERE a.shard IS NULL OR b.shard IS NULL""", "feed"))
def j1_nearest_tick(spark: SparkSession, d: str) -> DataFrame:
    """Shard 5 has no ticks and shard 6 no snapshots."""
    f = A.feed(spark, d)
    snapshots, ticks = f.where("kind = 'buy' and shard <> 6").select("shard", "event_id", "ts_us"), f.where("kind = 'trade' and shard <> 5").select("shard", "ts_us")
    return asof.nearest_by_key(snapshots, ticks, ["shard"]).select("shard", "event_id", "delta", "status")


@query(with_ctes(_NEAREST + """, deltas AS (SELECT shard, least(abs(ts_us - p), abs(ts_us - q)) AS delta FROM near WHERE r = 1), ranked AS (SELECT shard, delta, row_number() OVER (PARTITION BY shard ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM deltas WHERE delta IS NOT NULL)
SELECT shard, max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0)::BIGINT THEN delta END) AS median, max(CASE WHEN i = round_even((n - 1) * 0.95::DOUBLE, 0)::BIGINT THEN delta END) AS p95, max(CASE WHEN i = round_even((n - 1) * 0.99::DOUBLE, 0)::BIGINT THEN delta END) AS p99 FROM ranked GROUP BY shard""", "feed"))
def a17_relation_stats(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d)
    near = asof.nearest(f.where("kind = 'buy'").select("shard", "event_id", "ts_us"), f.where("kind = 'trade'").select("shard", "ts_us"), ["shard"])
    return stats.rank_percentiles(near, ["shard"], "delta", {"median": (0.5, "round"), "p95": (0.95, "round"), "p99": (0.99, "round")})


_FUTURE = """WITH mids AS (SELECT symbol, ts_us, event_id AS sequence, (ask_prices[1] + bid_prices[1]) / 2 AS mid FROM snapshots)"""
_MID_AT = "(SELECT m.mid FROM mids m WHERE m.symbol = s.symbol AND m.ts_us >= s.ts_us + {} ORDER BY m.ts_us, m.sequence LIMIT 1)"
HORIZONS = {"mid_15": 54_000_000_000, "mid_30": 108_000_000_000, "mid_60": 216_000_000_000}


def _future_mids(spark: SparkSession, d: str) -> DataFrame:
    """Our test events are hours apart, so the horizons are hours where live data have seconds."""
    s = A.snapshots(spark, d)
    mids = s.select("symbol", "ts_us", F.col("event_id").alias("sequence"), ((F.col("ask_prices")[0] + F.col("bid_prices")[0]) / 2).alias("mid"))
    return asof.forward(mids, mids, ["symbol"], "mid", HORIZONS)


@query(with_ctes(_FUTURE + f" SELECT symbol, sequence, {', '.join(f'round({_MID_AT.format(v)}, 6) AS {k}' for k, v in HORIZONS.items())} FROM mids s", "snapshots"))
def j2_future_mid(spark: SparkSession, d: str) -> DataFrame:
    return _future_mids(spark, d).select("symbol", "sequence", *[F.round(c, 6).alias(c) for c in HORIZONS])


@query(with_ctes(_FUTURE + f""", ahead AS (SELECT symbol, sequence, mid, {', '.join(f'{_MID_AT.format(v)} AS {k}' for k, v in HORIZONS.items())} FROM mids s)
SELECT symbol, sequence, CASE WHEN mid > 0 AND mid_15 > 0 AND mid_30 > 0 AND mid_60 > 0 THEN round(((mid_15 / mid - 1) * 1000 + (mid_30 / mid - 1) * 1000 + (mid_60 / mid - 1) * 1000) / 3, 5) END AS target FROM ahead""", "snapshots"))
def f7_targets(spark: SparkSession, d: str) -> DataFrame:
    return _future_mids(spark, d).select("symbol", "sequence", F.round(S.target_permille("mid", *HORIZONS), 5).alias("target"))


@query(with_ctes("""WITH good AS (SELECT * FROM snapshots WHERE bid_prices[5] > 0 AND ask_prices[1] > bid_prices[1] AND last_price > 0)
SELECT symbol, event_id, round(last_price - lag(last_price) OVER w, 6) AS moved, (event_id - lag(event_id) OVER w) AS volume FROM good WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY ts_us, event_id)""", "snapshots"))
def j3_adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    good = A.snapshots(spark, d).where(S.valid_snapshot())
    pairs = asof.previous_pair(good, ["symbol", "trading_day"], ["ts_us", "event_id"], ["last_price", "event_id"])
    return pairs.select("symbol", "event_id", F.round(F.col("last_price") - F.col("previous.last_price"), 6).alias("moved"), (F.col("event_id") - F.col("previous.event_id")).alias("volume"))


@query(with_ctes("SELECT t.appl_seq_num, b.price AS bid_price, o.price AS offer_price FROM l2_trades t LEFT JOIN l2_orders b ON b.appl_seq_num = t.bid_appl_seq_num LEFT JOIN l2_orders o ON o.appl_seq_num = t.offer_appl_seq_num", "l2_trades", "l2_orders"))
def j4_link_orders(spark: SparkSession, d: str) -> DataFrame:
    t, o = A.l2_trades(spark, d), A.l2_orders(spark, d)
    side = lambda s: o.select(F.col("appl_seq_num").alias(f"{s}_appl_seq_num"), F.col("price").alias(f"{s}_price"))
    return t.join(side("bid"), "bid_appl_seq_num", "left").join(side("offer"), "offer_appl_seq_num", "left").select("appl_seq_num", "bid_price", "offer_price")


@query(with_ctes("""WITH fills AS (SELECT side, o, arg_min(price, {'s': appl_seq_num, 'p': price}) AS p FROM l2_links GROUP BY 1, 2),
asked AS (SELECT m.appl_seq_num, m.side, min(CASE WHEN l.side = 'S' THEN l.tick END) AS ask, max(CASE WHEN l.side = 'B' THEN l.tick END) AS bid FROM l2_sided m
  LEFT JOIN l2_levels l ON l.symbol = m.instrument_id AND l.side <> m.side AND l.valid_from <= m.order_time AND (l.valid_to IS NULL OR m.order_time < l.valid_to) WHERE m.ord_type = 1 GROUP BY 1, 2)
SELECT appl_seq_num, a.side, coalesce(round(p * 100)::BIGINT, ask, bid) AS tick, p IS NOT NULL AS from_linked_fill FROM asked a LEFT JOIN fills f ON f.o = a.appl_seq_num AND f.side = a.side""", "l2_book"))
def j5_market_orders(spark: SparkSession, d: str) -> DataFrame:
    """Market orders of both sides take their first linked fill's price, else the best price of the
    other side of the book at their time."""
    o = A.l2_orders(spark, d).where("ord_type = 1").select(F.col("instrument_id").alias("symbol"), A.order_side().alias("side"), F.col("order_time").alias("ts_us"), F.col("appl_seq_num").alias("sequence"))
    t = A.l2_trades(spark, d).where("order_kind = 1")
    fills = [t.where(side).select(F.col(link).alias("order_sequence"), F.col("appl_seq_num").alias("sequence"), F.round(F.col("price") * 100).cast("long").alias("tick")) for link, side in (("bid_appl_seq_num", F.col("bid_appl_seq_num") % 3 != 0), ("offer_appl_seq_num", F.col("offer_appl_seq_num") % 3 == 0))]
    best = book.best_prices(book.intervals(A.l2_book_changes(spark, d)))
    return book.market_order_prices(o, fills[0].union(fills[1]), best).select(F.col("sequence").alias("appl_seq_num"), "side", "tick", "from_linked_fill")


@query(with_ctes("""WITH times AS (SELECT symbol, side, valid_from AS ts_us FROM l2_levels UNION SELECT symbol, side, valid_to FROM l2_levels WHERE valid_to IS NOT NULL)
SELECT t.symbol, t.side, t.ts_us, CASE WHEN t.side = 'B' THEN max(l.tick) ELSE min(l.tick) END AS best FROM times t LEFT JOIN l2_levels l ON l.symbol = t.symbol AND l.side = t.side AND l.valid_from <= t.ts_us AND (l.valid_to IS NULL OR t.ts_us < l.valid_to) GROUP BY 1, 2, 3""", "l2_book"))
def j5_best_prices(spark: SparkSession, d: str) -> DataFrame:
    """Best bid and ask of each instrument from each change of its book on."""
    return book.best_prices(book.intervals(A.l2_book_changes(spark, d)))


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The feed as two runs: the second lacks some rows and differs in some fields."""
    f = A.feed(spark, d).select("event_id", "symbol", "kind", "price", F.col("volume").cast("double").alias("factor_0"))
    k = F.col("event_id")
    other = f.where(k % 997 != 5).withColumn("price", F.when(k % 401 == 3, F.col("price") + 0.01).otherwise(F.col("price") + 0.0001)).withColumn("kind", F.when(k % 503 == 9, "other").otherwise(F.col("kind"))).withColumn("factor_0", F.col("factor_0") * (1 + 1e-7))
    return f, other


_RUNS = """WITH b AS (SELECT event_id, symbol, CASE WHEN event_id % 503 = 9 THEN 'other' ELSE kind END AS kind, CASE WHEN event_id % 401 = 3 THEN price + 0.01 ELSE price + 0.0001 END AS price, volume::DOUBLE * (1 + 1e-7) AS factor_0 FROM feed WHERE event_id % 997 <> 5),
j AS (SELECT f.event_id, b.event_id IS NOT NULL AS both_, f.kind AS k1, b.kind AS k2, f.price AS p1, b.price AS p2, f.volume::DOUBLE AS v1, b.factor_0 AS v2 FROM feed f LEFT JOIN b USING (event_id)),
errors AS (SELECT event_id, 0 AS priority, 'row' AS field, 'ordering' AS category, both_ AS equal, NULL::DOUBLE AS error FROM j
  UNION ALL SELECT event_id, 1, 'symbol', 'exact', true, NULL FROM j
  UNION ALL SELECT event_id, 2, 'kind', 'exact', NOT both_ OR k1 = k2, NULL FROM j
  UNION ALL SELECT event_id, 3, 'price', 'floating', NOT both_ OR abs(p1 - p2) <= 1e-3, abs(p1 - p2) FROM j
  UNION ALL SELECT event_id, 4, 'factor_0', 'floating', NOT both_ OR abs(v1 - v2) <= greatest(1e-5 * greatest(abs(v1), abs(v2)), 1e-6), abs(v1 - v2) FROM j)"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    a, b = _runs(spark, d)
    return quality.field_errors(quality.align(a, b, ["event_id"]), ["event_id"], ["symbol", "kind"], "price", ["factor_0"])


@query(with_ctes(_RUNS + " SELECT CASE WHEN count(*) FILTER (NOT equal) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER (NOT equal AND category = 'exact') AS n_exact, count(*) FILTER (NOT equal AND category = 'floating') AS n_floating, count(*) FILTER (NOT equal AND category = 'ordering') AS n_ordering FROM errors", "feed"))
def j6_replay_compare(spark: SparkSession, d: str) -> DataFrame:
    """J6 and J7: rows aligned by event, verdict and counts by category."""
    return quality.verdict(_errors(spark, d))


@query(with_ctes(_RUNS + " SELECT field, category, count(*) AS n, count(*) FILTER (NOT equal) AS n_differ, round(max(error), 9) AS max_error FROM errors GROUP BY ALL", "feed"))
def a15_divergence(spark: SparkSession, d: str) -> DataFrame:
    return quality.divergence_stats(_errors(spark, d)).withColumn("max_error", F.round("max_error", 9))


@query(with_ctes(_RUNS + " SELECT event_id, field, category FROM errors WHERE NOT equal ORDER BY event_id, priority LIMIT 1", "feed"))
def l4_first_divergence(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_divergence(_errors(spark, d), ["event_id"]).select("event_id", "field", "category")


@query(with_ctes("SELECT f.event_id, event_id % 503 <> 9 OR kind = 'other' AS equal FROM feed f WHERE event_id % 997 <> 5", "feed"))
def j8_live_vs_recovered(spark: SparkSession, d: str) -> DataFrame:
    a, b = _runs(spark, d)
    return quality.live_vs_recovered(a.select("event_id", "symbol", "kind"), b.select("event_id", "symbol", "kind"), "event_id")


_ARBITER = """WITH ok AS (SELECT *, valid AND trading_day >= 20000101 AND exchange_time_us <> 0 AND sequence <> 0 AND turnover >= 0 AS ok0 FROM candidates),
days AS (SELECT *, max(CASE WHEN ok0 THEN trading_day END) OVER (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS day_ FROM ok),
acc AS (SELECT *, coalesce(ok0 AND trading_day = day_ AND exchange_time_us = max(CASE WHEN ok0 AND trading_day = day_ THEN exchange_time_us END) OVER (PARTITION BY symbol, trading_day, source ORDER BY arrival ROWS UNBOUNDED PRECEDING), false) AS accepted FROM days),
state AS (SELECT *, last_value(CASE WHEN accepted AND source = 1 THEN {'x': exchange_time_us, 't': turnover, 's': sequence} END IGNORE NULLS) OVER w AS f, last_value(CASE WHEN accepted AND source = 2 THEN {'x': exchange_time_us, 't': turnover, 's': sequence} END IGNORE NULLS) OVER w AS n,
  max(CASE WHEN accepted THEN exchange_time_us END) OVER w AS newest FROM acc WINDOW w AS (PARTITION BY symbol, day_ ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
fresh AS (SELECT *, full_runtime_valid AND coalesce(newest - f.x <= 14400000000, false) AS fu, coalesce(newest - n.x <= 14400000000, false) AS sf FROM state),
pick AS (SELECT symbol, arrival, day_, accepted, CASE WHEN fu AND (NOT sf OR coalesce(f.t + 0.01 >= n.t, false)) THEN 1 WHEN sf THEN 2 END AS selected, f.s AS fs, n.s AS ns FROM fresh),
rows_ AS (SELECT *, CASE selected WHEN 1 THEN fs WHEN 2 THEN ns END AS selected_sequence FROM pick)"""


def _arbitrated(spark: SparkSession, d: str) -> DataFrame:
    # Four hours stand for the four seconds of live data.
    return arbiter.arbitrate(A.candidates(spark, d), max_age_us=14_400_000_000)


@query(with_ctes(_ARBITER + " SELECT symbol, arrival, accepted, selected, selected_sequence FROM rows_", "candidates"))
def j9_arbitrate(spark: SparkSession, d: str) -> DataFrame:
    """J9, T6 and T7 in batch form."""
    return _arbitrated(spark, d).select("symbol", "arrival", "accepted", "selected", "selected_sequence")


@query(with_ctes(_ARBITER + """, ready AS (SELECT *, lag(selected) OVER w AS ls, lag(selected_sequence) OVER w AS lq FROM rows_ WHERE selected IS NOT NULL WINDOW w AS (PARTITION BY symbol, day_ ORDER BY arrival))
SELECT symbol, arrival, selected, selected_sequence FROM ready WHERE ls IS NULL OR ls <> selected OR lq <> selected_sequence""", "candidates"))
def w8_dispatch_once(spark: SparkSession, d: str) -> DataFrame:
    return arbiter.dispatch_once(_arbitrated(spark, d)).select("symbol", "arrival", "selected", "selected_sequence")


@query(with_ctes("SELECT f.symbol, coalesce(p.static_position, 0) AS static_position FROM (SELECT DISTINCT symbol FROM feed) f LEFT JOIN (SELECT * FROM positions WHERE static_position <> 0) p ON p.symbol = f.symbol", "feed", "positions"))
def j10_inherit(spark: SparkSession, d: str) -> DataFrame:
    return static.inherit_positions(A.feed(spark, d).select("symbol").distinct(), A.positions(spark, d))


@query(with_ctes("""SELECT symbol, now, CASE WHEN known THEN total_position WHEN now >= 93100 THEN 0 END AS total, CASE WHEN known THEN available_position WHEN now >= 93100 THEN 0 END AS available, NOT known AND now < 93100 AS gated
FROM (SELECT p.symbol, (92000 + p.static_position * 2)::INT AS now, b.symbol IS NOT NULL AS known, b.total_position, b.available_position FROM positions p LEFT JOIN (SELECT * FROM positions WHERE total_position > 300) b ON b.symbol = p.symbol)""", "positions"))
def j11_startup_sync(spark: SparkSession, d: str) -> DataFrame:
    p = A.positions(spark, d)
    params = p.select("symbol", (92000 + F.col("static_position") * 2).cast("int").alias("now"))
    return static.startup_sync(params, p.where("total_position > 300"), F.col("now"), 93100).select("symbol", "now", "total", "available", "gated")


_HEALTH = "CASE {} % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'healthy' END"


@query("""WITH s AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, (s_suppkey % 25)::INT AS shard, s_nationkey % 3 AS td FROM supplier)
SELECT symbol, reason = 'ok' AS new_risk, reason IN ('ok', 'journal') AS reduce_risk, reason FROM (
  SELECT symbol, CASE WHEN n_regionkey = 0 THEN 'feed' WHEN NOT (n_nationkey % 5 <> 4 AND td <> 2) THEN 'not_ready' WHEN n_nationkey % 4 = 1 THEN 'journal' ELSE 'ok' END AS reason FROM s JOIN nation ON n_nationkey = shard)""")
def j12_can_trade(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers are symbols; nations are shards with their feed, journal and readiness."""
    symbols = A.read(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("s_suppkey") % 25).cast("int").alias("shard"), (F.col("s_nationkey") % 3).alias("td_id"))
    n = A.read(spark, d, "nation").withColumn("shard", F.col("n_nationkey").cast("int"))
    shards = n.select("shard", (F.col("n_nationkey") % 5 != 4).alias("ready"))
    feeds = n.select("shard", F.when(F.col("n_regionkey") == 0, "failed").otherwise("healthy").alias("feed_state"), F.when(F.col("n_nationkey") % 4 == 1, "degraded").otherwise("healthy").alias("journal_state"))
    td = n.select((F.col("n_nationkey") % 3).alias("td_id"), (F.col("n_nationkey") % 3 != 2).alias("td_ready")).distinct()
    return static.can_trade(symbols, shards, feeds, td).select("symbol", "new_risk", "reduce_risk", "reason")


@query(with_ctes("SELECT f.event_id, p_size * 1000.0::DOUBLE AS free_share FROM feed f JOIN part ON lpad(p_partkey::VARCHAR, 6, '0') = f.symbol", "feed"))
def j13_static_enrich(spark: SparkSession, d: str) -> DataFrame:
    share = A.instruments(spark, d).select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("symbol"), "free_share")
    return A.feed(spark, d).join(share, "symbol").select("event_id", "free_share")


@query(with_ctes("SELECT s.shard_id, count(*) AS n FROM feed f LEFT JOIN (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, (s_suppkey % 8)::INT AS shard_id FROM supplier WHERE s_suppkey % 5 <> 0) s ON s.symbol = f.symbol GROUP BY 1", "feed"))
def j14_route(spark: SparkSession, d: str) -> DataFrame:
    owners = A.read(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("s_suppkey") % 8).cast("int").alias("shard"))
    return static.route(A.feed(spark, d), owners).groupBy("shard_id").agg(F.count("*").alias("n"))


@query(with_ctes("SELECT p_partkey, code FROM instruments WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')", "instruments"))
def j16_universe_anti(spark: SparkSession, d: str) -> DataFrame:
    excluded = A.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return A.instruments(spark, d).join(excluded, "p_partkey", "left_anti").select("p_partkey", "code")


@query(with_ctes("""WITH a AS (SELECT symbol, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', k, event_id, kind)), 1, 8))::BIGINT)::BIGINT AS digest FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS k FROM feed) GROUP BY 1),
b AS (SELECT symbol, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', k, event_id, kind)), 1, 8))::BIGINT)::BIGINT AS digest FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS k FROM feed WHERE event_id % 700 <> 3) GROUP BY 1)
SELECT a.symbol, a.n AS n_first, b.n AS n_second, coalesce(a.digest = b.digest, false) AS same FROM a LEFT JOIN b USING (symbol)""", "feed"))
def j17_parity(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d)
    a, b = (quality.parity_digest(x, "symbol", ["event_id", "kind"], ["ts_us", "event_id"]) for x in (f, f.where("event_id % 700 <> 3")))
    both = a.select("symbol", F.col("n").alias("n_first"), F.col("digest").alias("x")).join(b.select("symbol", F.col("n").alias("n_second"), F.col("digest").alias("y")), "symbol", "full_outer")
    return both.select("symbol", "n_first", "n_second", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


# --- books ------------------------------------------------------------------------

_BOOK = """WITH states AS (SELECT symbol, side, tick, ts_us, sum(qty) OVER w AS q, sum(orders) OVER w AS o, lead(ts_us) OVER (PARTITION BY symbol, side, tick ORDER BY ts_us, sequence) AS valid_to, min(ts_us) OVER (PARTITION BY symbol, side, tick) AS since
  FROM book_changes WINDOW w AS (PARTITION BY symbol, side, tick ORDER BY ts_us, sequence ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT symbol, side, tick, ts_us AS valid_from, valid_to, q::BIGINT AS qty, o::BIGINT AS n_orders, since FROM states WHERE q > 0 AND (valid_to IS NULL OR valid_to > ts_us)),
samples AS (SELECT symbol, trading_day, max(ts_us) AS ts_us FROM feed GROUP BY 1, 2),
alive AS (SELECT s.trading_day, s.ts_us, l.* FROM samples s JOIN levels l ON l.symbol = s.symbol AND l.valid_from <= s.ts_us AND (l.valid_to IS NULL OR s.ts_us < l.valid_to)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_us, side ORDER BY CASE WHEN side = 'B' THEN -tick ELSE tick END) AS rank FROM alive)"""
_KEY = ["symbol", "trading_day", "ts_us"]


def _alive(spark: SparkSession, d: str) -> DataFrame:
    """The book of each symbol at the end of each day."""
    samples = A.feed(spark, d).groupBy("symbol", "trading_day").agg(F.max("ts_us").alias("ts_us"))
    return book.book_at(samples, book.intervals(A.book_changes(spark, d)))


@query(with_ctes("SELECT symbol, side, tick, sum(qty)::BIGINT AS qty, sum(orders)::BIGINT AS n_orders FROM book_changes GROUP BY ALL", "book_changes"))
def a1_level_volume(spark: SparkSession, d: str) -> DataFrame:
    return book.level_volume(A.book_changes(spark, d))


@query(with_ctes(_BOOK + " SELECT symbol, side, tick, valid_from, valid_to, qty, n_orders FROM levels", "feed", "book_changes"))
def a2_intervals(spark: SparkSession, d: str) -> DataFrame:
    return book.intervals(A.book_changes(spark, d)).drop("since")


@query(with_ctes("SELECT sequence, (sum(qty) OVER w)::BIGINT AS level_qty, (sum(orders) OVER w)::BIGINT AS level_orders FROM book_changes WINDOW w AS (PARTITION BY symbol, side, tick ORDER BY ts_us, sequence ROWS UNBOUNDED PRECEDING)", "book_changes"))
def w4_running_levels(spark: SparkSession, d: str) -> DataFrame:
    return book.running_levels(A.book_changes(spark, d)).select("sequence", "level_qty", "level_orders")


@query(with_ctes(_BOOK + " SELECT symbol, trading_day, side, tick, qty FROM alive", "feed", "book_changes"))
def j15_book_at(spark: SparkSession, d: str) -> DataFrame:
    return _alive(spark, d).select("symbol", "trading_day", "side", "tick", "qty")


@query(with_ctes(_BOOK + """, traded AS (SELECT s.symbol, s.trading_day, arg_max(f.price, {'t': f.ts_us, 'e': f.event_id}) AS last_price, coalesce(sum(f.volume), 0)::BIGINT AS volume, round(coalesce(sum(f.price * f.volume), 0), 3) AS turnover
  FROM samples s LEFT JOIN feed f ON f.symbol = s.symbol AND f.ts_us <= s.ts_us AND f.kind = 'trade' GROUP BY 1, 2)
SELECT symbol, trading_day, coalesce(string_agg(CASE WHEN side = 'B' THEN tick || ':' || qty END, ',' ORDER BY rank), '') AS bids, coalesce(string_agg(CASE WHEN side = 'S' THEN tick || ':' || qty END, ',' ORDER BY rank), '') AS asks, last_price, volume, turnover
FROM ranked JOIN traded USING (symbol, trading_day) WHERE rank <= 5 GROUP BY ALL""", "feed", "book_changes"))
def a3_visible_book(spark: SparkSession, d: str) -> DataFrame:
    """The best five levels of each side beside last price, volume and turnover."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["tick"], x["qty"])), ",").alias(c)
    trades = A.feed(spark, d).where("kind = 'trade'").select("symbol", "ts_us", F.col("event_id").alias("sequence"), "price", "volume")
    rows = book.with_trades(book.visible_book(_alive(spark, d), _KEY, 5), trades)
    return rows.select("symbol", "trading_day", text("bids"), text("asks"), "last_price", "volume", F.round("turnover", 3).alias("turnover"))


_ZONES = {"pct1": "away <= 1", "pct5": "away <= 5", "pct10": "away <= 10", "l1": "rank <= 1", "l5": "rank <= 5", "all": "true"}
_AGG = _BOOK + ", best AS (SELECT symbol, ts_us, max(CASE WHEN side = 'B' THEN tick END) AS b1, min(CASE WHEN side = 'S' THEN tick END) AS a1 FROM alive GROUP BY ALL), rows_ AS (SELECT r.*, b1, a1, (b1 + a1) / 2 AS mid, abs(tick - (b1 + a1) / 2) / nullif((b1 + a1) / 2, 0) * 100 AS away FROM ranked r JOIN best b ON b.symbol = r.symbol AND b.ts_us = r.ts_us WHERE b1 + a1 IS NOT NULL)"
#: Levels younger than this count as young; our test events are hours apart.
_YOUNG_US = 2 * A.DAY_US


def _zone_sums() -> str:
    what = {"volume": "qty", "count": "n_orders", "age": "ts_us - since", "price": "tick", "amount": "qty * tick"}
    sides = {"bid": "B", "ask": "S"}
    sums = [f"sum(CASE WHEN side = '{s}' AND {cond} THEN {expr} ELSE 0 END)::BIGINT AS {n}_{z}_{w}" for n, s in sides.items() for z, cond in _ZONES.items() for w, expr in what.items()]
    sums += [f"sum(CASE WHEN side = '{s}' AND away <= 1 AND ts_us - since <= {_YOUNG_US} THEN qty ELSE 0 END)::BIGINT AS {n}_young_volume" for n, s in sides.items()]
    return ", ".join(sums + [f"max(CASE WHEN side = '{s}' THEN qty END) AS {n}_max_volume, arg_max(tick, {{'q': qty, 'd': -tick}}) FILTER (side = '{s}') AS {n}_max_tick" for n, s in sides.items()])


@query(with_ctes(_AGG + f" SELECT symbol, trading_day, b1, a1, mid, {_zone_sums()} FROM rows_ GROUP BY ALL", "feed", "book_changes"))
def a4_full_book(spark: SparkSession, d: str) -> DataFrame:
    return book.full_book_aggregate(_alive(spark, d), _KEY, young_us=_YOUNG_US).drop("ts_us")


@query(with_ctes(_BOOK + " SELECT symbol, trading_day, side, tick, qty, rank::INT AS rank FROM ranked WHERE rank <= 3", "feed", "book_changes"))
def l2_top_levels(spark: SparkSession, d: str) -> DataFrame:
    return book.top_levels(_alive(spark, d), _KEY, 3).select("symbol", "trading_day", "side", "tick", "qty", "rank")


@query(with_ctes(_BOOK + ", m AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_us, side ORDER BY qty DESC, tick) AS k FROM alive) SELECT symbol, trading_day, side, tick, qty FROM m WHERE k = 1", "feed", "book_changes"))
def l3_max_volume_level(spark: SparkSession, d: str) -> DataFrame:
    return book.max_volume_level(_alive(spark, d), _KEY).drop("ts_us")


@query(with_ctes("SELECT symbol, side, string_agg(tick || ':' || qty, ',' ORDER BY tick) AS levels FROM (SELECT symbol, side, tick, sum(qty)::BIGINT AS qty FROM book_changes GROUP BY ALL) WHERE qty > 0 GROUP BY ALL", "book_changes"))
def a28_pending_volume(spark: SparkSession, d: str) -> DataFrame:
    return book.pending_volume(A.book_changes(spark, d)).select("symbol", "side", F.array_join(F.transform(F.map_entries("levels"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("levels"))


# --- flow and factors -------------------------------------------------------------

_FLOW = """SELECT symbol, trading_day, sum(CASE WHEN k = 'order' AND b AND NOT m THEN volume ELSE 0 END)::BIGINT AS order_pf, sum(CASE WHEN k = 'order' AND NOT b AND NOT m THEN volume ELSE 0 END)::BIGINT AS order_nf, sum(CASE WHEN k = 'order' AND m THEN CASE WHEN b THEN volume ELSE -volume END ELSE 0 END)::BIGINT AS order_mf,
  count(*) FILTER (k = 'trade' AND b) AS trade_pcf, count(*) FILTER (k = 'trade' AND NOT b) AS trade_ncf, sum(CASE WHEN k = 'trade' AND b THEN price * volume ELSE 0 END) AS trade_pt, sum(CASE WHEN k = 'trade' AND NOT b THEN price * volume ELSE 0 END) AS trade_nt,
  sum(CASE WHEN k = 'cancel' AND b THEN volume ELSE 0 END)::BIGINT AS cxl_buy_flow, sum(CASE WHEN k = 'cancel' AND NOT b THEN volume ELSE 0 END)::BIGINT AS cxl_sell_flow, sum(CASE WHEN k = 'order' AND b THEN volume ELSE 0 END)::BIGINT AS buy_order_volume, sum(CASE WHEN k = 'order' AND NOT b THEN volume ELSE 0 END)::BIGINT AS sell_order_volume
  FROM (SELECT *, CASE WHEN kind IN ('buy', 'sell') THEN 'order' ELSE kind END AS k, CASE WHEN kind IN ('buy', 'sell') THEN kind = 'buy' ELSE event_id % 2 = 0 END AS b, event_id % 10 = 1 AS m FROM feed) GROUP BY 1, 2"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    """Order flow of the feed; a tenth are market orders, and trades and cancels take sides by number."""
    is_order = F.col("kind").isin("buy", "sell")
    side = F.when(is_order, F.when(F.col("kind") == "buy", "B").otherwise("S")).otherwise(F.when(F.col("event_id") % 2 == 0, "B").otherwise("S"))
    rows = A.feed(spark, d).select("symbol", "trading_day", "price", "volume", side.alias("side"), (F.col("event_id") % 10 == 1).alias("is_market"), F.when(is_order, "order").otherwise(F.col("kind")).alias("kind"))
    return factors.order_flow(rows, ["symbol", "trading_day"])


def _full_book_sql() -> str:
    part_of = lambda x, y: f"CASE WHEN {x} + {y} = 0 THEN 0 ELSE ({x} - {y}) / ({x} + {y}) END"
    per = lambda x, y: f"coalesce(({x}) / nullif({y}, 0), 0)"
    both = lambda z, w: part_of(f"bid_{z}_{w}", f"ask_{z}_{w}")
    mean = lambda z, w: part_of(*[per(f"{s}_{z}_{w}", f"{s}_{z}_count") for s in ("bid", "ask")])
    far = lambda s: per(f"abs({s}_max_tick - mid)", "mid")
    columns = {
        "positive_fill_rate": per("trade_pt", "buy_order_volume * mid"), "negative_fill_rate": per("trade_nt", "sell_order_volume * mid"), "order_flow_imbalance": part_of("order_pf", "order_nf"),
        "cfr_imbalance": part_of(per("cxl_buy_flow", "buy_order_volume"), per("cxl_sell_flow", "sell_order_volume")),
        **{f"book_fixdist_{n}_{b}pct": both(f"pct{b}", w) for n, w in (("imbalance", "volume"), ("weighted", "amount")) for b in (1, 5)},
        **{f"book_{n}_imbalance{t}": f(z, w) for n, f, w in (("avg_size", mean, "volume"), ("count", both, "count"), ("life", mean, "age")) for t, z in (("", "all"), ("_l1", "l1"), ("_l5", "l5"))},
        "max_bid_distance_ratio": far("bid"), "max_ask_distance_ratio": far("ask"), "max_vol_distance_imbalance": part_of(far("bid"), far("ask")), "book_young_imbalance_1pct": part_of("bid_young_volume", "ask_young_volume"),
        "book_fixdist_hermes": "coalesce(((a1 * bid_pct1_volume + b1 * ask_pct1_volume) / nullif(bid_pct1_volume + ask_pct1_volume, 0) / nullif(mid, 0) - 1) * 1000, 0)",
    }
    rounded = ", ".join(f"round({x}, {_book_places(n)}) + 0 AS factor_{n}" for n, x in columns.items())
    return f"{_AGG}, agg AS (SELECT symbol, trading_day, b1, a1, mid, {_zone_sums()} FROM rows_ GROUP BY ALL), flow AS ({_FLOW}) SELECT symbol, trading_day, {rounded}, bid_all_count > 0 AND ask_all_count > 0 AS valid FROM agg JOIN flow USING (symbol, trading_day)"


def _book_places(name: str) -> int:
    return 6 if name.endswith("hermes") else 9


@query(with_ctes(_full_book_sql(), "feed", "book_changes"))
def a8_full_book_factors(spark: SparkSession, d: str) -> DataFrame:
    whole = book.full_book_aggregate(_alive(spark, d), _KEY, young_us=_YOUNG_US)
    rows = factors.full_book_factors(whole.join(_flow(spark, d), ["symbol", "trading_day"]))
    return rows.select("symbol", "trading_day", *[F.round(c, _book_places(c)).alias(c) for c in factors.FULL_BOOK], "valid")


@query(with_ctes(f"SELECT * REPLACE (round(trade_pt, 4) AS trade_pt, round(trade_nt, 4) AS trade_nt) FROM ({_FLOW})", "feed"))
def a5_order_flow(spark: SparkSession, d: str) -> DataFrame:
    return _flow(spark, d).withColumns({c: F.round(c, 4) for c in ("trade_pt", "trade_nt")})


_FLOW_SUMS = dict(zip(factors.FLOW, ["order_pf - order_nf", "order_mf", "cxl_buy_flow", "cxl_sell_flow", "trade_pt", "trade_nt", "trade_pt + trade_nt"]))


@query(with_ctes(f"""SELECT symbol, trading_day, {', '.join(f'round(({x}) / (p_retailprice * p_size * 100), 9) + 0 AS {n}' for n, x in _FLOW_SUMS.items())} FROM ({_FLOW}) JOIN part ON lpad(p_partkey::VARCHAR, 6, '0') = symbol""", "feed"))
def a7_flow_factors(spark: SparkSession, d: str) -> DataFrame:
    history = A.instruments(spark, d).select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("symbol"), "history_amount")
    rows = factors.flow_factors(_flow(spark, d).join(history, "symbol"))
    return rows.select("symbol", "trading_day", *[F.round(c, 9).alias(c) for c in factors.FLOW])


def places(name: str) -> int:
    """Decimals that are compared: of parts of one more than of permille."""
    return 8 if name.endswith(("_ratio", "_imbalance", "_share", "turnover")) else 6 if name.endswith("on_tick") else 5


def _market_sql() -> str:
    """All market factors; the five levels are written out."""
    added = lambda c, k=5: "(" + " + ".join(f"{c}[{i}]" for i in range(1, k + 1)) + ")::DOUBLE"
    vwap = lambda s: "(" + " + ".join(f"{s}_prices[{i}] * {s}_volumes[{i}]" for i in range(1, 6)) + f") / nullif({added(s + '_volumes')}, 0)"
    falling = lambda c: "(" + " + ".join(f"{c}[{i}] / {i}.0::DOUBLE" for i in range(1, 6)) + ")"
    micro = lambda k: f"(ask_prices[1] * {added('bid_volumes', k)} + bid_prices[1] * {added('ask_volumes', k)}) / nullif({added('bid_volumes', k)} + {added('ask_volumes', k)}, 0)"
    part_of = lambda x, y: f"CASE WHEN {x} + {y} = 0 THEN 0 ELSE ({x} - {y}) / ({x} + {y}) END"
    permille = lambda x, y: f"(({x}) / nullif({y}, 0) - 1) * 1000"
    columns = {
        "hermes_permille": permille("m1", "mid"), "spread": "(ask_prices[1] - bid_prices[1]) / mid * 1000", "mid_return": permille("mid", "pmid"), "tr_sqrt_positive": f"CASE WHEN pmid IS NOT NULL THEN sqrt(greatest({permille('mid', 'pmid')}, 0)) END",
        "percent_turnover": "(turnover - pturnover) / nullif(turnover, 0)", "fee_on_tick": "mid * 0.0005 / 0.01", "bid_volume_change_ratio": part_of("bt", "pbt"), "ask_volume_change_ratio": part_of("at_", "pat"),
        **{f"weighted_return_{k}": permille(f"m{k}", "pmid") for k in range(1, 6)}, "weighted_ask": permille("va", "mid"), "weighted_bid": permille("vb", "mid"), "weighted_ask_return": permille("va", "pva"), "weighted_bid_return": permille("vb", "pvb"),
        "weighted_volume_imbalance": part_of(falling("bid_volumes"), falling("ask_volumes")), "volume_imbalance": part_of("bt", "at_"), "ask_l1_share": "ask_volumes[1] / nullif(at_, 0)", "bid_l1_share": "bid_volumes[1] / nullif(bt, 0)",
    }
    micros = ", ".join(f"{micro(k)} AS m{k}" for k in range(1, 6))
    return f"""WITH t AS (SELECT *, (ask_prices[1] + bid_prices[1]) / 2 AS mid, {added('bid_volumes')} AS bt, {added('ask_volumes')} AS at_, {vwap('bid')} AS vb, {vwap('ask')} AS va, {micros} FROM snapshots),
l AS (SELECT *, lag(mid) OVER w AS pmid, lag(bt) OVER w AS pbt, lag(at_) OVER w AS pat, lag(vb) OVER w AS pvb, lag(va) OVER w AS pva, lag(turnover) OVER w AS pturnover FROM t WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY ts_us, event_id))
SELECT event_id, {', '.join(f'round({x}, {places(n)}) + 0 AS factor_{n}' for n, x in columns.items())} FROM l WHERE mid > 0"""


@query(with_ctes(_market_sql(), "snapshots"))
def a6_market_factors(spark: SparkSession, d: str) -> DataFrame:
    rows = factors.market_factors(A.snapshots(spark, d), ["symbol", "trading_day"], ["ts_us", "event_id"]).where("mid > 0")
    return rows.select("event_id", *[F.round(c, places(c)).alias(c) for c in factors.MARKET])


def _paired_sql() -> str:
    """All 36 floats; levels are matched position by position and price by price, written out."""
    part_of = lambda x, y: f"CASE WHEN {x} + {y} = 0 THEN 0 ELSE ({x} - {y}) / ({x} + {y}) END"
    imbalance = lambda i, side="": part_of(f"{side}bid_volumes[{i}]", f"{side}ask_volumes[{i}]")
    columns = [f"round({imbalance(i)}, 8) + 0 AS level_imbalance_{i}, round({imbalance(i)} - ({imbalance(i, 'p.')}), 8) + 0 AS level_change_{i}" for i in range(1, 6)]
    columns += [f"round(({s}_prices[{i}] / nullif(p.{s}_prices[{i}], 0) - 1) * 1000, 5) + 0 AS {s}_return_{i}" for i in range(1, 6) for s in ("bid", "ask")]
    columns += ["volume - p.volume AS interval_volume", "round(turnover - p.turnover, 4) AS interval_turnover"]
    matched = []
    for s, fn, seen in (("bid", "greatest", ">="), ("ask", "least", "<=")):
        worst = f"{fn}({s}_prices[5], p.{s}_prices[5])"
        for name, here, there in (("added", "", "p."), ("removed", "p.", "")):
            at = lambda i, s=s, there=there, here=here: "(" + " + ".join(f"CASE WHEN {there}{s}_prices[{j}] = {here}{s}_prices[{i}] THEN {there}{s}_volumes[{j}] ELSE 0 END" for j in range(1, 6)) + ")"
            matched.append("(" + " + ".join(f"CASE WHEN {here}{s}_prices[{i}] {seen} {worst} THEN greatest({here}{s}_volumes[{i}] - {at(i)}, 0) ELSE 0 END" for i in range(1, 6)) + f")::BIGINT AS {s}_{name}")
            matched.append("(" + " + ".join(f"CASE WHEN {here}{s}_prices[{i}] {seen} {worst} AND NOT list_contains({there}{s}_prices, {here}{s}_prices[{i}]) THEN 1 ELSE 0 END" for i in range(1, 6)) + f")::BIGINT AS {s}_{'new' if name == 'added' else 'gone'}_levels")
    vwap = lambda s, side="": "(" + " + ".join(f"{side}{s}_prices[{i}] * {side}{s}_volumes[{i}]" for i in range(1, 6)) + ") / nullif(" + " + ".join(f"{side}{s}_volumes[{i}]" for i in range(1, 6)) + ", 0)"
    best = lambda s, up, down: f"CASE WHEN {s}_prices[1] {up} p.{s}_prices[1] THEN {s}_volumes[1] WHEN {s}_prices[1] {down} p.{s}_prices[1] THEN -p.{s}_volumes[1] ELSE {s}_volumes[1] - p.{s}_volumes[1] END"
    more = [f"round(({vwap(s)}) / nullif({vwap(s, 'p.')}, 0) * 1000 - 1000, 5) + 0 AS {s}_shift" for s in ("bid", "ask")]
    more += [f"(({best('bid', '>', '<')}) - ({best('ask', '<', '>')}))::BIGINT AS best_order_flow", "round((turnover - p.turnover) / nullif(volume - p.volume, 0) / nullif((ask_prices[1] + bid_prices[1]) / 2, 0) * 1000 - 1000, 5) + 0 AS interval_price"]
    flow = "bid_added - bid_removed - ask_added + ask_removed AS matched_order_flow, round(" + part_of("(bid_added + ask_removed)", "(bid_removed + ask_added)") + ", 8) + 0 AS matched_imbalance"
    return f"""WITH good AS (SELECT * FROM snapshots WHERE bid_prices[5] > 0 AND ask_prices[1] > bid_prices[1] AND last_price > 0),
l AS (SELECT *, lag({{'bid_prices': bid_prices, 'ask_prices': ask_prices, 'bid_volumes': bid_volumes, 'ask_volumes': ask_volumes, 'volume': volume, 'turnover': turnover}}) OVER (PARTITION BY symbol, trading_day ORDER BY ts_us, event_id) AS p FROM good)
SELECT *, {flow} FROM (SELECT event_id, {', '.join(columns + matched + more)} FROM l WHERE p IS NOT NULL)"""


@query(with_ctes(_paired_sql(), "snapshots"))
def a9_paired_factors(spark: SparkSession, d: str) -> DataFrame:
    rows = factors.paired_factors(A.snapshots(spark, d).where(S.valid_snapshot()), ["symbol", "trading_day"], ["ts_us", "event_id"])
    digits = {c: 8 if c.startswith("level_") or c == "matched_imbalance" else 4 if c == "interval_turnover" else 5 for c in factors.PAIRED}
    return rows.select("event_id", *[F.round(c, n).alias(c) if rows.schema[c].dataType.typeName() == "double" else F.col(c) for c, n in digits.items()])


part("j7_event_replay", "j6_replay_compare", "n_exact", "n_floating", "n_ordering")
part("t6_arbiter_rules", "j9_arbitrate", "symbol", "arrival", "selected", "selected_sequence")
part("t7_late_rules", "j9_arbitrate", "symbol", "arrival", "accepted")
