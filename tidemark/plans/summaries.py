"""Queries of summaries, windows, audits and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, factors, sampling, scoring, static, stats
from tidemark.plans import adapters as A
from tidemark.plans import market
from tidemark.plans.adapters import with_ctes
from tidemark.plans.registry import ORACLE_SQL, part, query

_RANKED = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM feed)"


@query(with_ctes(_RANKED + """ SELECT shard, count(*) AS events, count(*) FILTER (kind = 'trade') AS samples, count(*) FILTER (kind = 'malformed') AS invalid, max(CASE WHEN i = ceil((n - 1) * 0.5)::BIGINT THEN price END) AS p50,
  max(CASE WHEN i = ceil((n - 1) * 0.01)::BIGINT THEN price END) AS p01, max(CASE WHEN i = ceil((n - 1) * 0.99)::BIGINT THEN price END) AS p99 FROM r GROUP BY shard""", "feed"))
def a10_shard_summary(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d)
    counts = f.groupBy("shard").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "trade").alias("samples"), F.count_if(F.col("kind") == "malformed").alias("invalid"))
    return counts.join(stats.rank_percentiles(f, ["shard"], "price", {"p50": (0.5, "ceil"), "p01": (0.01, "ceil"), "p99": (0.99, "ceil")}), "shard")


@query(with_ctes("SELECT symbol, count(*) AS events, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM feed GROUP BY 1", "feed"))
def a11_instrument_counters(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d)
    pivot = f.groupBy("symbol").pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)
    return f.groupBy("symbol").agg(F.count("*").alias("events")).join(pivot, "symbol")


@query(with_ctes("WITH r AS (SELECT shard, volume, row_number() OVER (PARTITION BY shard ORDER BY volume) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM feed) SELECT shard, count(*) AS n, round(avg(volume), 6) AS mean, max(CASE WHEN i = (n - 1) // 2 THEN volume END) AS p50, max(CASE WHEN i = (n - 1) * 99 // 100 THEN volume END) AS p99, max(volume) AS max FROM r GROUP BY shard", "feed"))
def a12_latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.latency_summary(A.feed(spark, d), ["shard"], "volume").withColumn("mean", F.round("mean", 6))


@query(with_ctes(_RANKED + " SELECT shard, (sum(tick) // count(*))::BIGINT AS avg, max(CASE WHEN i = floor((n - 1) * 0.5)::BIGINT THEN price END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95)::BIGINT THEN price END) AS p95, max(CASE WHEN i = floor((n - 1) * 0.99)::BIGINT THEN price END) AS p99 FROM r GROUP BY shard", "feed"))
def a13_latency_bench(spark: SparkSession, d: str) -> DataFrame:
    f = A.feed(spark, d)
    mean = f.groupBy("shard").agg(F.expr("sum(tick) div count(*)").alias("avg"))
    return mean.join(stats.rank_percentiles(f, ["shard"], "price", {"p50": (0.5, "floor"), "p95": (0.95, "floor"), "p99": (0.99, "floor")}), "shard")


@query(with_ctes(_RANKED + " SELECT shard, max(CASE WHEN i = ceil((n - 1) * 0.75)::BIGINT THEN price END) AS up, max(CASE WHEN i = floor((n - 1) * 0.75)::BIGINT THEN price END) AS down, max(CASE WHEN i = round_even((n - 1) * 0.75, 0)::BIGINT THEN price END) AS even FROM r GROUP BY shard", "feed"))
def a14_percentile_rules(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_percentiles(A.feed(spark, d), ["shard"], "price", {"up": (0.75, "ceil"), "down": (0.75, "floor"), "even": (0.75, "round")})


@query(with_ctes("""WITH g AS (SELECT kind AS channel, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY kind ORDER BY ts_us) AS gap FROM feed), r AS (SELECT channel, gap, row_number() OVER (PARTITION BY channel ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM g WHERE gap IS NOT NULL),
p AS (SELECT channel, max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0)::BIGINT THEN gap END) AS gap_median, max(CASE WHEN i = round_even((n - 1) * 0.99::DOUBLE, 0)::BIGINT THEN gap END) AS gap_p99 FROM r GROUP BY 1)
SELECT b.*, gap_median, gap_p99 FROM (SELECT channel, count(*) AS n, min(ts_us) AS first, max(ts_us) AS last FROM g GROUP BY 1) b LEFT JOIN p USING (channel)""", "feed"))
def a16_channel_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.channel_stats(A.feed(spark, d).withColumnRenamed("kind", "channel"), "channel", "ts_us")


@query(with_ctes("SELECT shard, coalesce(sum(CASE WHEN kind = 'trade' THEN tick END) // nullif(count(*) FILTER (kind = 'trade'), 0), 0)::BIGINT AS trade_avg, coalesce(sum(CASE WHEN kind = 'none' THEN tick END) // nullif(count(*) FILTER (kind = 'none'), 0), 0)::BIGINT AS none_avg FROM feed GROUP BY 1 HAVING count(*) > 0", "feed"))
def a18_timing_avg(spark: SparkSession, d: str) -> DataFrame:
    """Whole mean per stage, 0 where a stage has no events."""
    mean = lambda k: F.expr(f"CASE WHEN count_if(kind = '{k}') = 0 THEN 0 ELSE sum(CASE WHEN kind = '{k}' THEN tick END) div count_if(kind = '{k}') END").alias(f"{k}_avg")
    return A.feed(spark, d).groupBy("shard").agg(mean("trade"), mean("none"))


@query(with_ctes("SELECT count(*) AS packets, count(*) FILTER (kind = 'buy') AS snapshots, count(*) FILTER (kind = 'sell' AND shard > 3) AS filtered, count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (kind = 'cancel') AS ignored FROM feed", "feed"))
def a19_feed_counters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kind")
    named = {"snapshots": k == "buy", "filtered": (k == "sell") & (F.col("shard") > 3), "malformed": k == "malformed", "ignored": k == "cancel"}
    return A.feed(spark, d).agg(F.count("*").alias("packets"), *[F.count_if(c).alias(n) for n, c in named.items()])


_SEQ = "(event_id // 3 * 3 + event_id % 2)"
_AUDIT = f"WITH s AS (SELECT shard, event_id, kind, {_SEQ} AS seq FROM feed), p AS (SELECT *, seq - max(seq) OVER (PARTITION BY shard ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM s), a AS (SELECT *, CASE WHEN step IS NULL OR step = 1 THEN 'ok' WHEN step <= 0 THEN 'duplicate' ELSE 'gap' END AS state, CASE WHEN step > 1 THEN step - 1 ELSE 0 END AS missing FROM p)"


def _audited(spark: SparkSession, d: str) -> DataFrame:
    seq = F.floor(F.col("event_id") / 3) * 3 + F.col("event_id") % 2
    return stats.sequence_audit(A.feed(spark, d).withColumn("seq", seq), ["shard"], "seq", ["event_id"])


@query(with_ctes(_AUDIT + " SELECT event_id, state, missing FROM a", "feed"))
def w1_sequence_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).select("event_id", "state", "missing")


@query(with_ctes(_AUDIT + " SELECT shard, max(event_id) AS last_event, max(seq) AS last_sequence, count(*) AS captured, count(*) FILTER (kind <> 'malformed' AND state <> 'duplicate') AS selected, count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (state = 'duplicate') AS duplicates, sum(missing)::BIGINT AS missing, greatest(max(event_id) - max(seq), 0) AS flush_lag FROM a GROUP BY 1", "feed"))
def a20_recovery_status(spark: SparkSession, d: str) -> DataFrame:
    lag = F.greatest(F.max("event_id") - F.max("seq"), F.lit(0))
    return _audited(spark, d).groupBy("shard").agg(F.max("event_id").alias("last_event"), F.max("seq").alias("last_sequence"), F.count("*").alias("captured"), F.count_if((F.col("kind") != "malformed") & (F.col("state") != "duplicate")).alias("selected"), F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("state") == "duplicate").alias("duplicates"), F.sum("missing").alias("missing"), lag.alias("flush_lag"))


@query(with_ctes("SELECT count(*) AS events, count(*) FILTER (kind IN ('buy', 'sell')) AS orders, count(*) FILTER (kind = 'trade') AS executions FROM feed", "feed"))
def a21_verify_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.feed(spark, d).agg(F.count("*").alias("events"), F.count_if(F.col("kind").isin("buy", "sell")).alias("orders"), F.count_if(F.col("kind") == "trade").alias("executions"))


@query(with_ctes("SELECT coalesce(kind, 'all') AS status, coalesce(shard, -1) AS failure, coalesce(bad, 'all') AS invalidating, count(*) AS n, round(avg(CASE WHEN volume > 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS truncated FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'yes' ELSE 'no' END AS bad FROM feed) GROUP BY CUBE (kind, shard, bad)", "feed"))
def a22_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Counts over all combinations of status, failure code and whether it invalidates."""
    rows = A.feed(spark, d).withColumn("bad", F.when(F.col("event_id") % 10 == 0, "yes").otherwise("no"))
    cube = rows.cube("kind", "shard", "bad").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("volume") > 5, 1.0).otherwise(0.0)), 6).alias("truncated"))
    return cube.select(F.coalesce("kind", F.lit("all")).alias("status"), F.coalesce("shard", F.lit(-1)).alias("failure"), F.coalesce("bad", F.lit("all")).alias("invalidating"), "n", "truncated")


@query("""SELECT count(*) FILTER (r = 'keep') AS accepted, count(*) FILTER (r <> 'keep') AS rejected, count(*) AS candidates, count(*) FILTER (r = 'delisting') AS delisting, count(*) FILTER (r = 'new_listing') AS new_listing, count(*) FILTER (r = 'st') AS st
FROM (SELECT CASE WHEN contains(n, '退') THEN 'delisting' WHEN substr(n, 1, 1) IN ('N', 'C') THEN 'new_listing' WHEN contains(upper(n), 'ST') THEN 'st' ELSE 'keep' END AS r FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'N' || p_name WHEN 1 THEN p_name || '退' WHEN 2 THEN '*st ' || p_name ELSE p_name END AS n FROM part))""")
def a23_universe_audit(spark: SparkSession, d: str) -> DataFrame:
    name = "CASE p_partkey % 5 WHEN 0 THEN 'N' || p_name WHEN 1 THEN p_name || '退' WHEN 2 THEN '*st ' || p_name ELSE p_name END"
    return static.universe_audit(A.read(spark, d, "part").select(F.expr(name).alias("name")))


_BARS = """WITH t AS (SELECT symbol, ts_us, event_id, price, volume FROM feed WHERE kind = 'trade' AND exchange_time_us >= 32400000000 AND exchange_time_us < 54000000000)
SELECT symbol, ts_us // 3600000000 * 3600000000 AS bar_us, arg_min(price, {'a': ts_us, 'b': event_id}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {'a': ts_us, 'b': event_id}) AS close, sum(volume)::BIGINT AS volume, round(sum(price * volume), 4) AS turnover FROM t GROUP BY 1, 2"""


@query(with_ctes(_BARS, "feed"))
def a24_bars(spark: SparkSession, d: str) -> DataFrame:
    t = A.feed(spark, d).where("kind = 'trade'").withColumnRenamed("event_id", "sequence")
    return stats.bars(t, 3600, 9 * 3600, 15 * 3600).withColumn("turnover", F.round("turnover", 4))


@query(with_ctes("""SELECT symbol, (sum(s * volume))::BIGINT AS position, round(sum(-s * price * volume) + sum(s * volume) * arg_max(price, {'a': ts_us, 'b': event_id}) - 0.001 * sum(price * volume), 6) AS pnl FROM (SELECT *, CASE kind WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 END AS s FROM feed WHERE kind IN ('buy', 'sell')) GROUP BY 1""", "feed"))
def a25_pnl(spark: SparkSession, d: str) -> DataFrame:
    t = A.feed(spark, d).where("kind in ('buy', 'sell')").withColumn("sign", F.when(F.col("kind") == "buy", 1).otherwise(-1)).withColumnRenamed("event_id", "sequence")
    return stats.ticker_pnl(t, 0.001).withColumn("pnl", F.round("pnl", 6))


@query(with_ctes("SELECT symbol, ts_us // 86400000000 AS day, count(*) AS n, count(*) > 3 AS over_limit, round(count(*) FILTER (kind = 'cancel') / count(*), 6) AS cancel_ratio FROM feed WHERE kind <> 'malformed' GROUP BY 1, 2", "feed"))
def a26_order_rate(spark: SparkSession, d: str) -> DataFrame:
    """Orders per window and symbol against a limit, and the share of cancels."""
    window = F.floor(F.col("ts_us") / A.DAY_US).alias("day")
    rows = A.feed(spark, d).where("kind <> 'malformed'").groupBy("symbol", window).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "cancel").alias("c"))
    return rows.select("symbol", "day", "n", (F.col("n") > 3).alias("over_limit"), F.round(F.col("c") / F.col("n"), 6).alias("cancel_ratio"))


@query("SELECT sha256('[' || string_agg('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}', ',' ORDER BY n_name) || ']') AS sha256 FROM nation")
def a27_static_hash(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources import sinks

    n = A.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return sinks.daily_document(n, "name").select("sha256")


@query(with_ctes("SELECT event_id, (sum(volume) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))::BIGINT AS window_volume FROM feed", "feed"))
def a29_rolling_volume(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rolling_volume(A.feed(spark, d), ["symbol"], "ts_us", 3_600_000_000).select("event_id", "window_volume")


@query(with_ctes("""WITH s AS (SELECT kind AS stage, price FROM feed UNION ALL SELECT 'total', price FROM feed), r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY stage) AS k FROM s)
SELECT stage, count(*) AS n, round(avg(price), 6) AS mean, max(CASE WHEN i = (k - 1) // 2 THEN price END) AS p50, max(CASE WHEN i = (k - 1) * 99 // 100 THEN price END) AS p99, max(price) AS max FROM r GROUP BY stage""", "feed"))
def a30_stage_report(spark: SparkSession, d: str) -> DataFrame:
    """The latency summary of each stage and over all."""
    rows = A.feed(spark, d).select(F.explode(F.array("kind", F.lit("total"))).alias("stage"), "price")
    return stats.latency_summary(rows, ["stage"], "price").withColumn("mean", F.round("mean", 6))


@query(with_ctes("SELECT symbol, max(ts_us) AS last, (SELECT max(ts_us) FROM feed) - max(ts_us) > 86400000000 AS stale FROM feed GROUP BY 1", "feed"))
def a31_stale_symbols(spark: SparkSession, d: str) -> DataFrame:
    last = A.feed(spark, d).groupBy("symbol").agg(F.max("ts_us").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))  # one row
    return last.crossJoin(F.broadcast(newest)).select("symbol", "last", (F.col("newest") - F.col("last") > A.DAY_US).alias("stale"))


@query(with_ctes("SELECT shard, count(*) AS n, count(*) FILTER (gap > 7200000000) AS gaps, max(gap) AS longest FROM (SELECT shard, ts_us - lag(ts_us) OVER (PARTITION BY shard ORDER BY ts_us) AS gap FROM feed) GROUP BY 1", "feed"))
def a31_shard_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of over two hours in each shard."""
    return stats.gap_metrics(A.feed(spark, d), ["shard"], "ts_us", 7_200_000_000)


# --- windows ----------------------------------------------------------------------


@query(with_ctes("SELECT event_id, shard, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS shard_event_id, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY ts_us, event_id) AS row_in_stock_day FROM feed", "feed"))
def w2_numbers(spark: SparkSession, d: str) -> DataFrame:
    """W2 and W3."""
    rows = sampling.numbered(A.feed(spark, d), ["shard"], ["event_id"], "shard_event_id", large=True)
    return sampling.numbered(rows, ["symbol", "trading_day"], ["ts_us", "event_id"], "row_in_stock_day").select("event_id", "shard", "shard_event_id", "row_in_stock_day")


@query(with_ctes("SELECT event_id, coalesce(lead(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) - ts_us > 3600000000, false) AS batch_end FROM feed", "feed"))
def w5_batch_end(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batch_end(A.feed(spark, d), ["symbol"], "ts_us", ["ts_us", "event_id"], 3_600_000_000).select("event_id", "batch_end")


@query(with_ctes("""WITH b AS (SELECT *, floor(sum(tick * volume) OVER (w ROWS UNBOUNDED PRECEDING) / 10000) AS a, ts_us // 86400000000 AS t FROM feed WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id)),
m AS (SELECT event_id, symbol, ts_us, coalesce(a <> lag(a) OVER w, false) AS amount_trigger, coalesce(t <> lag(t) OVER w, false) AS time_trigger, coalesce(kind <> lag(kind) OVER w, false) AS change_trigger FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id))
SELECT event_id, amount_trigger, time_trigger, change_trigger, (sum(CASE WHEN amount_trigger OR time_trigger OR change_trigger THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cut_index FROM m""", "feed"))
def w6_triggers(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.triggers(A.feed(spark, d), ["symbol"], ["ts_us", "event_id"], F.col("tick") * F.col("volume"), 10_000, A.DAY_US, "kind")
    return rows.select("event_id", "amount_trigger", "time_trigger", "change_trigger", "cut_index")


@query(with_ctes("SELECT event_id, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, event_id) <= 50 AS warming FROM feed", "feed"))
def w7_warmup(spark: SparkSession, d: str) -> DataFrame:
    return sampling.warmup(sampling.numbered(A.feed(spark, d), ["symbol"], ["ts_us", "event_id"], "n"), "n").select("event_id", "warming")


@query("SELECT l_orderkey, l_linenumber, greatest(cum - coalesce(lag(cum) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, cum), 0), 0)::DOUBLE AS fill FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS cum FROM lineitem)")
def w9_fill_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("cum"))
    return sampling.deltas(rows, ["l_orderkey"], ["l_linenumber", "cum"], ["cum"], least=0).select("l_orderkey", "l_linenumber", F.col("cum_delta").alias("fill"))


@query("SELECT l_orderkey, l_linenumber, min(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2")
def w10_trade_dedup(spark: SparkSession, d: str) -> DataFrame:
    """W10 and T9 in batch form: each trade key is applied once."""
    rows = A.read(spark, d, "lineitem")
    return sampling.first_of_each(rows, ["l_orderkey", "l_linenumber"], ["l_quantity"]).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"))


@query(with_ctes("SELECT event_id, coalesce(max((kind IN ('trade', 'cancel'))::INT) OVER (PARTITION BY symbol, tick ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS applied FROM feed", "feed"))
def w10_ended_once(spark: SparkSession, d: str) -> DataFrame:
    """W10: terminal states of orders, for which symbol and tick stand, are applied once."""
    return sampling.ended_once(A.feed(spark, d), ["symbol", "tick"], ["ts_us", "event_id"], "kind", ["trade", "cancel"]).select("event_id", "applied")


@query(with_ctes("SELECT event_id, (sum(CASE WHEN kind = 'buy' THEN volume ELSE 0 END) OVER w)::BIGINT AS bought, (sum(CASE WHEN kind = 'sell' THEN volume ELSE 0 END) OVER w)::BIGINT AS sold, (sum(CASE kind WHEN 'buy' THEN volume WHEN 'sell' THEN -volume ELSE 0 END) OVER w)::BIGINT AS position FROM feed WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)", "feed"))
def w11_position_path(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("kind") == "buy", 1).when(F.col("kind") == "sell", -1).otherwise(0)
    return sampling.position_path(A.feed(spark, d), ["symbol"], ["ts_us", "event_id"], sign).select("event_id", "bought", "sold", "position")


@query(with_ctes("SELECT event_id, last_value(CASE WHEN kind = 'trade' THEN price END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS last_price FROM feed", "feed"))
def w12_last_price(spark: SparkSession, d: str) -> DataFrame:
    rows = A.feed(spark, d).withColumn("last_price", F.when(F.col("kind") == "trade", F.col("price")))
    return sampling.filled(rows, ["symbol"], ["ts_us", "event_id"], "last_price").select("event_id", "last_price")


@query(with_ctes("""WITH numbered AS (SELECT event_id, symbol, kind, ts_us, row_number() OVER (PARTITION BY symbol, kind ORDER BY ts_us, event_id) AS k FROM feed),
after AS (SELECT a.symbol, a.kind, a.k, min(b.k) AS next_k FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND a.kind = b.kind AND b.k > a.k AND b.ts_us >= a.ts_us + 7200000000 GROUP BY ALL),
passed(symbol, kind, k) AS (SELECT symbol, kind, 1::BIGINT FROM numbered WHERE k = 1 UNION ALL SELECT a.symbol, a.kind, a.next_k FROM passed p JOIN after a ON a.symbol = p.symbol AND a.kind = p.kind AND a.k = p.k)
SELECT n.event_id, p.k IS NULL AS blocked FROM numbered n LEFT JOIN passed p ON p.symbol = n.symbol AND p.kind = n.kind AND p.k = n.k""", "feed").replace("WITH ", "WITH RECURSIVE ", 1))
def w13_throttle(spark: SparkSession, d: str) -> DataFrame:
    return sampling.throttled(A.feed(spark, d), ["symbol", "kind"], "ts_us", ["ts_us", "event_id"], 7_200_000_000).select("event_id", "blocked")


_GAP_US, _BLOCK_US = 7_200_000_000, 86_400_000_000


@query(with_ctes(f"""WITH rows_ AS (SELECT symbol, event_id, ts_us AS t, kind = 'malformed' AS answer, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS k FROM feed),
walk(symbol, k, event_id, blocked, free, asked) AS (
  SELECT symbol, k, event_id, false, CASE WHEN answer THEN 0 ELSE t + {_GAP_US} END, NOT answer FROM rows_ WHERE k = 1
  UNION ALL
  SELECT r.symbol, r.k, r.event_id, NOT r.answer AND r.t < w.free,
    CASE WHEN r.answer AND w.asked THEN greatest(w.free, r.t + {_BLOCK_US}) WHEN NOT r.answer AND r.t >= w.free THEN r.t + {_GAP_US} ELSE w.free END,
    CASE WHEN r.answer THEN false WHEN r.t >= w.free THEN true ELSE w.asked END
  FROM walk w JOIN rows_ r ON r.symbol = w.symbol AND r.k = w.k + 1)
SELECT event_id, blocked FROM walk""", "feed").replace("WITH ", "WITH RECURSIVE ", 1))
def w13_reject_block(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a symbol at least two hours apart, and none within a day of a reject; malformed
    events stand for rejects."""
    rows = A.feed(spark, d).withColumn("answer", F.col("kind") == "malformed")
    return sampling.throttled(rows, ["symbol"], "ts_us", ["ts_us", "event_id"], _GAP_US, "answer", _BLOCK_US).select("event_id", "blocked")


@query(with_ctes("SELECT event_id, event_id - coalesce(lag(event_id) OVER w, 0) AS volume_delta, round(event_id * 10.0 - coalesce(lag(event_id * 10.0) OVER w, 0), 4)::DOUBLE AS turnover_delta FROM snapshots WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY ts_us, event_id)", "snapshots"))
def w14_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.deltas(A.snapshots(spark, d), ["symbol", "trading_day"], ["ts_us", "event_id"], ["volume", "turnover"])
    return rows.select("event_id", "volume_delta", F.round("turnover_delta", 4).alias("turnover_delta"))


@query(with_ctes("SELECT symbol, arg_max(kind, event_id) AS status FROM feed GROUP BY 1 HAVING arg_max(kind, event_id) NOT IN ('trade', 'cancel')", "feed"))
def w15_open_orders(spark: SparkSession, d: str) -> DataFrame:
    return static.last_status(A.feed(spark, d), "symbol", "kind", F.col("event_id"), ["trade", "cancel"])


@query(with_ctes("""WITH g AS (SELECT symbol, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us) <= 7200000000 THEN 0 ELSE 1 END AS new FROM feed), s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT symbol, min(ts_us) AS start_us, count(*) AS n FROM s GROUP BY symbol, k""", "feed"))
def t2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Batches by session window; two hours stand for the 100 us of live data."""
    out = sampling.sessions(A.feed(spark, d).withColumn("ts", F.timestamp_micros("ts_us")), ["symbol"], F.col("ts"), "7200 seconds")
    return out.select("symbol", F.unix_micros("start").alias("start_us"), "n")


# --- scoring ----------------------------------------------------------------------


def _features(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Embeddings as feature vectors: a label is a symbol, ten vectors in turn are a day."""
    e = A.read(spark, d, "embeddings")
    return e.select(F.lpad(F.col("label").cast("string"), 6, "0").alias("symbol"), (20240101 + F.col("vec_id") % 10).cast("int").alias("trading_day"), F.col("vec_id").alias("row_in_stock_day"), F.slice("embedding", 1, n).alias("x"))


def network_sql(inputs: int, dense: list[int], hidden: int, head: list[int], layers: int = 1, residual: bool = True, states: bool = True) -> str:
    """The network of scoring.patterned_weights over _features: dense layers as inner products of
    lists, the recurrence as recursive queries, one for each layer."""
    shapes, size = [], inputs
    for i, n in enumerate(dense):
        shapes, size = [*shapes, (f"dense{i}_w", n, size)], n
    if residual:
        shapes.append(("residual_w", size, inputs))
    for i in range(layers):
        shapes, size = [*shapes, (f"gru{i}_wi", 3 * hidden, size), (f"gru{i}_wh", 3 * hidden, hidden)], hidden
    for i, n in enumerate([*head, 1]):
        shapes, size = [*shapes, (f"head{i}_w", n, size)], n
    weights = ", ".join(f"[[((7 * r + 3 * c + {k}) % 13 - 6) / (4 * sqrt({cols}::DOUBLE)) for c in range(0, {cols})] for r in range(0, {rows})] AS {name}" for k, (name, rows, cols) in enumerate(shapes))
    biases = {}
    for i in range(len(dense)):
        biases[f"dense{i}"] = len(biases)
    for i in range(layers):
        biases[f"gru{i}_i"] = len(biases)
        biases[f"gru{i}_h"] = len(biases)
    for i in range(len(head) + 1):
        biases[f"head{i}"] = len(biases)
    key, n = "symbol, trading_day, k, number", hidden
    softsign = lambda v: f"[z / (1 + abs(z)) for z in {v}]"
    times = lambda w, v, bias=None: f"[list_inner_product({v}, p[1]) + ((p[2] - 1 + {biases[bias]}) % 5 - 2) / 10.0::DOUBLE for p in list_zip({w}, range(1, len({w}) + 1))]" if bias else f"[list_inner_product({v}, p) for p in {w}]"
    sql = f"""WITH RECURSIVE W AS MATERIALIZED (SELECT {weights}), start AS (
  SELECT lpad(label::VARCHAR, 6, '0') AS symbol, (20240101 + vec_id % 10)::INT AS trading_day, vec_id AS number, embedding[1:{inputs}]::DOUBLE[] AS x, row_number() OVER (PARTITION BY label, vec_id % 10 ORDER BY vec_id) AS k FROM embeddings
), in0 AS (SELECT {key}, x, x AS h FROM start)"""
    last = "in0"
    for i in range(len(dense)):
        sql += f", in{i + 1} AS (SELECT {key}, x, {softsign('v')} AS h FROM (SELECT {key}, x, {times(f'dense{i}_w', 'h', f'dense{i}')} AS v FROM {last}, W))"
        last = f"in{i + 1}"
    plus = f"[p[1] + p[2] for p in list_zip(h, {times('residual_w', 'x')})]" if residual else "h"
    sql += f", out_ AS (SELECT {key}, {plus} AS h FROM {last}, W)"
    last, kept = "out_", []
    gate = lambda i, j: f"1 / (1 + exp(-(a[{i}] + b[{j}])))"
    step = f"[(1 - {gate(f'i + {n}', f'i + {n}')}) * tanh(a[i + {2 * n}] + {gate('i', 'i')} * b[i + {2 * n}]) + {gate(f'i + {n}', f'i + {n}')} * s[i] for i in range(1, {n + 1})]"
    for i in range(layers):
        old = times(f"gru{i}_wh", "s", f"gru{i}_h")
        sql += f""", a{i} AS MATERIALIZED (SELECT {key}, {times(f'gru{i}_wi', 'h', f'gru{i}_i')} AS a FROM {last}, W), g{i}({key}, h) AS (
  SELECT {key}, {step} FROM (SELECT {key}, a, s, {old} AS b FROM (SELECT {key}, a, [0.0::DOUBLE for i in range(0, {n})] AS s FROM a{i} WHERE k = 1), W)
  UNION ALL
  SELECT {key}, {step} FROM (SELECT {key}, a, s, {old} AS b FROM (SELECT a.symbol, a.trading_day, a.k, a.number, a.a, g.h AS s FROM g{i} g JOIN a{i} a ON a.symbol = g.symbol AND a.trading_day = g.trading_day AND a.k = g.k + 1), W))"""
        last = f"g{i}"
        kept.append(f"SELECT number, {i} AS layer, h FROM g{i}")
    sql += f""", norm AS (SELECT {key}, [(z - m) / sqrt(v + 1e-5) for z in h] AS h FROM (SELECT {key}, h, list_avg(h) AS m, list_aggregate(h, 'var_pop') AS v FROM {last}))"""
    last = "norm"
    for i in range(len(head) + 1):
        value = times(f"head{i}_w", "h", f"head{i}")
        sql += f", head{i} AS (SELECT {key}, {softsign('v') if i < len(head) else 'v'} AS h FROM (SELECT {key}, {value} AS v FROM {last}, W))"
        last = f"head{i}"
    hidden_sql = f", (SELECT round(list_sum([abs(z) for z in flatten(list(h ORDER BY layer))]), 6) FROM ({' UNION ALL '.join(kept)}) s WHERE s.number = p.number) AS hidden_sum" if states else ""
    return f"{sql} SELECT symbol, trading_day, number AS row_in_stock_day, round(h[1], 6) + 0 AS prediction{hidden_sql} FROM {last} p"


#: Shapes of the three networks: inputs, dense layers, hidden, head, recurrent layers, residual.
_NETWORKS = {"m1": (50, [512, 256, 128], 64, [8], 1, True), "m2": (36, [512, 256, 128], 64, [8], 1, True), "m3": (50, [128], 128, [16], 2, False)}


def _scored(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Predictions, and the sum of the absolute hidden states after each row."""
    shape = _NETWORKS[name]
    rows = scoring.score(_features(spark, d, shape[0]), scoring.patterned_weights(*shape), states=True)
    total = F.aggregate("hidden", F.lit(0.0), lambda a, x: a + F.abs(x))
    return rows.select("symbol", "trading_day", "row_in_stock_day", F.round("prediction", 6).alias("prediction"), F.round(total, 6).alias("hidden_sum"))


@query(network_sql(*_NETWORKS["m1"]))
def m1_score_dense_gru(spark: SparkSession, d: str) -> DataFrame:
    """Fifty features, three dense layers and a residual, one recurrent layer."""
    return _scored(spark, d, "m1")


@query(network_sql(*_NETWORKS["m2"]))
def m2_score_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same network over 36 features."""
    return _scored(spark, d, "m2")


@query(network_sql(*_NETWORKS["m3"]))
def m3_score_two_layers(spark: SparkSession, d: str) -> DataFrame:
    """A projection of fifty features and two recurrent layers of 128."""
    return _scored(spark, d, "m3")


@query("SELECT vec_id AS row_in_stock_day, o AS output, round(list_sum([embedding[i + 1]::DOUBLE * (((i * 7 + o * 3) % 11)::DOUBLE - 5) FOR i IN range(0, 50)]), 4) AS score FROM embeddings, range(0, 4) t(o)")
def m4_linear_score(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(200).select((F.col("id") / 50).cast("int").alias("output"), (F.col("id") % 50).cast("int").alias("position"))
    weights = rows.withColumn("w", ((F.col("position") * 7 + F.col("output") * 3) % 11).cast("double") - 5)
    out = scoring.linear_score(_features(spark, d, 50), weights, ["row_in_stock_day"])
    return out.select("row_in_stock_day", F.col("output").cast("long").alias("output"), F.round("score", 4).alias("score"))


_FACTORS = [*factors.MARKET, *factors.FLOW, *factors.FULL_BOOK]


@query(f"""SELECT 'v' || vec_id AS name, vec_id % 9 <> 4 AS shape_ok, len([x FOR x IN CASE WHEN vec_id % 13 = 5 THEN ['nan'::FLOAT] ELSE embedding END IF NOT isfinite(x)]) = 0 AS finite,
  sha256(array_to_string(CASE WHEN vec_id % 11 = 2 THEN list_reverse(names) ELSE names END, chr(10))) = sha256(array_to_string(names, chr(10))) AS contract_ok FROM embeddings, (SELECT {_FACTORS} AS names)""")
def m5_check_weights(spark: SparkSession, d: str) -> DataFrame:
    """Shapes, finite values, and the hash of the factors in the model's order; some are planted wrong."""
    e, k = A.read(spark, d, "embeddings"), F.col("vec_id")
    name = F.concat(F.lit("v"), k.cast("string"))
    given = F.when(k % 11 == 2, scoring.factor_hash(_FACTORS[::-1])).otherwise(scoring.factor_hash(_FACTORS))
    weights = e.select(name.alias("name"), F.array(F.when(k % 9 == 4, 63).otherwise(F.size("embedding"))).alias("shape"), F.when(k % 13 == 5, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")).alias("values"), given.alias("factor_hash"))
    return scoring.check_weights(weights, e.select(name.alias("name"), F.array(F.lit(64)).alias("shape")), _FACTORS)


@query("""WITH a AS (SELECT vec_id, label::DOUBLE AS e, label + CASE WHEN vec_id % 100 = 1 THEN 5e-6 ELSE 0 END AS a, embedding::DOUBLE[] AS h, [embedding[i]::DOUBLE + CASE WHEN i = vec_id % 64 AND vec_id % 50 = 3 THEN 2e-5 ELSE 0 END for i in range(1, 65)] AS g FROM embeddings)
SELECT round(max(abs(e - a)) FILTER (vec_id % 1000 <> 7), 9) AS max_error, count(*) FILTER (vec_id % 1000 = 7) AS missing, round(max(list_max([abs(p[1] - p[2]) for p in list_zip(h, g)])) FILTER (vec_id % 1000 <> 7), 9) AS max_hidden_error, 0::BIGINT AS unlike, false AS passed FROM a""")
def m6_golden_check(spark: SparkSession, d: str) -> DataFrame:
    """Predictions within the tolerance, hidden states (embeddings stand for them) beyond it."""
    e, k = A.read(spark, d, "embeddings"), F.col("vec_id")
    expected = e.select(k, F.col("label").cast("double").alias("p"), F.col("embedding").cast("array<double>").alias("h"))
    moved = F.transform("h", lambda x, i: x + F.when((i + 1 == k % 64) & (k % 50 == 3), 2e-5).otherwise(0.0))
    actual = expected.where(k % 1000 != 7).select(k, (F.col("p") + F.when(k % 100 == 1, 5e-6).otherwise(0.0)).alias("p"), moved.alias("h"))
    return scoring.golden_check(expected, actual, ["vec_id"], "p", "h").withColumns({c: F.round(c, 9) for c in ("max_error", "max_hidden_error")})


@query(f"""SELECT a.*, {', '.join('w.' + c for c in factors.FLOW)}, {', '.join('k.' + c for c in factors.FULL_BOOK)}, t.target FROM ({ORACLE_SQL['a6_market_factors']}) a JOIN ({ORACLE_SQL['f7_targets']}) t ON t.sequence = a.event_id
JOIN ({with_ctes('SELECT event_id, symbol, trading_day FROM snapshots', 'snapshots')}) s ON s.event_id = a.event_id JOIN ({ORACLE_SQL['a7_flow_factors']}) w ON w.symbol = s.symbol AND w.trading_day = s.trading_day
JOIN ({ORACLE_SQL['a8_full_book_factors']}) k ON k.symbol = s.symbol AND k.trading_day = s.trading_day WHERE t.target IS NOT NULL AND k.valid""")
def m7_labels(spark: SparkSession, d: str) -> DataFrame:
    """Training rows: all 50 factors, in the contract's order, with the target over the three
    horizons. Market factors are a snapshot's own, flow and full book those of its symbol and day."""
    rows = factors.market_factors(A.snapshots(spark, d), ["symbol", "trading_day"], ["ts_us", "event_id"])
    mids = rows.select("symbol", "ts_us", F.col("event_id").alias("sequence"), "mid")
    left = rows.where("mid > 0").select("symbol", "trading_day", "ts_us", "event_id", "mid", *factors.MARKET)
    labelled = asof.forward(left, mids, ["symbol"], "mid", market.HORIZONS).withColumn("target", F.round(S.target_permille("mid", *market.HORIZONS), 5)).where("target is not null")
    whole = labelled.join(market.a7_flow_factors(spark, d), ["symbol", "trading_day"]).join(market.a8_full_book_factors(spark, d).where("valid"), ["symbol", "trading_day"])
    return whole.select("event_id", *[F.round(c, market.places(c)).alias(c) for c in factors.MARKET], *factors.FLOW, *factors.FULL_BOOK, "target")


part("w3_row_in_stock_day", "w2_numbers", "event_id", "row_in_stock_day")
part("t9_dedup", "w10_trade_dedup", "l_orderkey", "l_linenumber")
