"""State machines, comparators and books on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import arbiter, asof, book, normalize, quality, ranges, sampling, scoring, static, stats

US = 1_000_000


def arbitrate_plain(updates, age=4 * US, eps=0.01):
    """The arbiter as a loop."""
    day, seen, out = None, {}, []
    for u in updates:
        ok = u["valid"] and u["trading_day"] >= 20000101 and u["exchange_time_us"] and u["sequence"] and u["turnover"] >= 0
        if ok and (day is None or u["trading_day"] > day):
            day, seen = u["trading_day"], {}
        taken = bool(ok and u["trading_day"] == day and (u["source"] not in seen or u["exchange_time_us"] >= seen[u["source"]]["exchange_time_us"]))
        if taken:
            seen[u["source"]] = u
        newest = max((s["exchange_time_us"] for s in seen.values()), default=0)
        fresh = {k: newest - s["exchange_time_us"] <= age for k, s in seen.items()}
        full = u["full_runtime_valid"] and fresh.get(1, False)
        pick = 1 if full and (not fresh.get(2) or seen[1]["turnover"] + eps >= seen[2]["turnover"]) else 2 if fresh.get(2) else None
        out.append((u["arrival"], taken, pick, seen[pick]["sequence"] if pick else None))
    return out


FIELDS = "symbol string, source int, trading_day int, exchange_time_us long, turnover double, sequence long, valid boolean, full_runtime_valid boolean, arrival long"


def script(seed, n=40):
    rnd = random.Random(seed)
    return [dict(symbol="a", source=rnd.choice([1, 2]), trading_day=20260801 + rnd.choice([0, 0, 0, 1]) * (i > n // 2), exchange_time_us=1 + i * US + rnd.choice([0, 0, 5 * US, -3 * US]) if i > 5 else 1 + i, turnover=float(rnd.randrange(5)), sequence=i + 1, valid=rnd.random() > 0.1, full_runtime_valid=rnd.random() > 0.2, arrival=i) for i in range(n)]


def test_arbiter_equals_the_loop(spark):
    rows, want = [], {}
    for s in range(30):
        updates = script(s)
        for u in updates:
            u["symbol"] = f"s{s}"
        rows += updates
        want |= {(f"s{s}", a): rest for a, *rest in arbitrate_plain(updates)}
    got = arbiter.arbitrate(spark.createDataFrame(rows, FIELDS)).collect()
    assert {(r.symbol, r.arrival): [r.accepted, r.selected, r.selected_sequence] for r in got} == want


def test_arbiter_staleness_day_reset_and_dispatch(spark):
    def u(arrival, source, day, t, turnover):
        return dict(symbol="x", source=source, trading_day=day, exchange_time_us=t, turnover=turnover, sequence=arrival + 1, valid=True, full_runtime_valid=True, arrival=arrival)

    rows = [u(0, 1, 20260801, 10 * US, 5.0), u(1, 2, 20260801, 11 * US, 5.0), u(2, 2, 20260801, int(15.5 * US), 6.0), u(3, 1, 20260802, 1 * US, 1.0), u(4, 2, 20260801, 30 * US, 9.0)]
    out = arbiter.arbitrate(spark.createDataFrame(rows, FIELDS))
    assert [(r.accepted, r.selected) for r in out.orderBy("arrival").collect()] == [(True, 1), (True, 1), (True, 2), (True, 1), (False, 1)]
    assert [r.arrival for r in arbiter.dispatch_once(out).orderBy("arrival").collect()] == [0, 2, 3]


@pytest.mark.parametrize("price, factor, status", [(0.1259, 1.5, "PASS"), (0.1261, 1.5, "FAIL"), (0.125, 1.6, "FAIL")])
def test_replay_tolerances(spark, price, factor, status):
    schema = "app_sequence long, instrument string, raw_prediction double, factor_0 double"
    a = spark.createDataFrame([(1, "a", 0.125, 1.5), (2, "a", float("nan"), 1.5)], schema)
    b = spark.createDataFrame([(1, "a", price, factor), (2, "a", float("nan"), 1.5)], schema)
    errors = quality.field_errors(quality.align(a, b, ["app_sequence"]), ["app_sequence"], ["instrument"], "raw_prediction", ["factor_0"])
    assert quality.verdict(errors).first().status == status
    missing = quality.field_errors(quality.align(a, b.limit(1), ["app_sequence"]), ["app_sequence"], ["instrument"], "raw_prediction", ["factor_0"])
    assert quality.verdict(missing).first().n_ordering == 1


def test_batch_end_sessions_and_percentiles(spark):
    rows = spark.createDataFrame([(1, 1000), (2, 1101)], "k int, t long")
    far = sampling.batch_end(rows.withColumn("g", F.lit(1)), ["g"], "t", ["t"])
    assert [r.batch_end for r in far.orderBy("t").collect()] == [True, False]
    near = sampling.batch_end(spark.createDataFrame([(1, 1000), (1, 1100)], "g int, t long"), ["g"], "t", ["t"])
    assert [r.batch_end for r in near.collect()] == [False, False]
    six = spark.createDataFrame([(1, float(i)) for i in range(6)], "g int, v double")
    got = stats.rank_percentiles(six, ["g"], "v", {"c": (0.5, "ceil"), "f": (0.5, "floor"), "r": (0.5, "round")}).first()
    assert (got.c, got.f, got.r) == (3.0, 2.0, 2.0)


@pytest.mark.parametrize("small_rows", [0, 500_000])
def test_percentiles_with_ties_nulls_and_small_groups(spark, monkeypatch, small_rows):
    """Exact places in a group of one frequent value, in one of a row, and under a null key; of few
    rows and in ranges of values."""
    monkeypatch.setattr(ranges, "SMALL_ROWS", small_rows)
    rnd = random.Random(7)
    groups = {"hot": [5.0] * 4000 + [rnd.random() * 10 for _ in range(2000)], "one": [3.0], None: [float(i % 17) for i in range(500)], "none": [None] * 3}
    rows = spark.createDataFrame([(g, v) for g, values in groups.items() for v in [*values, None]], "g string, v double")
    wanted = {"low": (0.01, "floor"), "mid": (0.5, "ceil"), "high": (0.99, "round"), "last": (1.0, "ceil")}
    got = {r.g: (r.low, r.mid, r.high, r.last) for r in stats.rank_percentiles(rows, ["g"], "v", wanted).collect()}
    at = lambda x: (x[math.floor((len(x) - 1) * 0.01)], x[math.ceil((len(x) - 1) * 0.5)], x[round((len(x) - 1) * 0.99)], x[-1])
    assert got == {g: at(sorted(values)) for g, values in groups.items() if g != "none"}
    assert stats.rank_percentiles(rows.limit(0), ["g"], "v", wanted).count() == 0


def test_normalized_events_and_reasons(spark):
    day = F.lit(20260801)
    noon = 1785585600_000_000  # 2026-08-01 12:00
    make = lambda rows: spark.createDataFrame(rows, "appl_seq_num long, order_time long, instrument_id long, price double, volume double, order_kind long, ord_type long")
    good = (1, noon, 7, 12.34, 100.0, 1, 2)
    bad = [(2, noon - 86_400_000_000, 7, 1.0, 1.0, 1, 2), (0, noon, 7, 1.0, 1.0, 1, 2), (3, noon, 7, 1.0, 1.5, 1, 2), (4, noon, 7, 1.0, None, 1, 2), (5, noon, 7, 1.0, 1.0, 9, 2), (6, noon, 7, 0.0, 1.0, 1, 2)]
    got = {r.appl_seq_num: r for r in normalize.normalize_orders(make([good, (8, noon, 7, 0.0, 1.0, 1, 1), *bad]), day).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {1: None, 8: None, 2: "day", 0: "sequence", 3: "volume", 4: "volume", 5: "kind", 6: "price"}
    assert (got[1].symbol, got[1].exchange_time_us, got[1].tick, got[1].qty, got[1].kind) == ("000007", 43_200_000_000, 1234, 100, "limit")
    assert (got[8].tick, got[8].kind) == (None, "market") and got[2].symbol is None
    trades = spark.createDataFrame([(1, noon, 7, 2.0, 1.0, 1, 3, 4), (2, noon, 7, 2.0, 1.0, 1, 3, 0), (3, noon, 7, 0.0, 1.0, 4, 3, None), (4, noon, 7, 0.0, 1.0, 4, 3, 4)], "appl_seq_num long, trade_time long, instrument_id long, price double, volume double, order_kind long, bid_appl_seq_num long, offer_appl_seq_num long")
    found = {r.appl_seq_num: (r.reject_reason, r.kind, r.ask_sequence) for r in normalize.normalize_trades(trades, day).collect()}
    assert found == {1: (None, "trade", 4), 2: ("link", None, None), 3: (None, "cancel", None), 4: ("link", None, None)}


def test_book_intervals_match_a_replay(spark):
    rnd = random.Random(1)
    rows = [("s", rnd.choice("BS"), rnd.randrange(95, 105), t, t, rnd.choice([3, 2, 1, -2]), 1) for t in range(1, 200)]
    levels = book.intervals(spark.createDataFrame(rows, "symbol string, side string, tick long, ts_us long, sequence long, qty long, orders int"))
    times = spark.createDataFrame([("s", t) for t in (1, 50, 120, 199, 400)], "symbol string, ts_us long")
    got = {(r.ts_us, r.side, r.tick): r.qty for r in book.book_at(times, levels, bucket_us=16).collect()}
    want = {}
    for t in (1, 50, 120, 199, 400):
        state = {}
        for _, side, tick, at, _, qty, _ in rows:
            if at <= t:
                state[side, tick] = state.get((side, tick), 0) + qty
        want |= {(t, *k): q for k, q in state.items() if q > 0}
    assert got == want


def test_nearest_and_forward(spark):
    left = spark.createDataFrame([("k", 1, 10), ("k", 2, 25), ("z", 3, 5)], "g string, id int, ts_us long")
    right = spark.createDataFrame([("k", 12, 1, 1.0), ("k", 20, 2, 2.0), ("k", 20, 3, 3.0)], "g string, ts_us long, sequence long, mid double")
    assert {r.id: r.delta for r in asof.nearest(left, right, ["g"]).collect()} == {1: 2, 2: 5, 3: None}
    out = asof.forward(left, right, ["g"], "mid", {"a": 2, "b": 10})
    assert {r.id: (r.a, r.b) for r in out.collect()} == {1: (1.0, 2.0), 2: (None, None), 3: (None, None)}


def test_health_routing_and_free_share(spark):
    symbols = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("c", 2, 1), ("d", 9, 1)], "symbol string, shard int, td_id int")
    shards = spark.createDataFrame([(0, True), (1, True), (2, True)], "shard int, ready boolean")
    feeds = spark.createDataFrame([(0, "healthy", "healthy"), (1, "healthy", "degraded"), (2, "failed", "healthy")], "shard int, feed_state string, journal_state string")
    td = spark.createDataFrame([(1, True)], "td_id int, td_ready boolean")
    got = {r.symbol: (r.new_risk, r.reduce_risk) for r in static.can_trade(symbols, shards, feeds, td).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, False), "d": (False, False)}
    events = spark.createDataFrame([("1",), ("2",), ("807",), ("999999",)], "symbol string")
    owners = spark.createDataFrame([("1", 0), ("2", 1), ("807", 2)], "symbol string, shard int")
    assert {r.symbol: r.shard_id for r in static.route(events, owners).collect()} == {"1": 0, "2": 1, "807": 2, "999999": None}
    raw = spark.createDataFrame([("000807.SZ", "816048.1215"), (" 000001.sz", "5"), ("302001.SZ", "1"), ("600000.SH", "1"), ("000002.SZ", "0")], "ts_code string, free_share string")
    assert {r.code: r.free_share for r in static.clean_free_share(raw).collect()} == {"000001.SZ": "5", "000807.SZ": "816048.1215"}


def test_zero_weights_score_the_last_bias(spark):
    import numpy as np

    weights = {k: np.zeros_like(v) for k, v in scoring.random_weights(50, [512, 256, 128], 64, [8]).items()}
    weights["head1.b"][:] = 1.5
    rows = spark.createDataFrame([("a", 20260801, i, [0.1] * 50) for i in range(3)], "symbol string, trading_day int, row_in_stock_day long, x array<float>")
    assert {r.prediction for r in scoring.score(rows, weights).collect()} == {1.5}


def test_scoring_keeps_one_state_per_instrument_day(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    weights = scoring.random_weights(4, [8], 6, [3], layers=2)
    data = [(s, day, i, rng.normal(size=4).tolist()) for s in "abc" for day in (1, 2) for i in range(1, 6)]
    schema = "symbol string, trading_day int, row_in_stock_day long, x array<double>"
    got = {(r.symbol, r.trading_day, r.row_in_stock_day): r.prediction for r in scoring.score(spark.createDataFrame(data[::-1], schema), weights).collect()}
    net = scoring.Network(weights)
    for s in "abc":
        for day in (1, 2):
            state = net.start(1)
            for _, _, i, x in [r for r in data if r[:2] == (s, day)]:
                y, state = net.step(np.array([x], np.float32), state)
                assert abs(got[s, day, i] - y[0]) < 1e-5


def test_throttle_counts_from_the_last_row_let_through(spark):
    from tidemark.operators import sampling

    rows = [("a", t) for t in (0, 6, 12, 18, 20, 22)] + [("b", 5)] + [("c", t) for t in range(0, 3000, 7)]
    got = sampling.throttled(spark.createDataFrame(rows, "symbol string, t long"), ["symbol"], "t", ["t"], 10).collect()
    want, last = {}, {}
    for s, t in sorted(rows):
        want[s, t] = s in last and t - last[s] < 10
        last[s] = last.get(s, t) if want[s, t] else t
    assert {(r.symbol, r.t): r.blocked for r in got} == want and not want["a", 12]


def test_parity_sees_a_changed_order(spark):
    from tidemark.operators import quality

    rows = [("s", i, f"x{i}") for i in range(5)]
    turned = [("s", i, f"x{4 - i}") for i in range(5)]
    digests = [quality.parity_digest(spark.createDataFrame(r, "symbol string, arrival long, body string"), "symbol", ["body"], ["arrival"]).first().digest for r in (rows, rows[::-1], turned)]
    assert digests[0] == digests[1] != digests[2]


@pytest.mark.parametrize("small_rows", [0, 500_000])
def test_large_groups_in_ranges_equal_whole_windows(spark, monkeypatch, small_rows):
    """Numbers, audits, gaps and nearest ticks of one hot group, null keys, ties and null times."""
    monkeypatch.setattr(ranges, "SMALL_ROWS", small_rows)
    rnd = random.Random(5)
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else "b", None if i % 50 == 3 else rnd.randrange(60), rnd.randrange(200)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, g string, t long, seq long")
    got = {r.id: r.n for r in sampling.numbered(frame, ["g"], ["t", "id"], "n", large=True).collect()}
    assert got == {r.id: r.n for r in sampling.numbered(frame, ["g"], ["t", "id"], "n").collect()}

    want, seen = {}, {}
    for i, g, t, seq in sorted(rows, key=lambda r: r[0]):
        step = seq - seen[g] if g in seen else None
        want[i] = ("ok" if step in (None, 1) else "duplicate" if step <= 0 else "gap", max(step - 1, 0) if step else 0)
        seen[g] = max(seen.get(g, seq), seq)
    assert {r.id: (r.state, r.missing) for r in stats.sequence_audit(frame, ["g"], "seq", ["id"]).collect()} == want

    left, right = frame.where("id % 2 = 0 and t is not null"), frame.where("id % 2 = 1 and t is not null and g is not null")
    near = {r.id: r.delta for r in asof.nearest(left.select("id", "g", "t"), right.select("g", "t"), ["g"], "t").collect()}
    ticks = lambda g: [t for i, h, t, _ in rows if i % 2 and t is not None and h == g and g]
    assert near == {i: min((abs(t - x) for x in ticks(g)), default=None) for i, g, t, _ in rows if i % 2 == 0 and t is not None}

    timed = frame.where("t is not null")
    whole = timed.withColumn("gap", F.expr("t - lag(t) over (partition by g order by t)"))
    key = lambda r: (str(r.g), r.t, -1 if r.gap is None else r.gap)
    assert sorted(map(key, stats.gaps(timed, ["g"], "t").collect())) == sorted(map(key, whole.collect()))


def test_ranges_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, g string, t long")
    assert sampling.numbered(empty, ["g"], ["t", "id"], "n", large=True).count() == 0


def test_long_intervals_are_dealt_to_few_nodes(spark):
    """Covers are exact, disjoint, and of 30 nodes at most over 10,000 slots."""
    rnd = random.Random(2)
    spans = [(a, a + rnd.choice([0, 1, 2, 37, 1000, 10_000])) for a in (rnd.randrange(-20_000, 20_000) for _ in range(300))]
    frame = spark.createDataFrame(spans, "low long, high long")
    for depth in (1, 4, 10):
        for r in frame.select("low", "high", book.cover("low", "high", depth).alias("nodes")).collect():
            slots = [s for level, n in r.nodes or [] for s in range(n << level, (n + 1) << level)]
            assert sorted(slots) == list(range(r.low, r.high))
            assert depth < 10 or len(r.nodes or []) <= 30
    up = frame.select("low", book.ancestors("low", 4).alias("a")).first()
    assert [tuple(x) for x in up.a] == [(k, up.low >> k) for k in range(5)]


def test_book_of_long_intervals(spark):
    """As with one bucket for all of time, at any width and depth."""
    rnd = random.Random(6)
    levels = [("s" if i % 3 else "t", "B", i, a, None if i % 11 == 0 else a + rnd.choice([1, 5, 300, 5000]), 1, 1, a) for i, a in enumerate(rnd.randrange(6000) for _ in range(200))]
    frame = spark.createDataFrame(levels, "symbol string, side string, tick long, valid_from long, valid_to long, qty long, n_orders long, since long")
    samples = [(s, t) for s in "stu" for t in (0, 1, 77, 3000, 5999, 9000)]
    asked = spark.createDataFrame(samples, "symbol string, ts_us long")
    want = sorted((s, t, tick) for s, t in samples for x, _, tick, a, b, *_ in levels if x == s and a <= t and (b is None or t < b))
    for width, depth in ((1, 10), (3, 2), (10_000, 10)):
        got = book.book_at(asked, frame, bucket_us=width, depth=depth)
        assert sorted((r.symbol, r.ts_us, r.tick) for r in got.collect()) == want
    assert book.book_at(asked.limit(0), frame).count() == 0 == book.book_at(asked, frame.limit(0)).count()


def test_best_prices_and_market_orders(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("st"), rnd.choice("BS"), rnd.randrange(95, 105), t // 2, t, rnd.choice([3, 2, 1, -2, -4]), 1) for t in range(1, 300)]
    levels = book.intervals(spark.createDataFrame(rows, "symbol string, side string, tick long, ts_us long, sequence long, qty long, orders int"))
    plain = [(r.symbol, r.side, r.tick, r.valid_from, r.valid_to) for r in levels.collect()]

    def best(symbol, side, t):
        alive = [k for x, y, k, a, b in plain if (x, y) == (symbol, side) and a <= t and (b is None or t < b)]
        return None if not alive else max(alive) if side == "B" else min(alive)

    for depth in (1, 12):
        got = book.best_prices(levels, depth).collect()
        assert all(r.best == best(r.symbol, r.side, r.ts_us) for r in got)
    assert {(r.symbol, r.side, r.ts_us) for r in got} == {(x, y, t) for x, y, _, a, b in plain for t in (a, b) if t is not None}
    orders = [(x, y, t, 1000 * i + t) for i, (x, y) in enumerate([("s", "B"), ("s", "S"), ("t", "B"), ("u", "S")]) for t in (0, 3, 50, 149, 500)]
    fills = [(orders[1][3], 9, 77), (orders[1][3], 8, 78)]
    out = book.market_order_prices(spark.createDataFrame(orders, "symbol string, side string, ts_us long, sequence long"), spark.createDataFrame(fills, "order_sequence long, sequence long, tick long"), book.best_prices(levels))
    got = {r.sequence: (r.side, r.tick, r.from_linked_fill) for r in out.collect()}
    assert got == {q: (y, 78, True) if q == orders[1][3] else (y, best(x, "S" if y == "B" else "B", t), False) for x, y, t, q in orders}


def test_a_time_asks_no_nodes_that_its_side_cannot_have(spark):
    for last in (1, 2, 3, 6, 7, 8, 40):
        n = spark.range(1).selectExpr("1L AS s", f"{last}L AS n").select(F.size(book.ancestors("s", 12, "n")).alias("k")).first().k
        nodes = spark.range(1, last + 1).selectExpr("id AS a", f"{last} + 1L AS b").select(F.explode(book.cover("a", "b", 12)).alias("at")).agg(F.max("at.level").alias("m")).first().m
        assert nodes < n <= max(1, (last + 1).bit_length() - 1)


def test_rejects_block_and_only_answers_to_requests_count(spark):
    """Against a plain loop, over several Arrow batches; ties in time keep their order."""
    rnd = random.Random(9)
    rows = [(f"k{i % 3}" if i % 7 else None, t // 3, i, rnd.random() < 0.2 if i % 11 else None) for i, t in enumerate(sorted(rnd.randrange(9000) for _ in range(900)))]
    want, state = {}, {}
    for key, t, i, answer in rows:
        free, asked = state.get(key, (-(10**9), False))
        if answer:
            want[i] = False
            state[key] = (max(free, t + 60), False) if asked else (free, False)
        else:
            want[i] = t < free
            state[key] = (free, asked) if want[i] else (t + 7, True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sampling.throttled(spark.createDataFrame(rows, "g string, t long, id long, answer boolean"), ["g"], "t", ["t", "id"], 7, "answer", 60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: r.blocked for r in got} == want and 100 < sum(want.values()) < 850


def test_golden_check_of_predictions_and_hidden_states(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, p double, h array<double>")
    base = [(i, i / 7, [i / 3, -i / 5]) for i in range(6)]
    check = lambda rows: scoring.golden_check(make(base), make(rows), ["id"], "p", "h").first()
    good = check([(i, p + 9e-6, [h[0], h[1] - 9e-6]) for i, p, h in base])
    assert good.passed and abs(good.max_error - 9e-6) < 1e-9 and abs(good.max_hidden_error - 9e-6) < 1e-9
    assert not check([(i, p, [h[0] + 2e-5 * (i == 3), h[1]]) for i, p, h in base]).passed
    assert not check(base[1:]).passed and check(base[1:]).missing == 1
    assert check([(i, p, h[:1] if i == 2 else h) for i, p, h in base]).unlike == 1 and not check([]).passed


def test_states_are_those_of_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    weights = scoring.patterned_weights(4, [6], 5, [3], layers=2)
    rows = [(s, 1, i, rng.normal(size=4).tolist()) for s in "ab" for i in range(1, 8)]
    got = {(r.symbol, r.row_in_stock_day): r for r in scoring.score(spark.createDataFrame(rows, "symbol string, trading_day int, row_in_stock_day long, x array<double>"), weights, states=True).collect()}
    net = scoring.Network(weights)
    for s in "ab":
        state = net.start(1)
        for _, _, i, x in [r for r in rows if r[0] == s]:
            y, state = net.step(np.array([x]), state)
            assert np.allclose(got[s, i].hidden, state.ravel(), atol=1e-12) and abs(got[s, i].prediction - y[0]) < 1e-12
