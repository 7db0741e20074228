"""Order books as tables: level changes, validity intervals, and the book at sample times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import asof, sampling

LEVEL = ["symbol", "side", "tick"]


def level_volume(changes: DataFrame) -> DataFrame:
    """Open quantity of each level after all changes."""
    return changes.groupBy(*LEVEL).agg(F.sum("qty").alias("qty"), F.sum("orders").alias("n_orders"))


def running_levels(changes: DataFrame) -> DataFrame:
    """changes with the level's quantity and number of orders after each."""
    order = W.partitionBy(*LEVEL).orderBy("ts_us", "sequence").rowsBetween(W.unboundedPreceding, 0)
    return changes.withColumn("level_qty", F.sum("qty").over(order)).withColumn("level_orders", F.sum("orders").over(order))


def intervals(changes: DataFrame) -> DataFrame:
    """(symbol, side, tick, valid_from, valid_to, qty, n_orders, since): each level's states with a
    positive quantity; valid_to is null for the last, since is when the level was first set."""
    order = W.partitionBy(*LEVEL).orderBy("ts_us", "sequence")
    states = running_levels(changes).withColumn("valid_to", F.lead("ts_us").over(order)).withColumn("since", F.min("ts_us").over(W.partitionBy(*LEVEL)))
    states = states.where("level_qty > 0 and (valid_to is null or valid_to > ts_us)")
    return states.select(*LEVEL, F.col("ts_us").alias("valid_from"), "valid_to", F.col("level_qty").alias("qty"), F.col("level_orders").alias("n_orders"), "since")


def cover(low: str, high: str, depth: int) -> Column:
    """Dyadic nodes (level, node) that together are the slots from ``low`` up to ``high``, itself
    excluded. Node n of level k is the 2^k slots from n * 2^k on. Below level ``depth`` two at most are of one
    level; at ``depth`` all that the interval holds are named. Null where it is empty."""
    left, right = f"shiftright({low} + shiftleft(1L, k) - 1L, k)", f"shiftright({high}, k)"
    node = lambda n: f"named_struct('level', k, 'node', {n})"
    below = f"""flatten(transform(sequence(0, {depth - 1}), k -> filter(array(
        if({left} < {right} and {left} & 1 = 1, {node(left)}, null), if({left} < {right} and {right} & 1 = 1, {node(right + ' - 1L')}, null)), x -> x is not null)))"""
    first, last = (x.replace(", k)", f", {depth})") for x in (left, right))
    top = f"if({first} < {last}, transform(sequence({first}, {last} - 1L), n -> named_struct('level', {depth}, 'node', n)), array())"
    return F.expr(f"if({low} < {high}, concat({below}, {top}), null)")


def ancestors(slot: str, depth: int, last: str | None = None) -> Column:
    """The nodes of all levels up to ``depth`` that hold a slot. Of slots from 1 to ``last`` no interval has
    nodes of over (last + 1) / 2 slots, and no others are named."""
    top = depth if last is None else f"least({depth}, length(bin({last} + 1)) - 2)"
    return F.expr(f"transform(sequence(0, {top}), k -> named_struct('level', k, 'node', shiftright({slot}, k)))")


def book_at(samples: DataFrame, levels: DataFrame, bucket_us: int = 86_400_000_000, depth: int = 10) -> DataFrame:
    """samples (symbol, ts_us, ...) with every level of their symbol alive at ts_us.

    A tree over the buckets of time: an interval lies in the few nodes that together are the
    buckets it touches (``cover``), a sample asks the ``depth`` + 1 nodes above its own, and both
    meet by an equi-join on (symbol, node). What the first and last bucket hold too much the
    interval's bounds leave out. An interval over n buckets is dealt to 2 log n rows, not n.
    """
    reach = samples.groupBy("symbol").agg(F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"))
    begin, end = F.greatest("valid_from", "_first"), F.least(F.coalesce("valid_to", F.col("_last") + 1), F.col("_last") + 1)
    slot = lambda t: F.floor(t / bucket_us)
    spans = levels.join(reach, "symbol").where(end > begin).withColumn("_low", slot(begin)).withColumn("_high", slot(end - 1) + 1)
    spans = spans.withColumn("_at", F.explode(cover("_low", "_high", depth))).drop("_low", "_high", "_first", "_last")
    asked = samples.withColumn("_slot", slot(F.col("ts_us"))).withColumn("_at", F.explode(ancestors("_slot", depth))).drop("_slot")
    spans, asked = (x.withColumn("_level", F.col("_at.level")).withColumn("_node", F.col("_at.node")).drop("_at") for x in (spans, asked))
    return asked.join(spans, ["symbol", "_level", "_node"]).where("valid_from <= ts_us and (valid_to is null or ts_us < valid_to)").drop("_level", "_node")


def best_prices(levels: DataFrame, depth: int = 12) -> DataFrame:
    """(symbol, side, ts_us, best): the best tick of a side, highest bid or lowest ask, from each time on
    at which one of its levels begins or ends; null where none is left.

    The greatest of all open levels cannot be kept by a running window, since levels close.
    Times are numbered, each level's interval of numbers is cut into dyadic nodes, the best of
    each node is aggregated, and a time takes the best of the nodes above it: equi-joins and
    aggregations of n log n rows, whatever the intervals overlap.
    """
    side = ["symbol", "side"]
    times = levels.select(*side, F.col("valid_from").alias("ts_us")).union(levels.where("valid_to is not null").select(*side, "valid_to")).distinct()
    times = sampling.numbered(times, side, ["ts_us"], "_slot", large=True)
    at = lambda c: times.select(*side, F.col("ts_us").alias(c), F.col("_slot").alias(f"_{c}"))
    last = times.groupBy(*side).agg(F.max("_slot").alias("_last"))
    spans = levels.join(at("valid_from"), [*side, "valid_from"]).join(at("valid_to"), [*side, "valid_to"], "left").join(last, side)
    spans = spans.withColumn("_high", F.coalesce("_valid_to", F.col("_last") + 1)).withColumn("_at", F.explode(cover("_valid_from", "_high", depth)))
    up = F.when(F.col("side") == "B", 1).otherwise(-1)
    nodes = spans.groupBy(*side, "_at").agg(F.max(F.col("tick") * up).alias("_best"))
    asked = times.join(last, side).withColumn("_at", F.explode(ancestors("_slot", depth, "_last"))).drop("_slot", "_last")
    found = asked.join(nodes, [*side, "_at"], "left").groupBy(*side, "ts_us").agg(F.max("_best").alias("_best"))
    return found.select(*side, "ts_us", (F.col("_best") * up).alias("best"))


def market_order_prices(orders: DataFrame, fills: DataFrame, best: DataFrame) -> DataFrame:
    """Market orders (symbol, side, ts_us, sequence) with ``tick``, that of their first linked fill, else
    the best of the other side of the book at their time, and ``from_linked_fill``.

    fills: order_sequence, sequence, tick. best: best_prices(..).
    """
    first = fills.groupBy(F.col("order_sequence").alias("sequence")).agg(F.min(F.struct("sequence", "tick"))["tick"].alias("_fill"))
    other = orders.withColumn("side", F.when(F.col("side") == "B", "S").otherwise("B"))
    found = asof.last_before(other, best.select("symbol", "side", "ts_us", F.struct("best").alias("_best")), ["symbol", "side"], "_best")
    found = found.join(first, "sequence", "left").withColumn("side", F.when(F.col("side") == "B", "S").otherwise("B"))
    return found.withColumn("tick", F.coalesce("_fill", "_best.best")).withColumn("from_linked_fill", F.col("_fill").isNotNull()).drop("_fill", "_best")


def with_trades(samples: DataFrame, trades: DataFrame) -> DataFrame:
    """samples (symbol, ts_us, ...) with last_price, volume and turnover of all trades (symbol, ts_us,
    sequence, price, volume) of their symbol up to their time; 0 and no price before the first."""
    w = W.partitionBy("symbol").orderBy("ts_us", "sequence").rowsBetween(W.unboundedPreceding, 0)
    amount = F.col("price") * F.col("volume")
    so_far = trades.select("symbol", "ts_us", F.struct(F.col("sequence"), F.col("price").alias("last_price"), F.sum("volume").over(w).alias("volume"), F.sum(amount).over(w).alias("turnover")).alias("_traded"))
    out = asof.last_before(samples, so_far, ["symbol"], "_traded")
    none = lambda c: F.coalesce(F.col(f"_traded.{c}"), F.lit(0)).alias(c)
    return out.select(*samples.columns, "_traded.last_price", none("volume"), none("turnover"))


def top_levels(alive: DataFrame, key: list[str], n: int | None) -> DataFrame:
    """The n best levels of each side (all if n is None): highest bids, lowest asks; rank from 1."""
    best = F.when(F.col("side") == "B", -F.col("tick")).otherwise(F.col("tick"))
    ranked = alive.withColumn("rank", F.row_number().over(W.partitionBy(*key, "side").orderBy(best)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def visible_book(alive: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """Per sample: arrays of (tick, qty) of the best n levels of each side, best first."""
    top = top_levels(alive, key, n)
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("rank", "tick", "qty")))), lambda x: F.struct(x["tick"].alias("tick"), x["qty"].alias("qty")))
    return top.groupBy(*key).agg(side("B").alias("bids"), side("S").alias("asks"))


def max_volume_level(alive: DataFrame, key: list[str]) -> DataFrame:
    """Per sample and side the level of greatest quantity; of equal ones the lowest tick."""
    return alive.groupBy(*key, "side").agg(F.max(F.struct("qty", (-F.col("tick")).alias("down"))).alias("m")).select(*key, "side", (-F.col("m.down")).alias("tick"), F.col("m.qty").alias("qty"))


def full_book_aggregate(alive: DataFrame, key: list[str], bands: tuple[int, ...] = (1, 5, 10), young_us: int = 60_000_000) -> DataFrame:
    """Per sample with both sides: best ticks b1 and a1, mid and, for each side, sums of volume,
    orders, age, price and amount within bands of the mid (in percent), over the best one and
    five levels and over all; the volume of levels younger than ``young_us`` in the first band;
    the level of greatest volume (of equal ones the lowest tick).

    Best ticks and ranks are windows that share the shuffle by sample with the aggregation.
    """
    sample, (side, tick, qty) = W.partitionBy(*key), (F.col(c) for c in ("side", "tick", "qty"))
    rows = alive.withColumn("b1", F.max(F.when(side == "B", tick)).over(sample)).withColumn("a1", F.min(F.when(side == "S", tick)).over(sample))
    rows = top_levels(rows.where("b1 is not null and a1 is not null").withColumn("mid", (F.col("b1") + F.col("a1")) / 2), key, None)
    away = F.when(F.col("mid") != 0, F.abs(tick - F.col("mid")) / F.col("mid") * 100)
    age = F.col("ts_us") - F.col("since")
    zones = {f"pct{b}": away <= b for b in bands} | {"l1": F.col("rank") <= 1, "l5": F.col("rank") <= 5, "all": F.lit(True)}
    sums = {"volume": qty, "count": F.col("n_orders"), "age": age, "price": tick, "amount": qty * tick}
    out = []
    for name, letter in (("bid", "B"), ("ask", "S")):
        total = lambda inside, x, letter=letter: F.sum(F.when((side == letter) & inside, x).otherwise(0))
        out += [total(inside, x).alias(f"{name}_{zone}_{what}") for zone, inside in zones.items() for what, x in sums.items()]
        out += [total((away <= bands[0]) & (age <= young_us), qty).alias(f"{name}_young_volume"), F.max(F.when(side == letter, F.struct("qty", (-tick).alias("down")))).alias(f"{name}_max")]
    rows = rows.groupBy(*key, "b1", "a1", "mid").agg(*out)
    greatest = {f"{s}_max_{what}": F.col(f"{s}_max.{f}") * sign for s in ("bid", "ask") for what, f, sign in (("volume", "qty", 1), ("tick", "down", -1))}
    return rows.withColumns(greatest).drop("bid_max", "ask_max")


def pending_volume(orders: DataFrame) -> DataFrame:
    """Open quantity of each symbol and side as a map of tick to quantity."""
    level = orders.groupBy(*LEVEL).agg(F.sum("qty").alias("qty")).where("qty > 0")
    return level.groupBy("symbol", "side").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tick", "qty")))).alias("levels"))
