"""Recurrent scoring of instrument-days, and checks of weights and results.

The network is a stack of dense layers with softsign, a residual projection, gated
recurrent layers, a layer norm and a small head; sizes are read from the weights. A
state belongs to one instrument and day and starts at zero. Sequences are independent,
so Spark deals rows to tasks by instrument-day; within a task all sequences
advance together, one numpy step per row number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def random_weights(inputs: int, dense: list[int], hidden: int, head: list[int], layers: int = 1, residual: bool = True, seed: int = 1) -> dict[str, np.ndarray]:
    """Seeded weights of a network's shape (trained ones are not at hand)."""
    rng = np.random.default_rng(seed)
    make = lambda rows, cols: (rng.normal(size=(rows, cols)) / np.sqrt(cols)).astype(np.float32)
    w, size = {}, inputs
    for i, n in enumerate(dense):
        w[f"dense{i}.w"], w[f"dense{i}.b"], size = make(n, size), np.zeros(n, np.float32), n
    if residual:
        w["residual.w"] = make(size, inputs)
    for i in range(layers):
        w[f"gru{i}.wi"], w[f"gru{i}.wh"] = make(3 * hidden, size), make(3 * hidden, hidden)
        w[f"gru{i}.bi"], w[f"gru{i}.bh"] = np.zeros(3 * hidden, np.float32), np.zeros(3 * hidden, np.float32)
        size = hidden
    w["norm.g"], w["norm.b"] = np.ones(hidden, np.float32), np.zeros(hidden, np.float32)
    for i, n in enumerate([*head, 1]):
        w[f"head{i}.w"], w[f"head{i}.b"], size = make(n, size), np.zeros(n, np.float32), n
    return w


def patterned_weights(inputs: int, dense: list[int], hidden: int, head: list[int], layers: int = 1, residual: bool = True) -> dict[str, np.ndarray]:
    """Double-precision weights of a network's shape by a rule, for comparison with other engines: that
    of row r and column c (from 0) of the k-th matrix is ((7 r + 3 c + k) mod 13 - 6) / (4 sqrt(columns)),
    the biases of the k-th are ((r + k) mod 5 - 2) / 10."""
    out = random_weights(inputs, dense, hidden, head, layers, residual)
    for k, name in enumerate(n for n in out if n.split(".")[1][0] == "w"):
        r, c = np.indices(out[name].shape)
        out[name] = ((7 * r + 3 * c + k) % 13 - 6) / (4 * np.sqrt(out[name].shape[1]))
    for k, name in enumerate(n for n in out if n.split(".")[1][0] == "b" and n != "norm.b"):
        out[name] = ((np.arange(len(out[name])) + k) % 5 - 2) / 10
    return {n: np.asarray(v, np.float64) for n, v in out.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.dense = sum(k.startswith("dense") for k in weights) // 2
        self.layers = sum(k.startswith("gru") for k in weights) // 4
        self.head = sum(k.startswith("head") for k in weights) // 2
        self.hidden, self.kind = weights["gru0.wh"].shape[1], weights["gru0.wh"].dtype

    def start(self, n: int) -> np.ndarray:
        return np.zeros((self.layers, n, self.hidden), self.kind)

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of n rows and the states after them."""
        w, h = self.w, x
        for i in range(self.dense):
            z = h @ w[f"dense{i}.w"].T + w[f"dense{i}.b"]
            h = z / (1 + np.abs(z))
        if "residual.w" in w:
            h = h + x @ w["residual.w"].T
        out = np.empty_like(state)
        for i in range(self.layers):
            a, b = h @ w[f"gru{i}.wi"].T + w[f"gru{i}.bi"], state[i] @ w[f"gru{i}.wh"].T + w[f"gru{i}.bh"]
            n = self.hidden
            reset, update = _sigmoid(a[:, :n] + b[:, :n]), _sigmoid(a[:, n : 2 * n] + b[:, n : 2 * n])
            new = np.tanh(a[:, 2 * n :] + reset * b[:, 2 * n :])
            out[i] = h = (1 - update) * new + update * state[i]
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5) * w["norm.g"] + w["norm.b"]
        for i in range(self.head):
            h = h @ w[f"head{i}.w"].T + w[f"head{i}.b"]
            h = h / (1 + np.abs(h)) if i < self.head - 1 else h
        return h[:, 0], out


def score(rows: DataFrame, weights: dict[str, np.ndarray], symbol: str = "symbol", day: str = "trading_day", number: str = "row_in_stock_day", features: str = "x", states: bool = False) -> DataFrame:
    """(symbol, day, number, prediction): every row scored in its instrument-day's order, with
    ``states`` also ``hidden``, the layers' states after it end to end. Computed in the weights' precision.

    Rows are dealt to tasks by instrument-day, as many as shuffles have, and sorted by row number
    within, so that a task reads its rows once, in order, and keeps only the states.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    dealt = rows.select(symbol, day, number, features).repartition(symbol, day).sortWithinPartitions(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, lane, state = Network(shared.value), {}, None
        for batch in batches:
            keys = list(zip(batch.column(symbol).to_pylist(), batch.column(day).to_pylist()))
            for k in keys:
                lane.setdefault(k, len(lane))
            at = np.array([lane[k] for k in keys], np.int64)
            grown = net.start(len(lane))
            if state is not None:
                grown[:, : state.shape[1]] = state
            state = grown
            x = np.array(batch.column(features).to_pylist(), net.kind)
            out, hidden = np.empty(len(at), net.kind), np.empty((len(at) if states else 0, net.layers * net.hidden), net.kind)
            # Rows of one number belong to different instrument-days: one step for all.
            numbers = np.array(batch.column(number).to_pylist())
            for run_ in np.split(np.arange(len(at)), np.flatnonzero(np.diff(numbers)) + 1) if len(at) else []:
                out[run_], state[:, at[run_]] = net.step(x[run_], state[:, at[run_]])
                if states:
                    hidden[run_] = state[:, at[run_]].transpose(1, 0, 2).reshape(len(run_), -1)
            more = [pa.array(list(hidden.astype(np.float64)), pa.list_(pa.float64()))] if states else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (symbol, day, number)), pa.array(out.astype(np.float64)), *more], [symbol, day, number, "prediction", *["hidden"] * states])

    return dealt.mapInArrow(run, f"{symbol} {kinds[symbol]}, {day} {kinds[day]}, {number} {kinds[number]}, prediction double" + ", hidden array<double>" * states)


def linear_score(rows: DataFrame, weights: DataFrame, key: list[str], features: str = "x") -> DataFrame:
    """(key, output, score): the first dense layer as SQL. weights: (output, position, w), from 0."""
    each = rows.select(*key, F.posexplode(features).alias("position", "v"))
    return each.join(weights, "position").groupBy(*key, "output").agg(F.sum(F.col("v").cast("double") * F.col("w")).alias("score"))


def check_weights(weights: DataFrame, expected: DataFrame, factors: list[str] | None = None) -> DataFrame:
    """Per name: whether the shape is the expected one and all values are finite. With the ordered names
    of the ``factors`` also ``contract_ok``: weights.factor_hash is their hash (factor_hash)."""
    finite = F.forall("values", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    both = expected.select("name", F.col("shape").alias("want")).join(weights, "name", "left")
    contract = [] if factors is None else [F.coalesce(F.col("factor_hash") == factor_hash(factors), F.lit(False)).alias("contract_ok")]
    return both.select("name", F.coalesce(F.col("shape") == F.col("want"), F.lit(False)).alias("shape_ok"), F.coalesce(finite, F.lit(False)).alias("finite"), *contract)


def factor_hash(names: list[str]) -> Column:
    """SHA-256 of the factors' names in the order in which a model takes them."""
    return F.sha2(F.concat_ws("\n", *[F.lit(n) for n in names]), 256)


def golden_check(expected: DataFrame, actual: DataFrame, key: list[str], value: str, hidden: str | None = None, tolerance: float = 1e-5) -> DataFrame:
    """One row: the greatest absolute error of the predictions and, if named, of the hidden states,
    rows that only one side has, states of different length, and whether all is well."""
    side = lambda df, n: df.select(*key, F.col(value).alias(f"_{n}"), *([F.col(hidden).alias(f"_{n}h")] if hidden else []), F.lit(True).alias(f"_{n}_in"))
    both = side(expected, "e").join(side(actual, "a"), key, "full_outer")
    out = [F.max(F.abs(F.col("_e") - F.col("_a"))).alias("max_error"), F.count_if(F.col("_e_in").isNull() | F.col("_a_in").isNull() | F.col("_e").isNull() | F.col("_a").isNull()).alias("missing")]
    good = (F.col("max_error") <= tolerance) & (F.col("missing") == 0)
    if hidden:
        apart = F.array_max(F.zip_with("_eh", "_ah", lambda x, y: F.abs(x - y)))
        out += [F.max(apart).alias("max_hidden_error"), F.count_if(F.size("_eh") != F.size("_ah")).alias("unlike")]
        good &= (F.col("max_hidden_error") <= tolerance) & (F.col("unlike") == 0)
    return both.agg(*out).withColumn("passed", F.coalesce(good, F.lit(False)))
