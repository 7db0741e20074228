"""Hard negatives of anchors, by bounds along a spanning tree of the anchors.

An anchor's positives are the highest-scoring other rows of its label; its hard negatives for
a positive are the highest-scoring rows of other labels whose score lies in a window
relative to the positive's. Scores are inner products of integer vectors.

Anchors are dealt to blocks of about ``BLOCK`` by a hash. Each block gets a minimum spanning
tree by distance, grown in one task per block. A candidate x whose score at the parent a is
known to lie in [lo, hi] scores in [lo - |b - a||x|, hi + |b - a||x|] at the child b
(Cauchy-Schwarz), so bounds run down the tree, and only candidates whose bounds meet what
the child still wants are rescored, which also makes their bounds exact again. What an anchor
wants is the window of its positives, cut below by the last of its best so far once these
are complete. Results are exact: whatever the bounds leave out cannot be among them.

Rows are searched where they lie: blocks of anchors are broadcast, at most ``GROUP`` blocks
at a time, and each task keeps the best rows of each anchor and hands on these only. The
work is the number of anchors times that of rows, as in any exact search for a stated query
set; no pair of rows is formed.

Edge cases: rows with a null id or label, a null vector, or a null or non-finite
component take no part, nor those whose squared norm exceeds 2^60 (no score of theirs need
fit a long); shorter vectors end in zeros; empty vectors score 0; ties go to the smaller id;
exact copies of a row count once, and rows with an anchor's id are not among its
positives or negatives; one id with several contents is several rows; a window of a
negative positive score is empty; an anchor without positives or negatives gives no rows; an
empty table gives none; other columns than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.vectors import exact_dot, matrix, quantised

#: Anchors in a block, about, and blocks that are broadcast together.
BLOCK, GROUP = 2048, 16
TREE = "block int, place int, parent int, edge double, anchor_no long, vec_id long, label long, x array<long>"


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order in which Prim's algorithm takes them, each one's parent as a place in
    that order (-1 for the first), and the distance to it."""
    x = x.astype(float)
    near, parent, done = np.full(len(x), np.inf), np.full(len(x), -1), np.zeros(len(x), bool)
    order, at, place = [], 0, np.zeros(len(x), np.int64)
    while len(order) < len(x):
        place[at] = len(order)
        order.append(at)
        done[at] = True
        distance = np.sqrt(np.square(x - x[at]).sum(1))
        closer = ~done & (distance < near)
        near[closer], parent[closer] = distance[closer], at
        at = int(np.where(done, np.inf, near).argmin())
    order = np.array(order, np.int64)
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    return order, up, np.where(up >= 0, near[order], 0.0)


def trees(anchors: DataFrame) -> DataFrame:
    """Anchors (anchor_no, vec_id, label, x) by block, with places, parents and edges."""
    blocks = -(-anchors.count() // BLOCK)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("anchor_no")
        width = max(map(len, rows.x))
        x = np.array([[*v, *[0] * (width - len(v))] for v in rows.x], np.int64).reshape(len(rows), width)
        order, up, edge = spanning_tree(x)
        return rows.iloc[order].assign(place=range(len(rows)), parent=up, edge=edge)[[c.split()[0] for c in TREE.split(", ")]]

    block = F.pmod(F.xxhash64("anchor_no"), F.lit(max(1, blocks))).cast("int")
    return anchors.withColumn("block", block).groupBy("block").applyInPandas(grow, TREE)


class _Block:
    """The anchors of one block in the order of their tree, and what each wants."""

    def __init__(self, rows: list, best: int):
        rows.sort(key=lambda r: r["place"])
        self.no, self.ids, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("anchor_no", "vec_id", "label"))
        width = max((len(r["x"]) for r in rows), default=0)
        self.x = np.array([[*r["x"], *[0] * (width - len(r["x"]))] for r in rows], np.int64).reshape(len(rows), width)
        self.parent, self.edge = [r["parent"] for r in rows], [r["edge"] for r in rows]
        self.norm = np.sqrt(np.square(self.x.astype(float)).sum(1))
        self.windows = [r["windows"] for r in rows]  # (lowest, highest) scores of each list, or none for positives
        self.last_use = {p: k for k, p in enumerate(self.parent)}
        self.best, self.same = best, "positives" in (rows[0]["kind"] if rows else "")
        self.found: list[list[np.ndarray]] = [[np.zeros((0, 2), np.int64)] * len(w) for w in self.windows]
        self.rescored = self.seen = 0

    def lowest(self, k: int) -> float:
        """Below this score nothing is wanted any more."""
        return min(float(max(lo, f[-1, 0]) if len(f) == self.best else lo) for f, (lo, _) in zip(self.found[k], self.windows[k]))

    def search(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Candidates in the order of their ids."""
        width = max(x.shape[1], self.x.shape[1])
        x, mine = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.x))
        norm = np.sqrt(np.square(x.astype(float)).sum(1))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, parent in enumerate(self.parent):
            slack = 1 + 1e-12 * self.norm[k] * norm  # of floating point
            if parent < 0:
                lo, hi = np.full(len(x), -np.inf), np.full(len(x), np.inf)
            else:
                reach = self.edge[k] * (1 + 1e-9) * norm + slack
                lo, hi = bounds[parent][0] - reach, bounds[parent][1] + reach
                if self.last_use[parent] == k:
                    del bounds[parent]
            wanted = ((labels == self.label[k]) == self.same) & (ids != self.ids[k])
            if self.windows[k]:
                meets = (hi >= self.lowest(k)) & (lo <= max(b for _, b in self.windows[k]))
            else:
                meets = np.zeros(len(x), bool)
            at = np.flatnonzero(meets & wanted if parent >= 0 else meets | True)
            score = exact_dot(mine[k : k + 1], x[at])[0] if len(at) else np.zeros(0, np.int64)
            self.rescored, self.seen = self.rescored + len(at), self.seen + len(x)
            if k in self.last_use:
                lo[at], hi[at] = score - slack[at], score + slack[at]
                bounds[k] = lo, hi
            take = wanted[at]
            score, at = score[take], at[take]
            for j, (low, high) in enumerate(self.windows[k]):
                inside = (score >= low) & (score <= high)
                if inside.any():
                    rows = np.concatenate([self.found[k][j], np.stack([score[inside], ids[at][inside]], 1)])
                    rows = np.unique(rows, axis=0)
                    self.found[k][j] = rows[np.lexsort((rows[:, 1], -rows[:, 0]))][: self.best]

    def results(self) -> Iterator[tuple[int, int, int, int]]:
        for no, lists in zip(self.no.tolist(), self.found):
            for j, rows in enumerate(lists):
                yield from ((no, j, score, i) for score, i in rows.tolist())


def _searched(rows: DataFrame, tree: DataFrame, best: int) -> DataFrame:
    """Best rows (anchor_no, list, score, vec_id) of each task; ``tree`` has the anchors with
    windows array<struct<lowest, highest>> and kind."""
    spark, outs = rows.sparkSession, []
    blocks = [r["block"] for r in tree.select("block").distinct().orderBy("block").collect()]
    for first in range(0, len(blocks), GROUP):
        held = spark.sparkContext.broadcast([r.asDict() for r in tree.where(F.col("block").isin(blocks[first : first + GROUP])).collect()])

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            by_block: dict[int, list] = {}
            for r in held.value:
                by_block.setdefault(r["block"], []).append(r)
            own = [_Block(x, best) for x in by_block.values()]
            for batch in batches:
                if not len(batch):
                    continue
                width = int(np.diff(batch.column(2).offsets.to_numpy()).max())
                ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                order, x = np.argsort(ids, kind="stable"), matrix(batch.column(2), width)
                for block in own:
                    block.search(ids[order], labels[order], x[order])
            for block in own:
                found = list(block.results())
                for a in range(0, len(found), 100_000):
                    part = list(zip(*found[a : a + 100_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1], pa.int32()), *map(pa.array, part[2:])], names=["anchor_no", "list", "score", "vec_id"])

        outs.append(rows.select("vec_id", "label", "x").mapInArrow(search, "anchor_no long, list int, score long, vec_id long"))
    if not outs:
        return spark.createDataFrame([], "anchor_no long, list int, score long, vec_id long, rank int")
    out = outs[0]
    for more in outs[1:]:
        out = out.union(more)
    order = W.partitionBy("anchor_no", "list").orderBy(F.desc("score"), "vec_id")
    return out.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mine(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per anchor, positive and negative, ranked from 1: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. ``window``: hundredths of the positive's score."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised(vector_col, scale).alias("x"), is_anchor.alias("is_anchor"))
    rows = stored(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL"))
    number = F.xxhash64("vec_id", "label", "x")
    anchors = rows.where("is_anchor").select("vec_id", "label", "x").distinct().withColumn("anchor_no", number)
    tree = stored(trees(anchors))
    ends = "array<struct<lowest:long,highest:long>>"
    whole = F.array(F.struct(F.lit(-(1 << 61)).alias("lowest"), F.lit(1 << 61).alias("highest"))).cast(ends)
    best = stored(_searched(rows, tree.withColumn("windows", whole).withColumn("kind", F.lit("positives")), positives))
    # 100 n >= 30 p and 100 n <= 90 p, in whole numbers: ceil(30 p / 100) and floor(90 p / 100).
    wide = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(wide * window[0] / F.lit(100)).cast("long"), F.floor(wide * window[1] / F.lit(100)).cast("long")
    lists = best.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("lowest"), high.alias("highest")))).alias("l"))
    asked = F.transform(F.col("l"), lambda x: F.struct(x["lowest"].alias("lowest"), x["highest"].alias("highest"))).cast(ends)
    wanted = tree.join(lists, "anchor_no", "left").withColumn("windows", F.coalesce(asked, F.array().cast(ends))).withColumn("kind", F.lit("negatives")).drop("l")
    found = _searched(rows, stored(wanted), negatives)
    names = tree.select("anchor_no", F.col("vec_id").alias("anchor_id"))
    positive = best.select("anchor_no", (F.col("rank") - 1).alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("anchor_no", "list", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(positive, ["anchor_no", "list"]).join(names, "anchor_no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
