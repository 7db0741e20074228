"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, and summed into one
lookup table per feature; then pairs of features, chosen by how much of the residual
they explain, get two-dimensional tables in the same way. A score is the logistic of
an intercept plus one table entry per feature and pair: additions over bin numbers.

The model is fitted on at most ``max_rows`` labels, taken in the order of a hash of their
id; scoring covers every row and whole texts. Features come from the text alone.

Edge cases: a null text scores like an empty one; very long texts are read whole;
unlabelled rows are allowed; of contradictory labels of one id each counts; of several
texts of one labelled id the one with the least hash is learned from; without any labelled
row every score is 0.5 (predicted 1, nothing is filtered away); a score of exactly 0.5 is
predicted 1 and kept; repeated rows score alike; an empty table gives no rows; extra
columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, thinned

FEATURES = [
    "words", "word_bytes", "distinct_words", "distinct_pairs", "top_word", "stop_words", "lines", "distinct_lines", "line_words",
    "upper", "digits", "spaces", "sentence_marks", "other_marks", "top_mark", "non_ascii", "marked_words", "capital_words",
]

#: Frequent function words of the languages in view.
STOP_WORDS = frozenset(
    "the of and to in that is was for with as be this are it on by from at or an have not "
    "le la les de des du et un une dans que qui pour par sur au en est pas avec "
    "der die das und von zu den mit dem ist ein eine im auf nicht sich für des "
    "el los las y del por con para una que se no su al lo como".encode().split()
)

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[128:] = 6


def features(text: bytes | None) -> list[float]:
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, minlength=7)
    words = text.lower().split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    marks = np.where(_CLASS == 5, counts, 0)
    bare = sum(c for w, c in seen.items() if w.strip(b".,;:?'\"()-").isalpha() or w[:1] >= b"\x80")
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, len(seen) / n, len(set(zip(words, words[1:]))) / n, max(seen.values(), default=0) / n,
        sum(c for w, c in seen.items() if w in STOP_WORDS) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / n, kinds[5] / n, marks.max() / n, kinds[6] / size,
        1 - bare / n, sum(w[:1].isupper() for w in text.split()) / n,
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """edges[j]: bin edges; tables[j]: a value per bin; pairs: (i, j, edges, edges, table)."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of one run of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gains[(left_h < 0.5) | (h.sum() - left_h < 0.5)] = 0
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree that cuts the bins' order at most ``depth`` levels deep."""
    gain, cut = _best_cut(g, h)
    if depth and gain > 0:
        return np.concatenate([_shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one axis and then each side along the other; its gain and leaf values."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            gain, rows = -_gain(g.sum(), h.sum()), []
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(axis=0), b[part].sum(axis=0)
                more, at = _best_cut(pg, ph)
                gain += more + _gain(pg.sum(), ph.sum())
                rows.append(np.concatenate([np.full(len(x), x.sum() / (y.sum() + 1.0)) for x, y in zip(np.split(pg, [at]), np.split(ph, [at]))]))
            if gain > best:
                out = np.concatenate([np.tile(rows[0], (cut, 1)), np.tile(rows[1], (len(a) - cut, 1))])
                best, values = gain, out.T if turned else out
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1, bins: int = 64) -> Gam:
    if not len(y):
        return Gam()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    cut_points = lambda col, n: np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [cut_points(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)))
            table += step
            total += step[at[j]]
    coarse = [cut_points(x[:, j], 8) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cell[i] * shape[1] + cell[j]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in slopes())

    gains = {(i, j): _pair_tree(*grid(i, j))[0] for i, j in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            step = rate * _pair_tree(*grid(i, j))[1]
            table += step
            total += step[cell[i], cell[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000) -> Gam:
    """A model of ``label`` from at most ``max_rows`` rows of labels and their documents."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).distinct()
    chosen = thinned(chosen, ["doc_id"], max_rows, F.lit(chosen.count()))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = rows.join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("text_hash"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "text_hash", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(by_batch(one), f"doc_id {kind}, y double, text_hash bigint, x array<double>")
    rows = found.groupBy("doc_id", "y").agg(F.min_by("x", "text_hash").alias("x")).collect()  # max_rows at most
    rows.sort(key=lambda r: (r.y, r.x))  # sums of floats, and so ties between cuts, depend on the order
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.score(matrix(batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(by_batch(one), f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam) -> DataFrame:
    """The documents with a score of 0.5 or more, with all their columns."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(matrix(batch.column("text").cast(pa.binary()).to_pylist())) >= 0.5))

    return docs.mapInArrow(by_batch(one), docs.schema)


def brute_force(text: str | None, model: Gam) -> float:
    """The score of a text by plain loops over bin edges, for tests."""
    values, total = features(text and text.encode()), model.intercept
    for value, edges, table in zip(values, model.edges, model.tables):
        total += table[sum(e <= value for e in edges)]
    for i, j, a, b, table in model.pairs:
        total += table[sum(e <= values[i] for e in a)][sum(e <= values[j] for e in b)]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))
