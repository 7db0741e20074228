"""Quality rules: base rules, and robust multivariate outliers by language and source.

Each document's counts become a vector of transformed statistics. For every language
and source the minimum covariance determinant is estimated: the centre and the scatter
of the ``share`` of documents that lie closest together. Starts come from FAST-MCD on
a bounded sample of each group (``sample`` rows in the order of a hash); concentration
steps then run over all documents of the group as aggregations: distances in SQL, the
cut-off from a fixed grid of counts, and new moments from the rows below it. A document
is rejected if its Mahalanobis distance is beyond the cut-off of a chi-squared
distribution, scaled so that the group's median distance fits.

All sums are pre-aggregated by group before they are shuffled, so that a source with a
third of all rows costs no more per task than any other. A group of fewer than
``least`` documents that pass the base rules uses its language's estimate over such
small groups, that of all small groups if these are still too few, and else rejects
nothing.

Edge cases: a null text has no words and fails the base rules, as does an empty one;
null lang or source are groups of their own; repeated rows are counted and judged one
by one, in the sample as often as in the table; groups of equal documents have a floor under
each variance; a document at the cut-off stays; very long texts are counted whole; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, checkpointed, stored

#: Words in the windows whose repetition is counted.
WINDOW = 8
_SPACES = list(b" \t\n\x0b\x0c\r")
_SYMBOLS = list(b"#*$%&|<>")
DIM = 5
#: Floor under each statistic's standard deviation.
FLOOR = 0.15
#: Groups (a name and some thirty numbers each) up to which their estimates are broadcast.
BROADCAST_GROUPS = 20_000
#: Squared distances are counted in this many steps to a doubling.
GRID = 16


def repeated_words(texts: list[list[bytes]], size: int = WINDOW) -> list[int]:
    """Words of each text in windows of ``size`` words (a power of two) found twice or more in it."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    lengths = np.array([len(x) for x in texts], np.int64)
    rank = np.fromiter(map(ids.__getitem__, (w for x in texts for w in x)), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(rank))  # words to the text's end
    step = 1
    while step < size and len(rank):  # ranks of windows of 2, 4, 8 words, exactly
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)
        step *= 2
    starts = np.flatnonzero(left >= size)
    if not len(starts):
        return [0] * len(texts)
    key = doc[starts] * (int(rank.max()) + 1) + rank[starts]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = starts[count[where] >= 2]
    change = np.zeros(len(rank) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(texts)).tolist()


def count_texts(texts: list[bytes | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    pending, size = [], 0
    for text in texts:
        text = text or b""
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_words"].append(len(words))
        out["word_chars"].append(int(counts[:128].sum() + counts[192:].sum() - counts[_SPACES].sum()))
        out["n_symbols"].append(int(counts[_SYMBOLS].sum()))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        pending.append(words)
        size += len(words)
        if size > 500_000:
            out["n_repeat_words"] += repeated_words(pending)
            pending, size = [], 0
    out["n_repeat_words"] += repeated_words(pending)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the five counts, base_failed) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = count_texts(batch.column("text").to_pylist())
        keep = ["doc_id", "lang", "source"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[n], pa.int64()) for n in names)], keep + names)

    rows = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(by_batch(one), f"doc_id {kind}, lang string, source string, " + ", ".join(f"{n} bigint" for n in names))
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def statistics() -> list[Column]:
    """The transformed statistics of a document."""
    n = F.greatest("n_words", F.lit(1))
    rate = lambda c: F.log1p(100 * F.col(c) / n)
    return [F.log1p("n_words"), 4 * F.log(F.greatest("word_chars", F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.cov(x.T, bias=True).reshape(DIM, DIM)


def inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse of a scatter matrix whose variances are at least FLOOR squared."""
    return np.linalg.inv(cov + np.diag(np.maximum(FLOOR**2 - np.diag(cov), 0.02 * FLOOR**2)))


def fast_mcd(x: np.ndarray, share: float, starts: int = 60, steps: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and inverse scatter of the subset of least determinant among random starts."""
    rng, h = np.random.default_rng(seed), max(DIM + 1, math.ceil(share * len(x)))
    best = (np.inf, None, None)
    for _ in range(starts):
        inside = x[rng.choice(len(x), min(len(x), DIM + 1), replace=False)]
        for _ in range(steps):
            centre, cov = scatter(inside)
            precision = inverse(cov)
            away = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
            inside = x[np.argsort(away, kind="stable")[:h]]
        centre, cov = scatter(inside)
        size = -np.linalg.slogdet(inverse(cov))[1]
        if size < best[0]:
            best = (size, centre, inverse(cov))
    return best[1], best[2]


def chi2_quantile(p_normal: float, dim: int = DIM) -> float:
    """Wilson and Hilferty's approximation, from the standard normal quantile."""
    return dim * (1 - 2 / (9 * dim) + p_normal * math.sqrt(2 / (9 * dim))) ** 3


_PARAMS = "estimate string, centre array<double>, precision array<double>"


def _distance(x: str = "x") -> Column:
    terms = [f"({x}[{i}] - centre[{i}]) * precision[{DIM * i + j}] * ({x}[{j}] - centre[{j}])" for i in range(DIM) for j in range(DIM)]
    return F.expr(" + ".join(terms))


def _cell(d2: Column) -> Column:
    """The grid cell of a squared distance."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * GRID).cast("int")


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_MOMENTS = [*(f"s{i}" for i in range(DIM)), *(f"q{i}{j}" for i, j in PAIRS)]


def _cells(sound: DataFrame, params: DataFrame) -> DataFrame:
    """Number and moments of each estimate's rows by cell, with ``upto`` and ``all`` rows."""
    x = F.col("x")
    near = sound.join(params, "estimate").withColumn("cell", _cell(_distance()))
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)] + [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]
    cells = near.groupBy("estimate", "cell").agg(F.count("*").alias("n"), *sums)
    upto = F.sum("n").over(W.partitionBy("estimate").orderBy("cell"))
    return cells.withColumn("upto", upto).withColumn("all", F.sum("n").over(W.partitionBy("estimate")))


def _renewed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Centres and inverse scatters from the moments of the rows below the cut-off."""
    centres, precisions = [], []
    for r in batch.to_pylist():
        mean = np.array([r[f"s{i}"] for i in range(DIM)]) / r["n"]
        square = np.zeros((DIM, DIM))
        for i, j in PAIRS:
            square[i, j] = square[j, i] = r[f"q{i}{j}"] / r["n"]
        centres.append(mean.tolist())
        precisions.append(inverse(square - np.outer(mean, mean)).ravel().tolist())
    vector = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([batch.column("estimate"), pa.array(centres, vector), pa.array(precisions, vector)], ["estimate", "centre", "precision"])


def reject(docs: DataFrame, share: float = 0.75, sample: int = 400, least: int = 60, steps: int = 3, p_normal: float = 5.0) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, distance, cutoff, kept) of every row.

    p_normal: the normal quantile of the cut-off: 3.29 stands for one document in 2000, and 5,
    the default, rejects only what no tail of a skewed statistic explains.
    """
    rows = stored(measured(docs))
    group = rows.where("not base_failed").groupBy("lang", "source").count()
    small = F.col("count") < least
    by_lang = F.sum(F.when(small, F.col("count")).otherwise(0)).over(W.partitionBy("lang"))
    group = group.withColumn("of_lang", by_lang)
    name = F.when(~small, F.to_json(F.array("lang", "source"))).when(F.col("of_lang") >= least, F.to_json(F.array("lang"))).otherwise("[]")
    members = F.sum("count").over(W.partitionBy("estimate"))
    group = group.withColumn("estimate", name).withColumn("members", members)
    named = checkpointed(group.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "estimate", "members"))
    hint = F.broadcast if named.count() <= BROADCAST_GROUPS else (lambda df: df)
    rows = rows.join(hint(named), (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")), "left").drop("_lang", "_source")
    rows = rows.withColumn("x", F.array(*statistics()))
    rows = stored(rows)
    sound = rows.where("not base_failed").select("doc_id", "estimate", "members", "x")

    # About three times as many rows of each group as are wanted, so that what is put in order stays
    # small; of rows that repeat, their share of it to the next whole number by a hash.
    alike = sound.groupBy("estimate", "members", "doc_id", "x").agg(F.count("*").alias("rows"))
    by_chance = F.pmod(F.xxhash64("doc_id", "x", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    share_of = F.least(F.col("rows"), F.floor(F.col("rows") * F.least(F.lit(1.0), 3 * sample / F.col("members")) + by_chance))
    order = W.partitionBy("estimate").orderBy(F.xxhash64("doc_id", "x", "copy"), "doc_id", "copy")
    some = alike.withColumn("taken", share_of).where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))))
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("estimate", "x")

    def start(table: pa.Table) -> pa.Table:
        x = np.array(sorted(table.column("x").to_pylist()))
        names, vector = ["estimate", "centre", "precision"], pa.list_(pa.float64())
        if len(x) < least:
            return pa.table([pa.array([], pa.string()), pa.array([], vector), pa.array([], vector)], names=names)
        centre, precision = fast_mcd(x, share)
        return pa.table([table.column("estimate").slice(0, 1), pa.array([centre.tolist()], vector), pa.array([precision.ravel().tolist()], vector)], names=names)

    params = hint(checkpointed(some.groupBy("estimate").applyInArrow(start, _PARAMS)))
    for _ in range(steps):
        inside = _cells(sound, params).where(F.col("upto") - F.col("n") < F.ceil(F.col("all") * share))
        sums = inside.groupBy("estimate").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _MOMENTS])
        params = hint(checkpointed(sums.mapInArrow(by_batch(_renewed), _PARAMS)))

    middle = _cells(sound, params).where(F.col("upto") >= F.col("all") * 0.5).groupBy("estimate").agg(F.min("cell").alias("middle"))
    # The cell's value over the chi-squared median makes distances comparable.
    scaled = F.pow(F.lit(2.0), (F.col("middle") + 1) / GRID) / chi2_quantile(0.0)
    final = params.join(middle, "estimate").withColumn("cutoff", F.greatest(scaled, F.lit(1.0)) * chi2_quantile(p_normal))
    out = rows.join(hint(checkpointed(final.drop("middle"))), "estimate", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return out.withColumn("kept", kept).drop("x", "centre", "precision", "estimate", "members")
