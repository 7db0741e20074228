"""Benchmark decontamination with suffix arrays over shards of the training text.

Arrow batches of documents that together hold ``SHARD_BYTES`` make a shard. Its words become integers under the
vocabulary of the test items; words that no item has cannot be part of a match and
end a run. Prefix doubling ranks the suffixes of the shard's runs together with those
of the test items, so that ranks compare across both. The shard's suffixes are sorted
and every distinct test window is binary-searched among them (all at once in numpy);
its occurrences are marked on the document's words. Where a window occurs, the longest
verbatim match is that with a neighbour in the order of the test suffixes. Time and
memory grow in proportion to the words of the shard and of the block of test items,
times the logarithm of the longest match, also for texts that repeat themselves.

Test items are the stated query set. They reach the shards in blocks of bounded size
(``BLOCK_CHARS`` of text, more only if a single item is longer): one pass over the
documents for each block, whose matches are written and merged by document. The driver
builds one block, ships it, and forgets it before it builds the next.

Edge cases: null and wordless texts have no words and are never contaminated; a null
or wordless item has no window; items with the same text or the same id are all
searched, and an id is named once; a null item id is ignored; repeated document rows
are judged one by one; of equally long matches the first is reported; texts and items
of any length are read whole; empty tables give an empty result or no matches; only
doc_id, text, item_id and text are read, other columns pass through ``decontaminate``
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored

#: Characters of test items that one pass over the documents searches for.
BLOCK_CHARS = 8_000_000
#: Bytes of text in a shard at least, unless a task has less: a block of items is ranked once
#: for each, however short the rows.
SHARD_BYTES = 16_000_000

#: ASCII letters lower-cased; all that is no ASCII digit, letter or non-ASCII byte to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class TestWindows:
    """A block of test items: their words end to end, a 0 after each item, and the windows."""

    __test__ = False  # not a pytest class

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        named: dict[bytes, set[str]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                named.setdefault(ids.tobytes(), set()).add(item)
        self.items = [sorted(x) for x in named.values()]
        parts = [np.frombuffer(x, np.int32) for x in named]
        length = np.array([len(x) for x in parts], np.int64)
        self.flat = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int32))]) if parts else np.zeros(0, np.int32)
        #: Where windows start, how many words they have, and the items that they are of.
        windows = np.maximum(length - window, 0) + 1
        self.item = np.repeat(np.arange(len(parts)), windows)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(length + 1) - length - 1, windows)
        self.size = np.minimum(window, length)[self.item]
        self.window, self.shortest = window, int(self.size.min(initial=window)) if parts else 0


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (count[0] of them), first[1], .. and so on."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Ranks:
    """Ranks of the suffixes of an array of words by their first 1, 2, 4, .. words."""

    def __init__(self, words: np.ndarray):
        self.levels = [words.astype(np.int64)]
        #: Words up to the next 0.
        stops = np.flatnonzero(words == 0)
        self.left = stops[np.searchsorted(stops, np.arange(len(words)))] - np.arange(len(words))

    def deepen(self) -> np.ndarray:
        rank, step = self.levels[-1], 1 << (len(self.levels) - 1)
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:]
        self.levels.append(np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)[1])
        return self.levels[-1]

    def by(self, size: int) -> np.ndarray:
        """Keys that order the suffixes by their first ``size`` words."""
        level = size.bit_length() - 1
        while len(self.levels) <= level:
            self.deepen()
        rank, more = self.levels[level], size - (1 << level)
        behind = np.zeros_like(rank)
        behind[: len(rank) - more] = rank[more:]
        return rank * (int(rank.max()) + 1) + behind if more else rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of words that the suffixes at a and b have in common, within their runs."""
        n, last = np.zeros(len(a), np.int64), len(self.left) - 1
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            n += np.where(rank[np.minimum(a + n, last)] == rank[np.minimum(b + n, last)], 1 << level, 0)
        return np.minimum(np.minimum(n, self.left[a]), self.left[b])


def longest_matches(ranks: Ranks, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For suffixes at ``at`` the most words that they share with one at ``starts``."""
    rank = ranks.levels[-1]
    while np.isin(rank[at], rank[starts]).any() and 1 << (len(ranks.levels) - 1) < len(rank):
        rank = ranks.deepen()
    order = starts[np.argsort(rank[starts], kind="stable")]
    place = np.searchsorted(rank[order], rank[at])
    return np.maximum(*(ranks.common(at, order[np.clip(place + side, 0, len(order) - 1)]) for side in (-1, 0)))


def match_shard(texts: list[bytes | None], tests: TestWindows) -> dict[str, list]:
    """Per text: n_words, spans of hit words, items, the longest match and its place."""
    get = tests.vocabulary.get
    ids, n_words = [], []
    for text in texts:
        words = words_of(text)
        n_words.append(len(words))
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
    out = {"n_words": n_words, "spans": [[] for _ in texts], "items": [[] for _ in texts], "longest": [0] * len(texts), "longest_at": [None] * len(texts)}
    if not tests.shortest or not texts:
        return out
    ends = np.cumsum([len(x) + 1 for x in ids])  # each text is followed by a word that ends runs
    begins = ends - [len(x) + 1 for x in ids]
    everything = np.zeros(int(ends[-1]), np.int32)
    for begin, x in zip(begins, ids):
        everything[begin : begin + len(x)] = x
    stops = np.flatnonzero(everything == 0)
    starts = np.concatenate([[0], stops[:-1] + 1])
    long = stops - starts >= tests.shortest
    place = runs(starts[long], stops[long] - starts[long] + 1)  # with the word that ends the run
    if not len(place):
        return out
    ranks, n = Ranks(np.concatenate([everything[place], tests.flat])), len(place)
    change, best, found = np.zeros(n + 1, np.int64), np.zeros(n, np.int64), []
    for size in np.unique(tests.size).tolist():
        key = ranks.by(size)
        chosen = tests.size == size
        order = np.flatnonzero(ranks.left[:n] >= size)
        order = order[np.argsort(key[order], kind="stable")]
        wanted, which = np.unique(key[n + tests.start[chosen]], return_inverse=True)
        low, high = (np.searchsorted(key[order], wanted, side) for side in ("left", "right"))
        at, window = order[runs(low, high - low)], np.repeat(np.arange(len(wanted)), high - low)
        if not len(at):
            continue
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        where, at_of = np.unique(at, return_inverse=True)
        best[where] = np.maximum(best[where], longest_matches(ranks, where, n + tests.start[chosen]) if size == tests.window else size)
        # Items of each distinct window, for each document that has the window.
        pairs = np.unique(which.astype(np.int64) * len(tests.items) + tests.item[chosen])
        of, item = pairs // len(tests.items), pairs % len(tests.items)
        doc = np.searchsorted(ends, place[where], "right")[at_of]
        seen = np.unique(doc * len(wanted) + window)
        first, stop = (np.searchsorted(of, seen % len(wanted), side) for side in ("left", "right"))
        found.append(np.unique(np.repeat(seen // len(wanted), stop - first) * len(tests.items) + item[runs(first, stop - first)]))
    if not found:
        return out
    where = np.flatnonzero(best)
    doc = np.searchsorted(ends, place[where], "right")
    first = np.lexsort((where, -best[where], doc))
    first = first[np.unique(doc[first], return_index=True)[1]]
    for d, p in zip(doc[first].tolist(), where[first].tolist()):
        out["longest"][d], out["longest_at"][d] = int(best[p]), int(place[p] - begins[d])
    # Hit words: the union of all windows' occurrences.
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        d = int(np.searchsorted(ends, place[a], "right"))
        begin = int(place[a] - begins[d])
        out["spans"][d].append({"start": begin, "end": begin + int(b - a)})
    named: dict[int, set[str]] = {}
    for pair in np.unique(np.concatenate(found)).tolist():
        named.setdefault(pair // len(tests.items), set()).update(tests.items[pair % len(tests.items)])
    for d, items in named.items():
        out["items"][d] = sorted(items)
    return out


def blocks_of(benchmark: DataFrame, window: int) -> Iterator[tuple[TestWindows, bool]]:
    """The test items as blocks of about BLOCK_CHARS, one at a time; the last is marked."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = items.where(of == k).toLocalIterator() if n > 1 else items.toLocalIterator()
        yield TestWindows([(r.item_id, bytes(r.text) if r.text is not None else None) for r in rows], window), k == n - 1


def by_shard(column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """An iterator function for ``mapInArrow`` from one that maps a shard: batches together that
    hold SHARD_BYTES of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.column(column).nbytes
            if held and (batch is None or size >= SHARD_BYTES):
                yield from map(fn, pa.Table.from_batches(held).combine_chunks().to_batches())
                held, size = [], 0

    return run


_FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, longest int, longest_at int"


def _pass(docs: DataFrame, shared) -> DataFrame:
    """What a block finds in each row; shared is the broadcast block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = match_shard(batch.column("text").to_pylist(), shared.value)
        types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.int32(), pa.int32()]
        arrays = [pa.array(v, t) for v, t in zip(found.values(), types)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *arrays], ["doc_id", "text_hash", *found])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(by_shard("text", run), f"doc_id {kind}, text_hash bigint, {_FOUND}")


def _passes(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame | None, object]:
    """What all blocks but the last find, written, and the last block as a broadcast."""
    before = None
    for tests, is_last in blocks_of(benchmark, window):
        shared = docs.sparkSession.sparkContext.broadcast(tests)  # a block at most
        if is_last:
            return before, shared
        hits = stored(_pass(docs, shared).where("longest > 0").distinct())
        shared.destroy()
        before = hits if before is None else before.union(hits)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, spans (word offsets, end exclusive), items,
    longest (words of the longest verbatim match), longest_at (its first word), contaminated
    (one word in ``one_in`` at least lies in an occurrence of a window)."""
    before, last = _passes(docs, benchmark, window)
    out = _pass(docs, last)
    if before is not None:
        joined = before.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
            F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"),
            F.max(F.struct("longest", (-F.col("longest_at")).alias("back"))).alias("_best"))
        out = out.join(joined, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
        none = F.array()
        best = F.greatest(F.struct("longest", (-F.col("longest_at")).alias("back")), "_best")
        out = out.select(
            "doc_id", "text_hash", "n_words", F.concat("spans", F.coalesce("_spans", none.cast("array<struct<start:int,end:int>>"))).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", none.cast("array<string>"))))).alias("items"),
            best["longest"].alias("longest"), (-best["back"]).alias("longest_at"))
    n_hit = F.expr("""aggregate(array_sort(spans), struct(0L as n, 0 as upto),
        (s, x) -> struct(s.n + greatest(x.end - greatest(s.upto, x.start), 0) as n, greatest(s.upto, x.end) as upto), s -> s.n)""")
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    before, last = _passes(docs, benchmark, window)
    width, several = len(docs.columns), before is not None
    rows = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("binary").alias("_text"))
    if several:
        spans = before.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.flatten(F.collect_list("spans")).alias("_before"))
        rows = rows.withColumn("_doc_id", F.col(f"_in_{docs.columns.index('doc_id')}")).withColumn("_text_hash", F.xxhash64(f"_in_{docs.columns.index('text')}"))
        rows = rows.join(spans, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left").select(*rows.columns[:width], "_text", "_before")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = match_shard(batch.column("_text").to_pylist(), last.value)
        more = batch.column("_before").to_pylist() if several else repeat(None)
        keep = []
        for n, spans, others in zip(found["n_words"], found["spans"], more):
            hit = upto = 0
            for s in sorted([*spans, *(others or [])], key=lambda s: s["start"]):
                hit += max(0, s["end"] - max(upto, s["start"]))
                upto = max(upto, s["end"])
            keep.append(not hit or hit * one_in < n)
        return batch.select(list(range(width))).filter(pa.array(keep, pa.bool_()))

    schema = T.StructType([T.StructField(f"_in_{i}", f.dataType, True) for i, f in enumerate(docs.schema)])
    return rows.mapInArrow(by_shard("_text", clean), schema).select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(items) -> F.Column:
    """Hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> dict:
    """doc_id -> (n_words, n_hit, sorted items, hex digest) by plain loops, for tests."""
    out = {}
    for doc, text in docs:
        words, hit, named = words_of(text and text.encode()), set(), set()
        for item, t in items:
            w = words_of(t and t.encode())
            for at in range(max(1, len(w) - window + 1) if w else 0):
                piece = w[at : at + window]
                for p in range(len(words) - len(piece) + 1):
                    if words[p : p + len(piece)] == piece:
                        hit.update(range(p, p + len(piece)))
                        named.add(str(item))
        out[doc] = (len(words), len(hit), sorted(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
    return out
