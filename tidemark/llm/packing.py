"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

A document is its token ids and a closing id. Documents longer than a sequence are cut into
full pieces, of which the first may be shorter. What is packed is known by its length, so
the plan is made from a histogram of at most ``capacity`` lengths, however many documents
there are, and a piece finds its place by its length and its rank among the pieces of that
length:

* full pieces are sequences of their own;
* pieces above ``small`` are lined up by length and cut into groups of equal cardinality,
  each rounded up to its longest piece. The few sizes so made are packed by a linear
  programme over configurations (sets of sizes that fit a sequence), whose columns are
  found by a knapsack; each configuration is used the whole number of times below its share;
* actual pieces take the rounded places in order of length, so that along a run of
  sequences only a few lengths change and the true room left is known for each run;
* small pieces, and the few large ones that rounding down left over, go longest first into
  the sequence with the least room that holds them, a run at a time.

Several numbers of groups are tried on the histogram and the plan of fewest sequences stays.
A plan is a table of runs (length, first rank, how many, first sequence, offset), whose size
depends on the number of lengths and groups only; it is broadcast up to ``BROADCAST_RUNS``.

Texts are read once. Each task numbers its pieces by length; one row for each task and
length turns that into ranks over all tasks, so a length that a third of all pieces have is
dealt like any other. The numbered pieces are written to the shared folder before they are
counted, so lost executors change no rank.

Edge cases: a null text is an empty one, which is the closing id alone; ids of null and
repeated rows are packed row by row; texts of any length are cut; ties take places in the order
of their tasks; an empty table gives no rows; other columns than the two named are
ignored. The text of a special token is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Numbers of groups that are tried.
GROUPS = (24, 96)
BROADCAST_RUNS = 200_000
SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, nth long"

# The byte-level pre-tokenizer's pattern, and characters whose classes may differ between
# versions of Unicode: texts with one go to the tokenizer's own library.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = re.compile(r"[^\t-\r -~\xa1-ſ‐-‧€]")


@cache
def ids_by(path: str) -> Callable[[str], list[int]]:
    """A text's ids by the tokenizer in a file that every executor has.

    A byte-level BPE whose merges stand in the order of their ids is run as ranks, which
    gives the same ids several times faster; any other as it is.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    model, before = parts["model"], parts.get("pre_tokenizer") or {}
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges", [])]
    plain = parts.get("normalizer") is None and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
    if not plain or model["type"] != "BPE" or model.get("dropout") or [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return slow
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in parts.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in word): rank for word, rank in model["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if _OTHER.search(text) else fast(text)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document, numbered by length within their task."""
    kind = docs.schema[id_col].dataType
    schema = SCHEMA.format(id=kind.simpleString()) + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = ids_by(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*ids_of(text.as_py() or ""), end_id], "<u4")
                stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                for piece, (start, stop) in enumerate(zip([0, *stops], stops)):
                    own = ids[start:stop].tobytes()
                    at.append(k)
                    rows.append((piece, start, stop - start, zlib.crc32(own), part, int(seen[stop - start]), own))
                    seen[stop - start] += 1
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()][: 6 + keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: 7 + keep_ids])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size together fit ``capacity`` and are worth most."""
    left = np.arange(capacity + 1)[:, None] - sizes
    fits, left = left >= 0, np.maximum(left, 0)
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    while True:
        gain = np.where(fits, value[left] + worth, -1.0)
        pick = gain.argmax(1)
        best = gain[np.arange(capacity + 1), pick]
        better = best > value + 1e-12
        if not better.any():
            break
        value[better], choice[better] = best[better], pick[better]
    out, room = np.zeros(len(sizes), np.int64), capacity
    while choice[room] >= 0:
        out[choice[room]] += 1
        room -= sizes[choice[room]]
    return out


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the cheapest fractional packing, each with its whole number of uses."""
    basis = np.diag(capacity // sizes).astype(float)
    uses = wanted / np.diag(basis)
    for _ in range(60 * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, worth, capacity)
        if worth @ column <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, uses / np.maximum(change, 1e-9), np.inf)
        basis[:, ratio.argmin()] = column
        uses = np.maximum(np.linalg.solve(basis, wanted.astype(float)), 0)
    return [(basis[:, k].astype(np.int64), int(n + 1e-6)) for k, n in enumerate(uses) if int(n + 1e-6)]


def plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[tuple], int]:
    """Runs (length, first rank, how many, first sequence, offset) for a histogram of lengths,
    and the number of sequences."""
    runs = [(capacity, 0, counts[capacity], 0, 0)] if counts.get(capacity) else []
    used = counts.get(capacity, 0)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    todo = {n: [(0, c)] for n, c in counts.items() if n <= small and n < capacity and c}  # length: ranks (first, how many)
    large = np.array(sorted(n for n, c in counts.items() if small < n < capacity and c), np.int64)
    ends = np.cumsum([counts[n] for n in large.tolist()]) if len(large) else np.zeros(0, np.int64)
    begins = ends - np.array([counts[n] for n in large.tolist()], np.int64) if len(large) else ends

    def lengths(a: int, b: int) -> list[tuple[int, int, int]]:
        """The places a to b of the line of large pieces, as (index of length, from, to)."""
        first, last = np.searchsorted(ends, [a, b - 1], "right") if b > a else (0, -1)
        return [(k, max(a, int(begins[k])), min(b, int(ends[k]))) for k in range(first, last + 1)]

    if len(large):
        total = int(ends[-1])
        cuts = sorted({-(-total * g // groups) for g in range(1, groups + 1)})
        tops = np.searchsorted(ends, np.array(cuts) - 1, "right")
        sizes, at = np.unique(large[tops], return_index=True)
        stops = np.array([max(c for c, k in zip(cuts, tops) if large[k] == s) for s in sizes.tolist()])
        next_at = np.concatenate([[0], stops[:-1]])
        for configuration, copies in configurations(sizes, stops - next_at, capacity):
            slots = []
            for g in np.flatnonzero(configuration).tolist()[::-1]:
                for _ in range(configuration[g]):
                    n = min(copies, int(stops[g] - next_at[g]))
                    slots.append([(large[k], a - begins[k], a - next_at[g], b - next_at[g]) for k, a, b in lengths(int(next_at[g]), int(next_at[g]) + n)])
                    next_at[g] += n
            edges = sorted({0, copies, *(int(x) for s in slots for _, _, a, b in s for x in (a, b))})
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for s in slots:
                    for length, rank, c, d in s:
                        if c <= a < d:
                            runs.append((int(length), int(rank + a - c), b - a, used + a, offset))
                            offset += int(length)
                if offset < capacity:
                    rooms.setdefault(capacity - offset, []).append((used + a, b - a))
            used += copies
        for g in range(len(sizes)):
            for k, a, b in lengths(int(next_at[g]), int(stops[g])):
                todo.setdefault(int(large[k]), []).append((a - int(begins[k]), b - a))
    open_rooms = np.zeros(capacity + 1, bool)
    open_rooms[list(rooms)] = True
    for length in sorted(todo, reverse=True):
        for rank, n in todo[length]:
            while n:
                room = length + int(open_rooms[length:].argmax())
                if not open_rooms[room]:
                    fresh = -(-n // (capacity // length))
                    room, rooms[capacity] = capacity, [(used, fresh)]
                    used += fresh
                    open_rooms[capacity] = True
                first, m = rooms[room].pop()
                took = min(n, m)
                runs.append((length, rank, took, first, capacity - room))
                if took < m:
                    rooms[room].append((first + took, m - took))
                open_rooms[room] = bool(rooms[room])
                if room > length:
                    rooms.setdefault(room - length, []).append((first, took))
                    open_rooms[room - length] = True
                rank, n = rank + took, n - took
    return runs, used


def best_plan(counts: dict[int, int], capacity: int) -> list[tuple]:
    """The runs of the plan of fewest sequences."""
    return min((plan(counts, capacity, g, small)[::-1] for g in GROUPS for small in (capacity // 4, capacity // 2)), key=lambda x: (x[0], len(x[1])))[1]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and
    with ``keep_ids`` the bytes of its ids."""
    numbered = stored(pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col))
    of_task = stored(numbered.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = numbered.sparkSession.createDataFrame(best_plan(counts, capacity) if counts else [], "length long, first long, n long, sequence long, offset long")
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = of_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = numbered.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = (F.broadcast(runs) if runs.isEmpty() or runs.count() <= BROADCAST_RUNS else runs).withColumnRenamed("length", "of_length")
    inside = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    out = ranked.join(placed, inside)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: the ids of their pieces joined in order of offset."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(F.col("rows"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.expr("aggregate(rows, 0L, (a, x) -> a + x.length)").alias("length"), joined.alias("ids"))
