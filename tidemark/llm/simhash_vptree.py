"""Near-duplicate detection: SimHash fingerprints linked through vantage-point trees.

How links are found
-------------------
Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most ``d // 3``
bits of at least one of three blocks of 21 or 22 bits. So one vantage-point tree is kept
per block and searched with radius ``d // 3``:

* a node parts its points by their Hamming distance to a vantage point, taken over one
  range of about seven bits of the block; a bounded sample of fingerprints fixes vantage
  points and radii (they set the balance of the shards, never which links are found);
* each fingerprint lives in one shard of each tree. As a query it follows a branch only
  where the triangle bound allows a partner within the radius. Bounds of one range are
  alternatives, the greatest counts; bounds of different ranges add up, because the bits
  are different ones. That keeps the shards a query visits to a number that grows with
  the logarithm of the number of shards: in all three trees 10 of 48, 23 of 768, 32 of
  3072 and 43 of 12288 for random fingerprints;
* a shard looks its queries' values, up to the radius, up among its residents'. Where more
  than ``FULL`` residents share a value, the other bits are cut into ``d + 1`` parts, of
  which a partner has at least one in common, and the value is looked up together with each
  part. What is left, 22 or 23 of 2^21 of the shard's residents or, where they are many,
  some hundredth of these, is compared over all 64 bits, exactly, in numpy. A shard returns
  a spanning forest of the links it found, not all pairs.

Shards that hold more than ``SHARD_ROWS`` rows are dealt out as a grid of
(resident part, query part) tasks, so that memory stays bounded for any group of
near copies. Exact copies share one fingerprint and are collapsed beforehand.
Connected components then run over distinct fingerprints as alternating large-star
and small-star steps, checkpointed to the shared folder.

Edge cases: a null or wordless text has fingerprint zero and links like any other;
a null doc_id is fingerprinted and linked, but never is the smallest doc_id (a class
of only such rows has a null component); repeated rows appear as often as given, and
rows that share a doc_id but not a text are judged one by one; a text of any length is
hashed whole, in parts of 65,536 shingles; an empty table gives an empty result. Columns
other than doc_id and text are ignored by the searches, whatever their names, and pass
through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, checkpointed, stored, thinned

#: Rows of the sample that fixes the trees' vantage points and radii, at least and by shard.
TREE_SAMPLE, SAMPLE_PER_SHARD = 4096, 16
#: Shards of one tree at least and at most.
MIN_SHARDS, MAX_SHARDS = 16, 16_384
#: Fingerprints beyond which a tree gets more shards, and rows beyond which a shard is split.
SHARD_TARGET, SHARD_ROWS = 500_000, 2_000_000
#: 64-bit words of the wide fingerprint that confirms links by similarity.
WIDE_WORDS = 4
#: Shingles of sets that are small: each of their shingles is a key of its own.
SMALL_SET = 8
#: Pairs of different classes with a run in common that are named; of more, parts of the group
#: of at most so many nodes and shingles are compared in one task.
FEW_PAIRS, PART_NODES, PART_HASHES = 2000, 1024, 1_000_000
#: Nodes that share a run key of which a task takes all; of more none holds more than two parts.
#: Rows of such keys that are broadcast.
GROUP_NODES, BROADCAST_KEYS = 4096, 100_000
#: Width of each tree's block of bits and of the ranges of it that its nodes look at.
BLOCKS, RANGES = (21, 21, 22), ((7, 7, 7), (7, 7, 7), (7, 7, 8))
#: Residents with one value beyond which their other bits are looked up as well.
FULL = 256
#: Pairs that are compared at once.
RUN = 250_000
#: Parts of a shard's residents in each of which a query's nearest partner is named.
PARTNERS = 8


# --- fingerprints -----------------------------------------------------------------


def shingles(text: bytes | None, size: int) -> Iterator[bytes]:
    """Word shingles of a UTF-8 text, A-Z lower-cased, repeats included."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))


def majority(digests: Iterator[bytes], size: int) -> bytes:
    """The bits set in over half of the given hashes of ``size`` bytes; none: all zero."""
    ones, count = np.zeros(8 * size, np.int64), 0
    for part in batched(digests, 65536):
        bits = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), size)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        count += len(part)
    return np.packbits(ones * 2 > count).tobytes()


def simhash(text: bytes | None, size: int) -> int:
    """SimHash of a text's word shingles under XXH64 with seed 42, as a signed long."""
    digest = xxhash.xxh64_digest
    return int.from_bytes(majority((digest(x, 42) for x in shingles(text, size)), 8), "big", signed=True)


def wide_simhash(text: bytes | None, size: int, words: int = WIDE_WORDS) -> bytes:
    """A SimHash of ``64 * words`` bits over the set of shingles, to estimate similarity."""
    seeds, digest = range(1, 1 + words // 2), xxhash.xxh3_128_digest
    return majority((b"".join([digest(x, s) for s in seeds]) for x in set(shingles(text, size))), 8 * words)


def hashed_set(text: bytes | None, size: int) -> np.ndarray:
    """The XXH3 hashes of a text's set of shingles in ascending order."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in shingles(text, size)], np.uint64))


def with_fingerprints(docs: DataFrame, shingle: int, index_shingle: int | None = None, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; with ``index_shingle`` that is the size of fp's
    shingles, ``wide`` is a wide SimHash of shingles of ``shingle`` words, and of the set of
    these there are the ``size``, a hash and the run keys for that similarity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    length, tokens = run_size(similarity)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        out = [batch.column("doc_id"), batch.column("text_hash"), pa.array([simhash(x, index_shingle or shingle) for x in texts], pa.int64())]
        if index_shingle:
            sets = [hashed_set(x, shingle) for x in texts]
            out.append(pa.array([wide_simhash(x, shingle) for x in texts], pa.binary()))
            out.append(pa.array([len(x) for x in sets], pa.int32()))
            out.append(pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], pa.uint64()).view(pa.int64()))
            out.append(pa.array([run_keys(x, length, tokens) for x in sets], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "fp", "wide", "size", "set_hash", "keys"][: len(out)])

    schema = f"doc_id {kind}, text_hash bigint, fp bigint" + (", wide binary, size int, set_hash bigint, keys array<bigint>" if index_shingle else "")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(by_batch(one), schema)


# --- vantage-point trees ----------------------------------------------------------


def block(fp: np.ndarray, tree: int) -> np.ndarray:
    """The bits of a tree's block."""
    return ((fp.view(np.uint64) >> np.uint64(sum(BLOCKS[:tree]))) & np.uint64((1 << BLOCKS[tree]) - 1)).astype(np.uint32)


def rest(fp: np.ndarray, tree: int) -> np.ndarray:
    """The bits outside a tree's block, put together."""
    low, fp = np.uint64(sum(BLOCKS[:tree])), fp.view(np.uint64)
    high = fp >> (low + np.uint64(BLOCKS[tree])) if tree + 1 < len(BLOCKS) else np.zeros_like(fp)
    return (high << low) | (fp & ((np.uint64(1) << low) - np.uint64(1)))


def in_range(values: np.ndarray, tree: int, part: int) -> np.ndarray:
    return (values >> np.uint32(sum(RANGES[tree][:part]))) & np.uint32((1 << RANGES[tree][part]) - 1)


def grow_tree(sample: np.ndarray, tree: int, shards: int) -> list:
    """A tree as nested [range, vantage, radius, inner, outer], or a leaf as an int.

    Levels take the ranges in turn. A node's vantage point and radius are those, of a few, for
    which the fewest points lie beside the boundary for what the split tells. Branches get leaves
    by their share of the sample until there are ``shards`` or none can be divided.
    """
    count = 0

    def grow(points: np.ndarray, want: int, level: int):
        nonlocal count
        found = None
        if want > 1 and len(points) > 1:
            part = level % len(RANGES[tree])
            values = in_range(points, tree, part)
            for vantage in values[:: max(1, len(values) // 16)][:16]:
                away = np.bitwise_count(values ^ vantage)
                for radius in {int(np.median(away)), int(np.median(away)) - 1}:
                    share = float((away <= radius).mean())
                    if 0 < share < 1:
                        tells = -share * np.log2(share) - (1 - share) * np.log2(1 - share)
                        beside = float(((away == radius) | (away == radius + 1)).mean())
                        cost = (beside if tells > 0.6 else 2.0) / tells
                        if found is None or cost < found[0]:
                            found = cost, int(vantage), radius, away <= radius
            if found is None and level < 8 * len(RANGES[tree]):  # all alike in this range, perhaps not in the next
                return grow(points, want, level + 1)
        if found is None:
            count += 1
            return count - 1
        _, vantage, radius, inner = found
        some = min(want - 1, max(1, round(want * inner.mean())))
        return [part, vantage, radius, grow(points[inner], some, level + 1), grow(points[~inner], want - some, level + 1)]

    return grow(sample, shards, 0)


def route(root, points: np.ndarray, tree: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``points`` and the leaves they reach: with slack 0 each one's home,
    else every leaf that the ball of that radius overlaps."""
    at, leaf = [], []

    def walk(node, rows: np.ndarray, bounds: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            at.append(rows)
            leaf.append(np.full(len(rows), node, np.int32))
            return
        part, vantage, radius, inner, outer = node
        away = np.bitwise_count(in_range(points[rows], tree, part) ^ np.uint32(vantage)).astype(np.int8)
        for branch, beyond in ((inner, away - radius), (outer, radius + 1 - away)):
            least = bounds.copy()
            np.maximum(least[:, part], beyond, out=least[:, part])
            near = least.sum(axis=1) <= slack
            walk(branch, rows[near], least[near])

    walk(root, np.arange(len(points)), np.zeros((len(points), len(RANGES[tree])), np.int8))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(at or empty), np.concatenate(leaf or empty)


def grow_forest(nodes: DataFrame, total: int) -> list:
    """One tree per block, from a bounded sample in the order of a hash."""
    shards = min(MAX_SHARDS, max(MIN_SHARDS, -(-total // SHARD_TARGET)))
    want = max(TREE_SAMPLE, SAMPLE_PER_SHARD * shards)
    sample = thinned(nodes.select("fp"), ["fp"], want, F.lit(total)).orderBy(F.xxhash64("fp", F.lit(7)), "fp").limit(want).collect()
    fps = np.array([r.fp for r in sample], np.int64)
    return [grow_tree(block(fps, t), t, shards) for t in range(len(BLOCKS))]


# --- links inside a shard ---------------------------------------------------------


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the sets of each a[i] and b[i]; label holds each element's smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := label[label], label):
            label[:] = shorter


def pairs_of(order: np.ndarray, low: np.ndarray, size: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The residents order[low : low + size] of each query, in runs of about RUN pairs, one query at least."""
    ends, at = np.cumsum(size), 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
        n = size[at:stop]
        yield order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:stop], n)], np.repeat(q[at:stop], n)
        at = stop


def candidates(tree: int, home: np.ndarray, asks: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q): residents and queries whose values in the tree's block are within the radius;
    of values with more than FULL residents those that share a part of the other bits."""
    values, asked = block(home, tree), block(asks, tree)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    present = np.zeros(1 << BLOCKS[tree], bool)
    present[values] = True
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    crowd = np.repeat(np.diff(np.append(starts, len(ordered))), np.diff(np.append(starts, len(ordered)))) > FULL
    crowded = order[crowd]  # residents whose value more than FULL share
    cuts = [round(i * (64 - BLOCKS[tree]) / (distance + 1)) for i in range(distance + 2)]
    others = []

    def with_part(value: np.ndarray, bits: np.ndarray, i: int) -> np.ndarray:
        width = np.uint64(cuts[i + 1] - cuts[i])
        return (value.astype(np.uint64) << width) | ((bits >> np.uint64(cuts[i])) & ((np.uint64(1) << width) - np.uint64(1)))

    if len(crowded):
        far = rest(asks, tree)
        for i in range(distance + 1):
            key = with_part(values[crowded], rest(home[crowded], tree), i)
            by = np.argsort(key, kind="stable")
            others.append((crowded[by], key[by]))
    for k in range(distance // len(BLOCKS) + 1):
        for bits in combinations(range(BLOCKS[tree]), k):
            near = asked ^ np.uint32(sum(1 << b for b in bits))
            q = np.flatnonzero(present[near])
            low, high = (np.searchsorted(ordered, near[q], side) for side in ("left", "right"))
            many = high - low > FULL
            if many.any():
                ask = q[many]
                found = []
                for i, (by, key) in enumerate(others):
                    want = with_part(near[ask], far[ask], i)
                    begin, end = (np.searchsorted(key, want, side) for side in ("left", "right"))
                    found.append((by, begin, end - begin))
                # In a group of near copies most residents share most parts: no use in them.
                better = sum(n for _, _, n in found) < (high - low)[many]
                for by, begin, n in found:
                    yield from pairs_of(by, begin[better], n[better], ask[better])
                many[np.flatnonzero(many)[~better]] = False
            yield from pairs_of(order, low[~many], (high - low)[~many], q[~many])


def shard_links(tree: int, home: np.ndarray, asks: np.ndarray, distance: int, wide: tuple | None = None, wide_distance: int = 0, same: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the concatenation of home and asks after linking every pair within the
    distance (and, given wide fingerprints, within their distance too); and, given those and
    the names of both sides, for each query and each of PARTNERS parts of the residents the
    one of another name with the nearest wide fingerprint, -1 for none."""
    label = np.arange(len(home) + len(asks))
    nearest, least = np.full(len(asks) * PARTNERS, -1), np.full(len(asks) * PARTNERS, 1 << 30)
    part = (same[0].view(np.uint64) >> np.uint64(7)) % np.uint64(PARTNERS) if same else None
    for p, q in candidates(tree, home, asks, distance):
        close = np.bitwise_count(home[p].view(np.uint64) ^ asks[q].view(np.uint64)) <= distance
        q, p = q[close], p[close]
        if wide is not None and len(q):
            differ = np.bitwise_count(wide[0][p] ^ wide[1][q]).sum(axis=1, dtype=np.int32)
            near = differ <= wide_distance
            q, p, differ = q[near], p[near], differ[near]
            slot = q * PARTNERS + part[p].astype(np.int64)
            better = np.flatnonzero((same[0][p] != same[1][q]) & (differ < least[slot]))
            better = better[np.argsort(-differ[better], kind="stable")]  # in one slot the nearest is written last
            nearest[slot[better]], least[slot[better]] = p[better], differ[better]
        merge_labels(label, p, q + len(home))
    return label, nearest


def links(nodes: DataFrame, distance: int, wide_distance: int | None = None) -> DataFrame:
    """(a, b): a forest of links whose components are those of all links between nodes.

    nodes: node (long, unique), fp (long) and, with ``wide_distance``, wide (binary). With
    wide fingerprints each node is linked to its nearest partners in each shard as well.
    """
    total = nodes.count()
    forest, slack = grow_forest(nodes, total), distance // len(BLOCKS)
    columns = ["node", "fp"] + (["wide"] if wide_distance is not None else [])
    nodes = nodes.select(*columns)

    def reached(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy()
        found = [(t << 16) | route(forest[t], block(fp, t), t, slack)[1].astype(np.int64) for t in range(len(BLOCKS))]
        shard, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(n)], ["shard", "n"])

    # One row per shard: at most three times MAX_SHARDS of them. Its queries include its residents.
    held = nodes.mapInArrow(by_batch(reached), "shard bigint, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    split = np.ones((len(BLOCKS), MAX_SHARDS), np.int64)
    for r in held:
        split[r.shard >> 16, r.shard & 0xFFFF] = -(-r.n // SHARD_ROWS)

    def deal(batch: pa.RecordBatch) -> pa.Table:
        fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
        own = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        tables = []
        for t in range(len(BLOCKS)):
            for asks in (False, True):
                rows, leaf = route(forest[t], block(fp, t), t, slack if asks else 0)
                n = split[t, leaf]
                rows, leaf, each = np.repeat(rows, n), np.repeat(leaf, n), np.repeat(n, n)
                other = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                mine = (own[rows] % np.maximum(each, 1).astype(np.uint64)).astype(np.int64)
                res, ask = (other, mine) if asks else (mine, other)
                cell = (((np.int64(t) << 16) | leaf.astype(np.int64)) << 40) | (res << 20) | ask
                got = [pa.array(cell), pa.array(np.full(len(rows), asks)), *(batch.column(c).take(pa.array(rows)) for c in columns)]
                tables.append(pa.RecordBatch.from_arrays(got, ["cell", "asks", *columns]))
        return pa.Table.from_batches(tables)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        node, fp = table.column("node").to_numpy(), table.column("fp").to_numpy()
        tree = int(table.column("cell")[0].as_py() >> 56)
        wide = None
        if wide_distance is not None and len(node):
            packed = table.column("wide").chunk(0)  # no nulls, all of one size
            first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
            bits = np.frombuffer(packed.buffers()[2], np.uint64, len(node) * WIDE_WORDS, int(first)).reshape(len(node), -1)
            wide = (bits[~asks], bits[asks])
        label, nearest = shard_links(tree, fp[~asks], fp[asks], distance, wide, wide_distance or 0, (node[~asks], node[asks]))
        member = np.concatenate([node[~asks], node[asks]])
        found = np.flatnonzero(nearest >= 0)
        a, b = np.concatenate([member, node[asks][found // PARTNERS]]), np.concatenate([member[label], node[~asks][nearest[found]]])
        # A node may stand here twice, as resident and as query: it links to itself.
        return pa.table({"a": a[a != b], "b": b[a != b]})

    kinds = "node bigint, fp bigint" + (", wide binary" if wide_distance is not None else "")
    dealt = nodes.mapInArrow(by_batch(deal), f"cell bigint, asks boolean, {kinds}")
    return dealt.groupBy("cell").applyInArrow(compare, "a bigint, b bigint")


# --- links between classes --------------------------------------------------------


def run_size(similarity: float) -> tuple[int, int]:
    """The length of a run and the number of a set's least hashes in which runs are looked for.

    Hashes order the union of two sets at random, so each place of it is shared with a chance
    of the similarity. Shared places in a row lie next to each other in both sets as well. The
    number makes the chance that a pair at the limit has no such run less than 1e-9. Sets no
    larger than the number are looked at whole: what is not shared parts what is shared into
    so few pieces that one is as long as a run, but for unions of ``SMALL_SET`` at most.
    """
    length = 3 if similarity >= 0.75 else 2 if similarity >= 0.6 else 1
    state, tokens = [1.0] + [0.0] * (length - 1), 0  # chances of no run yet, by the length of the last
    while sum(state) > 1e-9:
        state, tokens = [sum(state) * (1 - similarity), *(x * similarity for x in state[:-1])], tokens + 1
    return length, tokens


def run_keys(hashes: np.ndarray, length: int, tokens: int) -> np.ndarray:
    """Hashes of the runs among a set's least hashes; of a small set its hashes as well."""
    least = hashes[:tokens]
    keys = np.zeros(max(0, len(least) - length + 1), np.uint64)
    for k in range(length):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + least[k : k + len(keys)]
    return (np.concatenate([keys, hashes]) if len(hashes) <= SMALL_SET else keys).view(np.int64)


def class_pairs(node: np.ndarray, size: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of nodes of different roots whose sizes allow the similarity."""
    order = np.argsort(size, kind="stable")
    node, size, root = node[order], size[order], root[order]
    names, n = np.unique(root, return_counts=True)
    most = root == names[n.argmax()]  # pairs within the largest class are not even listed
    x, xs, xr = node[~most], size[~most], root[~most]
    for y, ys, yr, once in ((node[most], size[most], root[most], False), (x, xs, xr, True)):
        low = np.searchsorted(ys, xs * similarity - 1e-6, "left")
        n = np.searchsorted(ys * similarity, xs + 1e-6, "right") - low
        ends = np.cumsum(n)
        at = 0
        while at < len(x):  # in runs of about two million pairs
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
            m = n[at:stop]
            i = np.repeat(np.arange(at, stop), m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[at:stop], m)
            apart = xr[i] < yr[j] if once else xr[i] != yr[j]
            a, b = x[i[apart]], y[j[apart]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            at = stop


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, written: their sets of shingles as hashes."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [hashed_set(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    named = checkpointed(nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")).join(wanted, "node"))
    # One document stands for each node: its copies, however many, are not brought together.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "text").dropDuplicates(["node"])
    return stored(texts.mapInArrow(by_batch(sets), "node bigint, shingles array<bigint>"))


def verified(edges: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges whose nodes' texts have that Jaccard similarity of shingle sets, exactly."""
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    known = shingle_sets(linked, nodes, docs, shingle)
    side = lambda c: known.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = edges.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(shared >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - shared)).select("a", "b")


def cells(key: int, node: np.ndarray, size: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b, cell): the node and root of each member of a large group, once for each pair of parts
    of the group that its part belongs to."""
    n = int(max(1, -(-len(node) // PART_NODES), -(-int(size.sum()) // PART_HASHES)))
    part = np.empty(len(node), np.int64)
    part[np.argsort(size, kind="stable")] = np.arange(len(node)) % n
    for i in range(n):
        for j in range(i, n):
            chosen = (part == i) | (part == j)
            cell = xxhash.xxh64_intdigest(f"{key} {i} {j}") - (1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(node[chosen]), pa.array(root[chosen]), pa.array(np.full(chosen.sum(), cell, np.int64))], ["a", "b", "cell"])


def cell_links(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): a forest whose components are those of all links between different classes of a
    cell, from the exact numbers of shingles that its members share."""
    table = table.combine_chunks()
    node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
    shingles = table.column("shingles").combine_chunks()
    size = np.diff(shingles.offsets.to_numpy()).astype(np.int64)
    _, hash_of, count = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), size)
    shared = count[hash_of] > 1  # what one member has alone is shared with none
    row, column = row[shared], np.unique(hash_of[shared], return_inverse=True)[1]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((len(node), len(node)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 2048):
        here = slice(*np.searchsorted(column, (at, at + 2048)))
        block = np.zeros((len(node), 2048), np.float32)
        block[row[here], column[here] - at] = 1
        common += block @ block.T
    close = (common >= similarity * (size[:, None] + size[None, :] - common)) & (root[:, None] != root[None, :])
    label = np.arange(len(node))
    merge_labels(label, *np.nonzero(close))
    linked = np.flatnonzero(label != np.arange(len(node)))
    return pa.table({"a": node[linked], "b": node[label[linked]]})


def links_between(nodes: DataFrame, docs: DataFrame, root: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of all pairs of nodes of different classes that
    have the similarity, exactly, and share a run key.

    nodes: node, first, size, keys; root: (node, root), of other nodes the node. Up to
    ``FEW_PAIRS`` pairs of different classes that share a key are named and joined with their
    sets of shingles; of more the members are sent to tasks with their sets, which compare all
    of a bounded part of the group with another and return only what links. Keys are counted
    first: groups of more than ``GROUP_NODES`` are dealt to parts wherever their members lie,
    and pairs of parts are joined with them, so that no task sees such a group whole.
    """
    named = nodes.select("node", "size", "keys").join(root, "node", "left")
    dealt = named.select(F.explode("keys").alias("key"), "node", "size", F.coalesce("root", "node").alias("root"))
    hot = hot_keys(dealt)
    n_hot = hot.count()
    known = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    members = stored(dealt.join(known, "key").where("chosen").select("key", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int").alias("part"), "node", "root")) if n_hot else None
    dealt = dealt.join(known.select("key"), "key", "left_anti") if n_hot else dealt
    dealt = dealt.repartition("key").sortWithinPartitions("key")

    def groups(parts: list) -> Iterator[pa.RecordBatch]:
        key, node, size, root = (np.concatenate(x) for x in zip(*parts))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stops = np.append(starts[1:], len(key))
        several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        for a, b in zip(starts[several].tolist(), stops[several].tolist()):
            if (b - a) ** 2 > 2 * FEW_PAIRS and (b - a) ** 2 - (np.unique(root[a:b], return_counts=True)[1] ** 2).sum() > 2 * FEW_PAIRS:
                yield from cells(key[a], node[a:b], size[a:b], root[a:b])
            else:
                for pairs in class_pairs(node[a:b], size[a:b], root[a:b], similarity):
                    yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(pairs.num_rows, pa.int64())], ["a", "b", "cell"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # what may belong to the key that the next batch begins with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", "node", "size", "root")]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and (last or held[-1][0][-1] != rows[0][0]):
                yield from groups([*held, [c[:last] for c in rows]])
                held = []
            elif last:
                yield from groups([[c[:last] for c in rows]])
            held.append([c[last:] for c in rows])
        if held:
            yield from groups(held)

    found = stored(dealt.mapInArrow(scan, "a bigint, b bigint, cell bigint"))
    few = verified(found.where("cell is null").select("a", "b").distinct(), nodes, docs, shingle, similarity)
    in_cells = found.where("cell is not null").select("cell", F.col("a").alias("node"), F.col("b").alias("root"))
    wanted = in_cells.select("node")
    wanted = wanted.union(members.select("node")) if n_hot else wanted
    sets = shingle_sets(wanted.distinct(), nodes, docs, shingle)
    out = few.union(in_cells.join(sets, "node").groupBy("cell").applyInArrow(lambda t: cell_links(t, similarity), "a bigint, b bigint"))
    if not n_hot:
        return out
    packed = stored(members.join(sets, "node").groupBy("key", "part").agg(F.collect_list(F.struct("node", "root", "shingles")).alias("members")))
    dealt = part_pairs(hot.where("chosen")).select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part")).join(packed, ["key", "part"])
    return out.union(dealt.groupBy("key", "i", "j").applyInArrow(lambda t: packed_links(t, similarity), "a bigint, b bigint"))


def hot_keys(dealt: DataFrame) -> DataFrame:
    """(key, parts, chosen) of the keys that more than ``GROUP_NODES`` nodes of several classes share;
    of keys that the same nodes share one is chosen."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), (F.min("root") < F.max("root")).alias("several"), *marks)
    counts = checkpointed(counts.where(F.col("several") & (F.col("n") > GROUP_NODES)).drop("several"))
    parts = F.greatest(F.ceil(F.col("n") / PART_NODES), F.ceil(F.col("hashes") / PART_HASHES)).cast("int").alias("parts")
    least = counts.groupBy("n", "mark1", "mark2").agg(F.min("key").alias("chosen"))
    return checkpointed(counts.join(least, ["n", "mark1", "mark2"]).select("key", parts, (F.col("key") == F.col("chosen")).alias("chosen")))


def part_pairs(hot: DataFrame) -> DataFrame:
    """(key, i, j), i up to j, of the pairs of parts of each key; no task names more than those of
    the parts i that it is dealt."""
    first = hot.select("key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).repartition("key", "i")
    return first.select("key", "i", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)).alias("j"))


def packed_links(table: pa.Table, similarity: float) -> pa.Table:
    """cell_links of the members of a part, or of two."""
    members = pa.concat_arrays([x.flatten() for x in table.column("members").chunks])
    return cell_links(pa.table(members.flatten(), ["node", "root", "shingles"]), similarity)


# --- components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge; root is the component's smallest node.

    Alternating large-star and small-star steps. Minima are pre-aggregated before each
    shuffle, and a node's neighbours are joined to its minimum, never gathered.
    """
    now = checkpointed(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    size = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        # At the fixed point each node has one edge, to its root, and no root has one.
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == size:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        size = state


def rooted(nodes: DataFrame, key: list[str], edges: DataFrame) -> DataFrame:
    """(key, first, root): the nodes with the root of their component."""
    root = components(edges)
    return checkpointed(nodes.join(root, "node", "left").select(*key, "first", F.coalesce("root", "node").alias("root")))


def classes(rows: DataFrame, nodes: DataFrame, key: list[str], edges: DataFrame) -> DataFrame:
    """rows with component_id, the smallest doc_id that links reach from each row's node."""
    named = rooted(nodes, key, edges)
    least = named.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = named.join(least, "root").select(*[F.col(k).alias(f"_{k}") for k in key], "component_id")
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    return rows.join(named, same).drop(*[f"_{k}" for k in key])


def first_row() -> Column:
    """The least (doc_id, text_hash) of a group, rows without a doc_id after all others."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row: documents whose SimHash
    fingerprints differ in at most ``distance`` bits are linked."""
    rows = checkpointed(with_fingerprints(docs, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.struct(F.min("doc_id").alias("doc_id")).alias("first")).withColumn("node", F.col("fp")))
    out = classes(rows, nodes, ["fp"], links(nodes, distance))
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def near_duplicates(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, edges): the rows with their node, that is their set of shingles; one row per
    node; and links between nodes whose components are those of all pairs of the similarity.

    First candidates differ in at most 5 bits of a 64-bit SimHash of word pairs, which
    changes less under edits than one of longer shingles, and a 256-bit SimHash of the
    shingles proper puts their similarity near the limit or above. Of these a shard keeps a
    forest and each document's nearest partners, whose similarity is then computed exactly.
    Then all pairs that lie in different classes yet share a run of their sets' least hashes,
    as all but 1e-9 of the pairs at the limit do whatever their SimHashes, have their
    similarity computed exactly as well.
    """
    cosine = 2 * similarity / (1 + similarity)  # of two sets of one size
    limit = round(64 * WIDE_WORDS * float(np.arccos(cosine)) / np.pi) + 12  # two standard errors
    rows = with_fingerprints(docs, shingle, index_shingle=2, similarity=similarity)
    rows = stored(rows.withColumn("node", F.xxhash64("fp", "wide", "set_hash")))
    same = [F.first(c).alias(c) for c in ("size", "keys")]
    nodes = stored(rows.groupBy("node", "fp", "wide").agg(first_row().alias("first"), *same))
    near = checkpointed(verified(links(nodes, 5, limit), nodes, docs, shingle, similarity))
    others = links_between(nodes, docs, components(near), shingle, similarity)
    return rows, nodes, near.union(others)


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: classes of documents whose shingle sets have a
    Jaccard similarity of ``similarity`` or more."""
    rows, nodes, edges = near_duplicates(docs, shingle, similarity)
    return classes(rows, nodes, ["node"], edges).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id, of several such that of
    the least hash of its text. A row without a doc_id stays only where its class has none other."""
    _, nodes, edges = near_duplicates(docs, shingle, similarity)
    stay = rooted(nodes, [], edges).groupBy("root").agg(F.min("first").alias("_first")).select(F.col("_first.doc_id").alias("_stay_id"), F.col("_first.text_hash").alias("_stay_hash"))
    own = [F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = rows.join(stay, F.col("_id").eqNullSafe(F.col("_stay_id")) & (F.col("_hash") == F.col("_stay_hash")), "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def brute_force(rows: list[tuple], shingle: int = 4, distance: int = 4) -> pd.DataFrame:
    """The same classes from all pairs, for tests on a few rows of (doc_id, text)."""
    fps = np.array([simhash(None if t is None else t.encode(), shingle) for _, t in rows], np.int64)
    label = np.arange(len(rows))
    a, b = np.nonzero(np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= distance)
    merge_labels(label, a, b)
    ids = pd.Series([i for i, _ in rows])
    return pd.DataFrame({"doc_id": ids, "fingerprint": [f"{x & (2**64 - 1):016x}" for x in fps.tolist()], "component_id": ids.groupby(label).transform("min")})
