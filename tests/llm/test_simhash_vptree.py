import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import simhash_vptree as sv

SCHEMA = "doc_id long, text string, extra int"


def near_copies(seed, groups, copies, words):
    rnd = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(500)}" for _ in range(words)]
        for _ in range(copies):
            x = list(base)
            for _ in range(rnd.randrange(3)):
                x[rnd.randrange(words)] = "Édit"
            out.append(" ".join(x))
    return out


def fixture_rows():
    texts = near_copies(3, 12, 8, 120) + ["", None, "  \n", "one", "ONE", "one two three four", "a b c"] + near_copies(4, 60, 1, 30)
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return rows


def test_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sv, "SHARD_TARGET", 25)
    monkeypatch.setattr(sv, "SHARD_ROWS", 40)
    monkeypatch.setattr(sv, "MIN_SHARDS", 1)
    monkeypatch.setattr(sv, "FULL", 2)
    rows = fixture_rows()
    got = sv.simhash_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint", "component_id").toPandas()
    want = sv.brute_force([r[:2] for r in rows])
    merged = got.merge(want, on="doc_id", suffixes=("", "_want"))
    assert len(got) == len(rows) == len(merged)
    assert (merged.fingerprint == merged.fingerprint_want).all()
    assert (merged.component_id == merged.component_id_want).all()
    assert merged.component_id.nunique() < len(rows) - 30


def test_fingerprint_uses_sparks_xxhash64(spark):
    row = spark.createDataFrame([("only three words",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert sv.simhash(b"Only\tthree  WORDS", 4) == row.h
    assert sv.simhash(None, 4) == sv.simhash(b" \n", 4) == 0


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "x y z", 0), (5, "x y z", 0), (None, "x y z", 0), (2, None, 0), (None, "other words here", 0)]
    got = {(r.doc_id, r.component_id) for r in sv.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 5), (None, 5), (2, 2), (None, None)}
    assert sv.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_by_similarity(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(3000)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"  # 5 of 396 shingles
    other = [f"w{rnd.randrange(3000)}" for _ in range(400)]
    half = base[:200] + other[200:]
    rows = [(4, " ".join(base), 1), (3, " ".join(near), 1), (7, " ".join(other), 1), (8, " ".join(half), 1), (9, " ".join(base), 1), (None, "z", 1)]
    got = sv.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 3, 7, 8]


@pytest.mark.parametrize("slack", [0, 1, 2])
def test_routes_reach_every_partner(slack):
    rng = np.random.default_rng(0)
    points = rng.integers(0, 1 << 21, 1500).astype(np.uint32)
    points = np.concatenate([points, points[:700] ^ np.uint32(1 << 5), points[:700] ^ np.uint32(3 << 12)])
    tree = sv.grow_tree(points[:900], 0, 64)
    home = np.zeros(len(points), int)
    at, leaf = sv.route(tree, points, 0, 0)
    assert sorted(at) == list(range(len(points)))
    home[at] = leaf
    at, leaf = sv.route(tree, points, 0, slack)
    reach = set(zip(at.tolist(), leaf.tolist()))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= slack)
    assert len(a) > len(points) * slack // 2 and all((x, home[y]) in reach for x, y in zip(a.tolist(), b.tolist()))


def test_visits_grow_with_the_logarithm_of_the_shards():
    rng = np.random.default_rng(1)
    sample, asks = rng.integers(0, 1 << 21, 16384).astype(np.uint32), rng.integers(0, 1 << 21, 1000).astype(np.uint32)
    visits = {n: len(sv.route(sv.grow_tree(sample, 0, n), asks, 0, 1)[0]) / len(asks) for n in (16, 256, 1024)}
    assert visits[16] < 4 and visits[256] < 9 and visits[1024] < 13


@pytest.mark.parametrize("distance", [0, 2, 4, 5])
def test_candidates_hold_every_pair(distance, monkeypatch):
    """In shards where many fingerprints share a block's value, and where few do."""
    monkeypatch.setattr(sv, "FULL", 3)
    monkeypatch.setattr(sv, "RUN", 500)
    rng = np.random.default_rng(distance)
    fps = rng.integers(-(2**63), 2**63 - 1, 200)
    flips = lambda n: np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, distance + 3), replace=False)) for _ in range(n)], np.int64)
    one_block = (fps & ~np.int64((1 << 21) - 1)) | np.int64(77)  # equal in the first tree's block
    fps = np.concatenate([fps, one_block, np.tile(fps[:40], 5) ^ flips(200), np.tile(one_block[:3], 60) ^ flips(180)])
    found, compared = set(), 0
    for tree in range(3):
        for p, q in sv.candidates(tree, fps, fps, distance):
            compared += len(p)
            close = np.bitwise_count(fps[p].view(np.uint64) ^ fps[q].view(np.uint64)) <= distance
            found |= set(zip(p[close].tolist(), q[close].tolist()))
    a, b = np.nonzero(np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= distance)
    assert found == set(zip(a.tolist(), b.tolist())) and compared < len(fps) ** 2


def test_no_text_is_lost_where_ids_repeat(spark):
    rnd = random.Random(2)
    a, b, c, d = (" ".join(f"w{rnd.randrange(3000)}" for _ in range(300)) for _ in range(4))
    rows = [(1, a, 0), (1, b, 0), (2, b + " more", 0), (3, a, 0), (3, a, 0), (None, c, 0), (None, c, 0), (None, d, 0), (9, d, 0)]
    got = sv.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c), (9, d)])


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(150_000))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, "short text", "c"), (4, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for name in ("node", "component_id", "text_hash", "_id", "_first", "wide", "root"):
        docs = docs.withColumn(name, F.col("fp"))
    got = sv.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.node) for r in got.select("doc_id", "node").collect()) == [(1, "a"), (3, "c"), (4, "d")]
    ids = {r.doc_id: r.component_id for r in sv.simhash_components(docs).collect()}
    want = sv.brute_force([r[:2] for r in rows])
    assert ids == dict(zip(want.doc_id, want.component_id))


def similar_classes(rows, similarity=0.8):
    """doc_id -> smallest doc_id of its class, from the exact similarity of all pairs."""
    sets = [set(sv.shingles(t.encode(), 5)) for _, t, _ in rows]
    alike = lambda a, b: not (a or b) or len(a & b) >= similarity * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    label = np.arange(len(rows))
    sv.merge_labels(label, *np.array(pairs, int).reshape(-1, 2).T)
    least = {}
    for (doc, _, _), k in zip(rows, label.tolist()):
        least[k] = min(doc, least.get(k, doc))
    return {r[0]: least[k] for r, k in zip(rows, label.tolist())}


def found_classes(spark, rows):
    return {r.doc_id: r.component_id for r in sv.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_that_only_their_original_links(spark):
    """Each copy is near to the original, and hardly any to another copy."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = [(1000, " ".join(base), 0)]
    for i in range(250):
        x = list(base)
        for at in rnd.sample(range(5, 195), 3):
            x[at] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(x), 0))
    want = similar_classes(rows)
    assert len(set(want.values())) == 1
    assert found_classes(spark, rows) == want


def test_contiguous_changes(spark):
    """Pairs at a similarity of 0.80 to 0.85 by a passage appended or replaced."""
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = []
    for k in range(300):
        base = [word() for _ in range(200)]
        n = rnd.randrange(36, 49) if k % 2 else rnd.randrange(12, 18)
        at = rnd.randrange(5, 175)
        other = base + [word() for _ in range(n)] if k % 2 else base[:at] + [word() for _ in range(n)] + base[at + n :]
        rows += [(2 * k, " ".join(base), 0), (2 * k + 1, " ".join(other), 0)]
    rows += [(1000 + k, " ".join(f"{k}s{x}" for x in range(k % 12)), 0) for k in range(24)]
    rows += [(2000 + k, " ".join(f"{k}s{x}" for x in range(k % 12 + 1)), 0) for k in range(24)]
    want = similar_classes(rows)
    assert sum(i != c for i, c in want.items() if i < 600) == 300
    assert found_classes(spark, rows) == want


@pytest.mark.parametrize("group_nodes", [4096, 40])
def test_large_groups_are_compared_in_parts(spark, monkeypatch, group_nodes):
    """More pairs of one run than are named, over parts of a few nodes, of groups that a task
    takes whole and of groups that none does."""
    monkeypatch.setattr(sv, "GROUP_NODES", group_nodes)
    monkeypatch.setattr(sv, "FEW_PAIRS", 20)
    monkeypatch.setattr(sv, "PART_NODES", 25)
    rnd = random.Random(7)
    rows = []
    for g in range(2):
        base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for i in range(90):
            x = list(base)
            for at in rnd.sample(range(120), rnd.randrange(1, 9)):
                x[at] = f"new{rnd.randrange(10**6)}"
            rows.append((g * 1000 + i, " ".join(x), 0))
    want = similar_classes(rows)
    assert 2 < len(set(want.values())) < len(rows)
    assert found_classes(spark, rows) == want


def test_a_hot_key_is_dealt_in_bounded_parts(spark):
    """A key of 100,000 nodes, each a class of its own, beside one with the same nodes."""
    rows = spark.range(100_000).select(F.col("id").alias("node"), F.lit(300).cast("long").alias("size"), F.col("id").alias("root"))
    dealt = rows.select(F.explode(F.array(*[F.lit(k).cast("long") for k in (7, 9)])).alias("key"), "node", "size", "root").union(rows.limit(5000).select(F.lit(11).cast("long"), "node", "size", "root"))
    hot = {r.key: r for r in sv.hot_keys(dealt).collect()}
    assert {k: (r.parts, r.chosen) for k, r in hot.items()} == {7: (98, True), 9: (98, False), 11: (5, True)}
    pairs = sv.part_pairs(sv.hot_keys(dealt).where("chosen"))
    assert pairs.count() == 98 * 99 // 2 + 5 * 6 // 2
    assert max(r["count"] for r in pairs.groupBy("key", "i").count().collect()) <= 98
