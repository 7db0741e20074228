import random

from tidemark.llm import decontam_sa as sa

DOCS, ITEMS = "doc_id long, text string, n_words int", "item_id long, text string, extra string"


def tables():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["É9", "x-y"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n)), "e") for i, n in enumerate([3, 4, 6, 6, 9, 1])]
    items += [(7, items[2][1], "e"), (3, items[3][1], "e"), (8, None, "e"), (9, " .!", "e"), (None, "w1 w2", "e")]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 40))), 0) for i in range(40)]
    docs += [(50, "Intro. " + items[4][1].upper() + "! outro " + items[2][1], 0), (51, None, 0), (52, "", 0), (50, "Intro. " + items[4][1].upper() + "! outro " + items[2][1], 0)]
    return docs, items


def check(spark, docs, items):
    got = sa.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=4)
    got = got.select("doc_id", "n_words", "n_hit", "items", sa.digest("items").alias("digest"), "contaminated").collect()
    want = sa.brute_force([d[:2] for d in docs], [i[:2] for i in items if i[0] is not None], window=4)
    assert len(got) == len(docs)
    for r in got:
        n, hit, named, digest = want[r.doc_id]
        assert (r.n_words, r.n_hit, sorted(r["items"]), r.digest) == (n, hit, named, digest)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = sa.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=4)
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_matches_plain_loops(spark):
    docs, items = tables()
    check(spark, docs, items)


def test_blocks_of_items_are_merged(spark, monkeypatch):
    monkeypatch.setattr(sa, "BLOCK_CHARS", 60)
    docs, items = tables()
    check(spark, docs, items)


def test_longest_match_and_place(spark):
    item = " ".join(f"t{i}" for i in range(30))
    docs = [(1, "a b " + " ".join(f"t{i}" for i in range(5, 25)) + " z", 0), (2, "nothing here", 0)]
    out = {r.doc_id: r for r in sa.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item, "")], ITEMS)).collect()}
    assert (out[1].longest, out[1].longest_at, out[1].n_hit) == (20, 2, 20)
    assert (out[2].longest, out[2].longest_at, out[2].contaminated) == (0, None, False)


def test_empty_tables(spark):
    docs, items = tables()
    none = spark.createDataFrame([], ITEMS)
    assert not sa.contamination(spark.createDataFrame(docs, DOCS), none).where("contaminated").count()
    assert sa.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert sa.decontaminate(spark.createDataFrame(docs, DOCS), none).count() == len(docs)


def test_longest_match_against_plain_loops(spark, monkeypatch):
    """Also over several blocks, and for items and texts that repeat themselves."""
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("abc") for _ in range(n)), "") for i, n in enumerate([9, 14, 30, 3, 60])] + [(5, "a " * 20, ""), (6, "a b " * 9, "")]
    docs = [(i, " ".join(rnd.choice("abcd") for _ in range(60)), 0) for i in range(30)] + [(40, "a " * 33 + "d " + "a b " * 5, 0), (41, items[4][1] + " a", 0)]

    def plain(text, window):
        best, words = (0, 0), text.split()
        for _, t, _ in items:
            w = t.split()
            size = min(window, len(w))
            for s in range(len(w) - size + 1):
                for p in range(len(words) - size + 1):
                    n = 0
                    while p + n < len(words) and s + n < len(w) and words[p + n] == w[s + n]:
                        n += 1
                    best = max(best, (n, -p) if n >= size else best)
        return (best[0], -best[1]) if best[0] else (0, None)

    for chars in (10**6, 40):
        monkeypatch.setattr(sa, "BLOCK_CHARS", chars)
        got = sa.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=5).collect()
        for r in got:
            assert (r.longest, r.longest_at) == plain(dict(d[:2] for d in docs)[r.doc_id], 5)


def test_long_items_and_texts_take_linear_space():
    import tracemalloc

    rnd = random.Random(1)
    words = [f"w{rnd.randrange(5000)}" for _ in range(200_000)]
    text, same = " ".join(words).encode(), b"a " * 200_000
    tracemalloc.start()
    tests = sa.TestWindows([("long", text), ("same", same)], 13)
    found = sa.match_shard([b"x y " + text, same + b"z", text[:100], b"clean words only"], tests)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["longest"] == [200_000, 200_000, len(text[:100].split()) - (text[100:101] != b" "), 0]
    assert found["longest_at"][:2] == [2, 0] and found["items"] == [["long"], ["same"], ["long"], []]
    assert peak < 1_000_000_000


def test_clashing_columns(spark, monkeypatch):
    docs, items = tables()
    names = ["text_hash", "_id", "_text", "longest", "items", "_hash", "_before", "is_last"]
    wide = spark.createDataFrame(docs, DOCS).selectExpr("*", *[f"'{n}' as {n}" for n in names])
    tests = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as doc_id", "2 as text_hash")
    seen = []
    for chars in (10**6, 60):
        monkeypatch.setattr(sa, "BLOCK_CHARS", chars)
        kept = sa.decontaminate(wide, tests, window=4)
        assert kept.columns == wide.columns
        seen.append(sorted((r.doc_id, r.text or "", r.text_hash, r._before) for r in kept.collect()))
        assert sa.contamination(wide, tests, window=4).count() == len(docs)
    assert seen[0] == seen[1] and {r[2:] for r in seen[0]} == {("text_hash", "_before")}


def test_short_rows_share_a_shard(monkeypatch):
    """Items are ranked once for a shard of bytes, not once for each batch of rows."""
    import pyarrow as pa

    monkeypatch.setattr(sa, "SHARD_BYTES", 1000)
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([b"x" * 40] * 10)}) for _ in range(9)]
    sizes = []
    out = list(sa.by_shard("text", lambda b: sizes.append(len(b)) or b)(iter(batches)))
    assert sum(map(len, out)) == 90 and len(sizes) <= 5 and list(sa.by_shard("text", lambda b: b)(iter([]))) == []
