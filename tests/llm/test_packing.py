"""Packing: token ids, pieces, plans of a histogram, and places of actual documents."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [*t.encode(text, add_special_tokens=False).ids, 0]


def place(counts, runs, capacity):
    """Each piece of a histogram put into its place, checked to lie gapless in a sequence."""
    rows = sorted((seq + k, offset, length, rank + k) for length, rank, n, seq, offset in runs for k in range(n))
    assert sorted((length, rank) for _, _, length, rank in rows) == sorted((n, k) for n, c in counts.items() for k in range(c))
    end = {}
    for seq, offset, length, _ in rows:
        assert end.get(seq, 0) == offset
        end[seq] = offset + length
    assert max(end.values(), default=0) <= capacity and sorted(end) == list(range(len(end)))
    return len(end)


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 100])
    counts = {}
    for _ in range(rng.randrange(1, 3000)):
        n = min(capacity, int(rng.expovariate(3 / capacity)) + 1) if seed % 2 else rng.randrange(1, capacity + 1)
        counts[n] = counts.get(n, 0) + 1
    for groups in (1, 3, 8):
        for small in (1, capacity // 8, capacity // 4, capacity // 2, capacity):
            runs, used = packing.plan(counts, capacity, groups, small)
            assert place(counts, runs, capacity) == used
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = place(counts, packing.best_plan(counts, capacity), capacity)
    alone = sum(c for n, c in counts.items() if n > capacity / 2)
    assert best <= packing.plan(counts, capacity, 1, capacity)[1]  # plain best fit
    assert best <= max(least, alone) * 1.03 + 2


def test_configurations_where_best_fit_wastes():
    """Thirds and halves: 6 pieces of 41, 6 of 35 and 6 of 24 fill six sequences of 100."""
    assert packing.plan({41: 600, 35: 600, 24: 600}, 100, 24, 10)[1] == 600
    sizes, wanted = np.array([24, 35, 41]), np.array([600, 600, 600])
    assert sum(n for _, n in packing.configurations(sizes, wanted, 100)) == 600


def test_runs_do_not_grow_with_the_pieces():
    counts = {n: 7 * n % 97 + 1 for n in range(1, 2049)}
    few = len(packing.best_plan(counts, 2048))
    assert len(packing.best_plan({n: 1000 * c for n, c in counts.items()}, 2048)) < 3 * few < packing.BROADCAST_RUNS


def test_ids_are_the_tokenizers():
    texts = ["", " ", "a", "\n\n  Hello,  world!\t\tdon't 12 345 ½", "naïve Straße éàü  ", "日本語 text ", "x y\u0085z \x1c\x1d", "<|endoftext|> said", "  \U0001f600 emoji", "ab1" * 4000, "a" * 30000, " " * 500 + "\n" * 7]
    ids = packing.ids_by(PATH)
    for t in texts:
        assert [*ids(t), 0] == plain_ids(t)


def test_whole_documents(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(150)] + [None, "", "same same"] + ["same same"] * 80
    rows = [(k if k % 50 else None, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string").repartition(5)
    got = packing.pack(docs, PATH, capacity=128, keep_ids=True).toPandas()
    want = []
    for k, t, *_ in rows:
        ids = plain_ids(t or "")
        at, stop = 0, (len(ids) - 1) % 128 + 1
        while at < len(ids):
            want.append((k, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())))
            at, stop = stop, stop + 128
    key = lambda x: tuple((y is None or y != y, 0 if y is None or y != y else int(y)) for y in x)
    assert sorted(map(key, got[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    counts = got.groupby("length").size().to_dict()
    end = {}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert end.get(r.sequence_id, 0) == r.offset
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 128 and len(end) <= packing.plan(counts, 128, 1, 128)[1]
    whole = {r.sequence_id: r for r in packing.sequences(spark.createDataFrame(got)).collect()}
    assert {k: r.length for k, r in whole.items()} == end
    first = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").ids.apply(lambda x: b"".join(map(bytes, x)))
    assert all(bytes(whole[k].ids) == v for k, v in first.items())
    assert packing.pack(docs.where("false"), PATH).count() == 0
