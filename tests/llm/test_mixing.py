import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, epoch string"


def docs_of(sizes):
    """sizes: (lang, source) -> list of word counts."""
    rows, i = [], 0
    for (lang, source), counts in sizes.items():
        for n in counts:
            rows.append((i, "w " * n, lang, source, "clash"))
            i += 1
    return rows


def mix(spark, rows, weights, budget, **kw):
    w = spark.createDataFrame(weights or [("none", None, None, 1)], "domain string, lang string, source string, weight long")
    return mixing.mix(spark.createDataFrame(rows, SCHEMA), w, F.substring("source", 1, 1), F.lit(budget), **kw)


def tokens(df):
    got = df.withColumn("n", mixing.n_tokens()).groupBy("domain", "lang", "source").agg(F.sum("n").alias("n"), F.max("epoch").alias("e")).collect()
    return {(r.domain, r.lang, r.source): (r.n, r.e) for r in got}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = docs_of({("en", "a1"): [1] * 50, ("fr", "a1"): [1] * 400, ("en", "b1"): [1] * 1000})
    # domain a and b get 300 each; a/en can give 50 only, so a/fr gets 250, and b stays at 300.
    got = tokens(mix(spark, rows, [], 600, max_epochs=1))
    assert got == {("a", "en", "a1"): (50, 0), ("a", "fr", "a1"): (250, 0), ("b", "en", "b1"): (300, 0)}
    # domain a as a whole is short of its 600: the rest goes to b.
    got = tokens(mix(spark, rows, [], 1200, max_epochs=1))
    assert got == {("a", "en", "a1"): (50, 0), ("a", "fr", "a1"): (400, 0), ("b", "en", "b1"): (750, 0)}


def test_weights_epochs_and_prefix(spark):
    rows = docs_of({("en", "a1"): [3] * 40, ("en", "b1"): [2] * 100})
    out = mix(spark, rows, [("a", None, None, 3), ("b", None, None, 1)], 400, max_epochs=2)
    got = tokens(out)
    assert got[("a", "en", "a1")] == (240, 1) and got[("b", "en", "b1")][0] == 160
    counts = out.where("domain = 'a'").groupBy("doc_id").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(counts) == (2, 2)
    again = mix(spark, rows[::-1], [("a", None, None, 3), ("b", None, None, 1)], 400, max_epochs=2)
    assert sorted(map(tuple, out.select("doc_id", "epoch").collect())) == sorted(map(tuple, again.select("doc_id", "epoch").collect()))
    other = mix(spark, rows, [("a", None, None, 3), ("b", None, None, 1)], 400, max_epochs=2, seed=5)
    pick = lambda df: {r.doc_id for r in df.where("domain = 'b'").collect()}
    assert pick(out) != pick(other)


@pytest.mark.parametrize("leaves", [20_000, 0])
def test_prefix_never_exceeds_the_budget(spark, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    rows = docs_of({("en", "a1"): list(range(1, 60)), ("de", "a2"): [5, 50, 500]})
    for budget in (1, 100, 1000, 3000):
        got = tokens(mix(spark, rows, [], budget, max_epochs=3))
        assert sum(n for n, _ in got.values()) <= budget


def test_nulls_repeats_empty_and_zero_weight(spark):
    rows = [(1, None, "en", "a1", ""), (2, "x y", None, None, ""), (3, "x y z", "en", "a1", ""), (3, "x y z", "en", "a1", ""), (4, "", "en", "a1", "")]
    got = mix(spark, rows, [], 1000, max_epochs=1)
    assert got.columns == ["doc_id", "text", "lang", "source", "domain", "epoch"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 3]
    assert mix(spark, [], [], 10).count() == 0
    assert tokens(mix(spark, rows[1:2] + rows[4:], [("a", None, None, 0)], 1000, max_epochs=1)) == {("", None, None): (2, 0)}
