import random

import numpy as np

from tidemark.llm import robust_rules as rr

SCHEMA = "doc_id long, text string, lang string, source string, kept int"


def plain(text):
    spaces = " \t\n\x0b\x0c\r"
    text = text or ""
    for c in spaces[1:]:
        if c != "\n":
            text = text.replace(c, " ")
    words = text.replace("\n", " ").split(" ")
    words = [w for w in words if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" ")]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_match_plain_loops():
    rnd = random.Random(0)
    texts = [rnd.choice([" ", "\n"]).join(rnd.choice(["a", "bé", "#c", "d|", ""]) for _ in range(rnd.randrange(60))) for _ in range(80)]
    texts += [None, "", " \n \n", "x y z\nx y z\n \n", "one two three four five six seven eight " * 3, "日本 語 x"]
    got = rr.count_texts([t and t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(got[k][i] for k in got) == plain(t), t


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.randrange(60, 200)
        body = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(k))
        if i % 20 == 0:
            body = " | ".join(f"{w}###" for w in body.split())
        rows.append((i, body, "en" if i % 3 else None, "hot" if i % 2 else "cold", 0))
    return rows


def test_outliers_go_and_clean_rows_stay(spark):
    rows = corpus(900, 1) + [(2000, "too short", "en", "hot", 0), (2001, "again and " * 30, "en", "hot", 0)]
    got = {r.doc_id: r for r in rr.reject(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert got[2000].base_failed and got[2001].base_failed and not got[2000].kept
    odd = [got[i].kept for i in range(0, 900, 20)]
    assert sum(odd) == 0
    assert np.mean([got[i].kept for i in range(900) if i % 20]) > 0.98


def test_small_groups_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None, 0), (2, "word " * 5, "en", "a", 0)] + [(3, " ".join(f"w{i}" for i in range(50)), "en", "a", 0)] * 3
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in rr.reject(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, True, False), (2, True, False), (3, False, True), (3, False, True), (3, False, True)]
    assert rr.reject(spark.createDataFrame([], SCHEMA)).count() == 0
    many = [(i, " ".join(f"w{j}" for j in range(50)), "en", "a", 0) for i in range(80)]
    assert rr.reject(spark.createDataFrame(many, SCHEMA)).where("kept").count() == 80


def test_fast_mcd_ignores_a_cluster():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 5)), rng.normal(size=(60, 5)) + 12])
    centre, precision = rr.fast_mcd(x, 0.75)
    away = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
    assert np.abs(centre).max() < 0.5 and away[300:].min() > away[:300].max()
    assert abs(rr.chi2_quantile(0.0) - 4.351) < 0.02 and abs(rr.chi2_quantile(3.0902) - 20.515) < 0.3


def test_repeated_rows_do_not_switch_off_an_estimate(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(7, body, "en", "a", 0)] * 3000 + [(8, " | ".join("###" for _ in range(80)), "en", "a", 0)]
    got = rr.reject(spark.createDataFrame(rows, SCHEMA))
    assert got.where("cutoff is null").count() == 0
    kept = {(r.doc_id, r.kept) for r in got.select("doc_id", "kept").distinct().collect()}
    assert (7, True) in kept


def test_concentration_against_a_whole_group(spark):
    """Distances of a group by FAST-MCD over all its rows in numpy: the same rows go."""
    rows = corpus(700, 5)
    rows = [(i, t, "en", "one", 0) for i, t, _, _, _ in rows]
    out = rr.reject(spark.createDataFrame(rows, SCHEMA), sample=700)
    measured = rr.measured(spark.createDataFrame(rows, SCHEMA)).where("not base_failed").select("doc_id", *[s.alias(f"s{i}") for i, s in enumerate(rr.statistics())]).toPandas()
    x = measured[[f"s{i}" for i in range(rr.DIM)]].to_numpy()
    centre, precision = rr.fast_mcd(x, 0.75, starts=200, steps=20)
    away = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
    cutoff = max(np.median(away) / rr.chi2_quantile(0.0), 1.0) * rr.chi2_quantile(5.0)
    want = dict(zip(measured.doc_id, away <= cutoff))
    got = {r.doc_id: r.kept for r in out.collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.99


def test_very_long_text(spark):
    rows = [(1, " ".join(f"w{i % 9973}" for i in range(300_000)), "en", "a", 0), (2, "x" * 1_000_000, "en", "a", 0)]
    got = {r.doc_id: r for r in rr.reject(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_words == 300_000 and got[1].base_failed and (got[2].n_words, got[2].word_chars) == (1, 1_000_000)
