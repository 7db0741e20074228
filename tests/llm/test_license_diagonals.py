import random
import re

from tidemark.llm import license_diagonals as ld

SCHEMA = "doc_id long, text string, labels int"


def plain(text):
    words = re.findall(ld.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in ld.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scan(spark, texts):
    rows = ld.scan(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r for r in rows}


def test_base_matches_plain_search(spark):
    rnd = random.Random(2)
    vocab = "gnu general public license apache cc by mit nc the é9 ISC".split()
    texts = [rnd.choice([" ", ". ", "\n- "]).join(rnd.choice(vocab) for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, "", "MIT", "The MIT  License, (CC BY 4.0)", "cc by " * 5000]
    for i, r in scan(spark, texts).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[i]), texts[i]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_changed_passages_are_found_on_neighbouring_diagonals(spark):
    words = ld.PASSAGES[0][0].split()
    changed = words[:10] + ["kindly"] + words[10:25] + words[27:]
    texts = ["Foo bar. " + " ".join(words), "x " * 50 + " ".join(changed).upper(), " ".join(words[:12]), " ".join(sorted(words))]
    got = scan(spark, texts)
    assert [got[i].labels for i in range(4)] == ["mit", "mit", "", ""]
    assert got[0].score == 1.0 and 0.6 <= got[1].score < 1 and got[2].score == 0.0
    assert scan(spark, ["Licensed under CC BY-NC 4.0."])[0].labels == "cc-by,cc-by-nc"


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "mit license", 0), (1, "mit license", 0), (None, "mit license", 0), (2, None, 0)]
    got = [(r.doc_id, r.n_base) for r in ld.scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 0), (None, 1)]
    assert ld.scan(spark.createDataFrame([], SCHEMA)).count() == 0
