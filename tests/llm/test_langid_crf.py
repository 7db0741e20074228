import random

from tidemark.llm import langid_crf as lid

SCHEMA = "doc_id long, text string, lang string, score int"
PARTS = {"aa": "the ing ther tion and wh".split(), "bb": "sch keit eau ung der ü".split(), "cc": "ción ñ mente los ez rr".split()}


def text_of(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def corpus(n, seed):
    rnd = random.Random(seed)
    return [(i, text_of(rnd, lang := rnd.choice(list(PARTS)), rnd.randrange(5, 80)), lang, 0) for i in range(n)]


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.createDataFrame(corpus(150, 1), SCHEMA)
    model = lid.train(docs, docs_per_lang=30)
    held = corpus(200, 2)
    got = {r.doc_id: r for r in lid.predict(spark.createDataFrame(held, SCHEMA), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 196
    assert all(0 <= r.score <= 1 for r in got.values())
    rnd = random.Random(5)
    mixed = text_of(rnd, "aa", 30) + ", 12 " + text_of(rnd, "bb", 30)
    labels = [lang for _, lang, _ in model.label_words([mixed])[0]]
    assert labels[:30].count("aa") >= 28 and labels[30:].count("bb") >= 28


def test_edges(spark):
    model = lid.train(spark.createDataFrame(corpus(60, 3), SCHEMA))
    rows = [(1, None, "aa", 0), (2, "", None, 0), (3, "12 !? 77", "aa", 0), (4, "thing " * 50_000, None, 0), (4, "thing", None, 0), (None, "schkeit", "x", 0)]
    got = [(r.doc_id, r.lang_pred) for r in lid.predict(spark.createDataFrame(rows, SCHEMA), model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (None, "bb")]
    none = lid.train(spark.createDataFrame([], SCHEMA))
    assert {(r.lang_pred, r.score) for r in lid.predict(spark.createDataFrame(rows, SCHEMA), none).collect()} == {("und", 0.0)}
    assert lid.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_batches_do_not_change_results(monkeypatch):
    rows = corpus(40, 4)
    model = lid.fit([(t, x) for _, t, x, _ in rows])
    whole = model.predict([r[1] for r in rows])
    monkeypatch.setattr(lid, "AT_ONCE", 30)
    monkeypatch.setattr(lid, "REMEMBERED", 20)
    parts = model.predict([r[1] for r in rows])
    assert whole[0] == parts[0] and max(abs(a - b) for a, b in zip(whole[1], parts[1])) < 1e-9


def test_numbers_that_are_no_letters():
    model = lid.fit([(t, x) for _, t, x, _ in corpus(60, 3)])
    assert model.predict(["½ ² ①", "Ⅷ ¾", "_ 12", "\u0301"]) == (["und"] * 4, [0.0] * 4)
    assert lid.words_in("a²b ½c Ⅷ élan") == ["a", "b", "c", "élan"]
    assert model.predict(["thing² ther½"])[0] == ["aa"]


def test_forward_backward_against_all_labellings():
    """The label probabilities of short texts, from the weight of every labelling."""
    import itertools
    import math

    model = lid.fit([(t, x) for _, t, x, _ in corpus(60, 5)])
    for text in ("thing schkeit mente", "eau", "ther ther ung ción", "WHING, 12 los"):
        words = lid.words_in(text)
        emit = [[sum(model.weight[f][y] for f in lid.word_features(w, model.lexicon)) for y in range(len(model.langs))] for w in words]
        share = [[0.0] * len(model.langs) for _ in words]
        for labels in itertools.product(range(len(model.langs)), repeat=len(words)):
            weight = math.exp(sum(emit[i][y] for i, y in enumerate(labels)) + sum(model.transit[a][b] for a, b in itertools.pairwise(labels)))
            for i, y in enumerate(labels):
                share[i][y] += weight
        total = sum(share[0])
        means = [sum(s[y] for s in share) / total / len(words) for y in range(len(model.langs))]
        langs, scores = model.predict([text])
        assert langs == [model.langs[max(range(len(means)), key=means.__getitem__)]] and abs(scores[0] - max(means)) < 1e-9


def test_all_of_a_long_word_counts():
    """A change in the middle of a long word changes its features; none is left out."""
    a, b = "a" * 40 + "xyz" + "b" * 40, "a" * 40 + "xqz" + "b" * 40
    none = frozenset()
    assert lid.word_features(a, none) != lid.word_features(b, none)
    assert len(lid.word_features("".join(chr(97 + i % 26) for i in range(26)), none)) == 7 + 23
