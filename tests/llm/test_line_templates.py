from tidemark.llm import line_templates as lt

SCHEMA = "doc_id long, line_no string, text string"


def run(spark, rows, **kw):
    out = lt.dedup_lines(spark.createDataFrame(rows, SCHEMA), **kw)
    assert out.columns == ["doc_id", "line_no", "text", "lines_report"]
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text, r.lines_report.n_lines, r.lines_report.n_dropped) for r in out.collect()), key=str)


def test_recurring_templates_go_and_first_stays(spark):
    rows = [
        (1, "x", "a line of its own one\nPage 3 of 10, printed 2024-01-02\nthe end of it all here"),
        (2, "x", "Page 17 of 20,  printed 2023-11-30\nanother line of its own"),
        (3, "x", "Page 4 of 9, printed 1999-05-05"),
        (4, "x", "short line\nshort line\n\n"),
    ]
    assert run(spark, rows) == [
        (1, rows[0][2], 3, 0), (2, "another line of its own", 2, 1), (3, "", 1, 1), (4, rows[3][2], 4, 0),
    ]


def test_one_free_field(spark):
    line = "posted in the great hall by {} on a fine day in early spring"
    rows = [(i, "x", line.format(who) + f"\nbody number {who} stays right here") for i, who in enumerate(["ann", "bob", "cyd", "dee"], 1)]
    assert [r[1:] for r in run(spark, rows)] == [(rows[0][2], 2, 0), *[(r[2].split("\n")[1], 2, 1) for r in rows[1:]]]


def test_repeats_in_one_document_stay_unless_shared(spark):
    twice = "the same five words here\nthe same five words here"
    assert run(spark, [(1, "x", twice)]) == [(1, twice, 2, 0)]
    assert run(spark, [(1, "x", twice), (2, "x", twice)]) == [(1, "the same five words here", 2, 1), (2, "", 2, 2)]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "x", "some line of five words"), (7, None, None), (8, "x", ""), (9, "x", "some line of five words"), (9, "x", "some line of five words")]
    assert run(spark, rows) == sorted([(-1, rows[0][2], 1, 0), (7, None, 0, 0), (8, "", 1, 0), (9, "", 1, 1), (9, "", 1, 1)], key=str)
    assert run(spark, []) == []


def letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_long_document(spark):
    body = "\n".join(" ".join(f"{letters(i)}{k}" for k in "abcdef") for i in range(20_000))
    got = run(spark, [(1, "x", body), (2, "x", body)])
    assert got[0][1] == body and got[1][1] == "" and got[1][2:] == (20_000, 20_000)


def test_short_lines_go_in_the_pipeline(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"All rights reserved.\n\nword{letters(i)}\n文章\nsaid twice" if i < 2 else f"All rights reserved.\n\nword{letters(i)}\n文章", 0) for i in range(4)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    assert got == {0: docs.first().text, 1: f"\nword{letters(1)}\nsaid twice", 2: f"\nword{letters(2)}", 3: f"\nword{letters(3)}"}


def plain(rows):
    """The same result by plain loops over (doc_id, text) of distinct ids."""
    import re
    from collections import defaultdict

    lines = [(d, i, re.sub("[0-9]+", "<*>", " ".join(x.split())).split(" ")) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = [(d, i, t) for d, i, t in lines if t != [""]]
    def leaves(t):
        k = min(4, (2 * len(t) + 4) // 5)
        return [(len(t), "lead", tuple(t[:k])), (len(t), "tail", tuple(t[-k:]))] if len(t) >= 4 else []

    docs, holders, support = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, _, t in lines:
        for leaf in leaves(t):
            docs[leaf].add(d)
            for k, w in enumerate(t):
                holders[leaf, k, w].add(d)
                support[leaf, k, w].add(tuple(t))
    groups = defaultdict(set)
    for d, i, t in lines:
        groups[3 if len(t) < 4 else 2, tuple(t), "exact"].add((d, i))
        for leaf in leaves(t):
            if len(docs[leaf]) >= 3:
                own = [len(support[leaf, k, w]) for k, w in enumerate(t)]
                measure = sorted(own, reverse=True)[-(-3 * len(t) // 4) - 1]
                fixed = [2 * s > measure and len(holders[leaf, k, w]) > 1 for k, (s, w) in enumerate(zip(own, t))]
                if measure >= 2 and sum(fixed) >= 0.75 * len(t):
                    groups[10 if len(t) < 8 else 3, tuple(w if f else "<*>" for w, f in zip(t, fixed)), "general"].add((d, i))
    gone = {x for (need, _, _), places in groups.items() if len({d for d, _ in places}) >= need for x in places - {min(places)}}
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_matches_plain_loops(spark):
    import random

    rnd = random.Random(4)
    frames = ["signed by {} at the {} office of the northern {} on a day", "{} of the", "total {} items", "a b c {} d e f g", "one two three four five six seven {}", "{} two three four five six seven eight"]
    words = [letters(i) for i in range(40)] + ["red", "blue"] * 8
    rows = [(i, "\n".join(re_fill(rnd, rnd.choice(frames), words) for _ in range(rnd.randrange(6)))) for i in range(120)] + [(500, None), (501, "")]
    want = plain(rows)
    got = {r[0]: r[1] for r in run(spark, [(d, "x", t) for d, t in rows])}
    assert got == want and sum(want[d] != t for d, t in rows) > 50


def re_fill(rnd, frame, words):
    while "{}" in frame:
        frame = frame.replace("{}", rnd.choice(words), 1)
    return frame


def test_a_field_at_the_end_and_two_fields(spark):
    line = "the meeting was held in {} and was well attended by all of our {}"
    rows = [(i, "x", line.format(a, b)) for i, (a, b) in enumerate([("rome", "friends"), ("oslo", "members"), ("bonn", "guests"), ("lyon", "staff")])]
    assert [r[1] for r in run(spark, rows)] == [rows[0][2], "", "", ""]


def test_short_lines_and_their_limit(spark):
    rows = [(i, "x", "Read more\n文章\nalone " + letters(i) + ("\ntwice here" if i < 2 else "")) for i in range(3)]
    assert [r[1] for r in run(spark, rows)] == [rows[0][2], "alone " + letters(1) + "\ntwice here", "alone " + letters(2)]
    assert [r[1] for r in run(spark, rows, short_docs=4)] == [r[2] for r in rows]


def test_clashing_columns_and_repeated_ids(spark):
    line = "the very same words in a line"
    rows = [(1, line, "r"), (1, "other words that are alone here\n" + line, "r"), (2, line, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_report string")
    for name in ("row_key", "line", "n", "norm", "t1", "leaf", "_key", "_dropped", "dropped", "_in_0"):
        docs = docs.withColumn(name, docs.doc_id)
    got = lt.dedup_lines(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    # Of one doc_id two texts hold the line: the ids tell no order, so that both first places stay.
    assert sorted((r.doc_id, r.text, r.leaf) for r in got.collect())[-1] == (2, "", 2)


DAYS = "monday tuesday wednesday thursday friday saturday".split()


def planted(spark, docs, line):
    """Documents of two lines of their own and one of ``line``; how many of those went, and others."""
    own = lambda i, k: " ".join(f"{letters(31 * i + 7 * j + k)}{'abc'[k]}" for j in range(12))
    rows = [(i, "x", f"{own(i, 0)}\n{line(i)}\n{own(i, 1)}") for i in range(docs)]
    got = {r[0]: r[1].split("\n") for r in run(spark, rows)}
    gone = sum(line(i) not in got[i] for i in range(docs))
    return gone, sum(len(x) for x in got.values()) + gone == 3 * docs


def test_fields_of_few_values_at_any_size(spark):
    names, many = ["ann", "bob", "cyd", "dee", "eve", "flo"], [f"n{letters(i)}" for i in range(3600)]
    long = "this entry was posted by moderator {} on last {} in the public forum"
    for docs in (36, 3600):
        lines = [
            lambda i: long.format(names[i % 6], DAYS[i // 6 % 6]),
            lambda i: long.format(many[i], many[-1 - i]),
            lambda i: f"posted by {many[i % 26 if docs == 36 else i]} in the forum",
            lambda i: f"user {many[i]} has posted this entry in the public forum on behalf of all",
        ]
        for line in lines:
            gone, others = planted(spark, docs, line)
            assert gone == docs - 1 and others


def test_common_words_in_few_frames_stay(spark):
    """Lines of common words that share their leading and trailing tokens but under three quarters of all."""
    words = ["red", "old", "new", "dry", "hot", "odd"]
    line = lambda i: "it is said that the {} and {} men or {} and {} women may come to see us".format(*(words[i // 6**k % 6] for k in range(4)))
    other = lambda i: "in the end of {} {} {} {} {} {} they came to us".format(*(letters(97 * i + k) for k in range(6)))
    assert planted(spark, 600, other) == (0, True)
    gone, others = planted(spark, 600, line)
    assert gone and others  # four fields in eighteen tokens are a template
