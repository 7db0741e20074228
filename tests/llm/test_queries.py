"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import os

import duckdb
import pytest

from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import ORACLE_SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    plain = lambda v: None if v is None else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_per_document(spark, name):
    rows = QUERIES[name](spark, DATA).toPandas()
    ids = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").toPandas()
    rows = rows[rows.piece == 0] if name == "op13_packing" else rows
    assert sorted(rows.doc_id) == sorted(ids.doc_id)


def test_whole_documents_match_brute_force(spark):
    """op1, op3, op9 and op10 over the given documents."""
    import hashlib

    from tests.llm import test_license_diagonals, test_pii_crf, test_robust_rules
    from tidemark.llm import simhash_vptree

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    text = dict(docs)
    got = QUERIES["op1_simhash"](spark, DATA).toPandas().set_index("doc_id").sort_index()
    want = simhash_vptree.brute_force(docs).set_index("doc_id").sort_index()
    assert (got.fingerprint == want.fingerprint).all() and (got.component_id == want.component_id).all()
    for r in QUERIES["op3_pii"](spark, DATA).collect():
        spans = test_pii_crf.plain(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for _, _, k in spans)
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) >= len(spans)
    for r in QUERIES["op9_rules"](spark, DATA).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == test_robust_rules.plain(text[r.doc_id])
    for r in QUERIES["op10_licenses"](spark, DATA).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == test_license_diagonals.plain(text[r.doc_id])


def test_pipeline_stages(spark):
    """Each stage over all that the one before kept, and its decisions in its result."""
    import corpus_pipeline
    from tidemark.llm import decontam_sa, quality_gam

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(seen[-1], schema="doc_id long, text string, lang string, source string, n_chars long")
        out = stage(spark, docs, DATA)
        seen.append(out.toPandas())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns
    start, good, lines, single, clean, mixed = seen
    model = quality_gam.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    score = model.score(quality_gam.matrix([t.encode() for t in start.text]))
    assert sorted(good.doc_id) == sorted(start.doc_id[score >= 0.5])
    assert sorted(lines.doc_id) == sorted(good.doc_id) and (lines.text.str.len() == lines.n_chars).all() and lines.n_chars.sum() < good.n_chars.sum()
    # One document of each class of all pairs at 0.8 or more stays, that of the smallest id.
    from tests.llm.test_simhash_vptree import similar_classes

    want = similar_classes([(r.doc_id, r.text, 0) for r in lines.itertuples()])
    assert sorted(single.doc_id) == sorted(set(want.values())) and len(single) < len(lines)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()
    hits = decontam_sa.brute_force(list(zip(single.doc_id, single.text)), list(zip(bench.item_id, bench.text)))
    assert sorted(clean.doc_id) == sorted(i for i, (n, h, _, _) in hits.items() if not (h and 20 * h >= n))
    assert set(mixed.doc_id) <= set(clean.doc_id) and not mixed.duplicated(["doc_id", "epoch"]).any()
    assert corpus_pipeline.run(spark, DATA).count() == len(mixed)


def write(spark, path, docs, labels=None):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row_key int, label string, tokens int, _key string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(5 if docs else 0).write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_edges_end_to_end(spark, tmp_path):
    """Nulls in each column, empty and very long texts, repeated rows and clashing columns."""
    import corpus_pipeline

    given = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(120).collect()
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    more = lambda i, text, lang="en", source="s1": (i, text, lang, source, 0 if text is None else len(text), 1, "x", None, "k")
    rows = [more(r.doc_id, r.text, r.lang, r.source) for r in given]
    good = next(r for r in given if 150 < len(r.text.split()) < 400 and any(x[0] == r.doc_id and x[1] for x in labels))
    shuffled = lambda k: " ".join(sorted(good.text.split(), key=lambda w: (hash((w, k)), w)))
    long = "\n".join(f"{good.text} {shuffled(k)} part{k}" for k in range(150))
    odd = [more(9001, None), more(9002, ""), more(9003, "   \n\n \t "), more(None, good.text), more(9005, long), more(9006, good.text, None, None), *[more(9007, good.text)] * 3, *[more(good.doc_id, good.text)] * 2]
    write(spark, tmp_path / "some", rows + odd, labels)
    docs, path, kept = spark.read.parquet(f"{tmp_path}/some/documents.parquet"), str(tmp_path / "some"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path))
        assert docs.columns == columns, name
        kept.append(docs.select("doc_id", "text").toPandas())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).toPandas()
    # A text without words has no label of its own kind to learn from: it may go at once, and is never in the mixture.
    assert not set(last.doc_id.dropna()) & {9001, 9002, 9003}
    # One row of the copies stays whole: line dedup takes the row without an id for the first.
    assert (kept[1].text == good.text).sum() <= 1 and (kept[2].text == good.text).sum() <= 1
    assert len(kept[2]) == len(kept[2].drop_duplicates(["doc_id"])) and len(kept[3]) <= len(kept[2])
    assert sorted(corpus_pipeline.run(spark, path).toPandas().doc_id) == sorted(last.doc_id)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    write(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
