"""The registered queries of this folder's operators, with their contracts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import centroids, decontam_sa, langid_crf, license_diagonals, line_templates, mixing, negatives, packing, pii_crf, quality_gam, robust_rules, simhash_vptree, url_rules
from tidemark.llm.common import table
from tidemark.llm.sql import MIX_DOMAIN, MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, URL_RULES


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word SimHash fingerprints differ in at most 4 bits."""
    out = simhash_vptree.simhash_components(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", "fingerprint", "component_id")


def mixed(docs: DataFrame) -> DataFrame:
    """Six tenths of all tokens, mixed to the weights in sql.py."""
    weights = docs.sparkSession.createDataFrame(MIX_WEIGHTS, "domain string, lang string, source string, weight long")
    return mixing.mix(docs, weights, F.expr(MIX_DOMAIN), F.expr("tokens * 6 div 10"), MIX_EPOCHS, seed=MIX_SEED)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs that fill the token budget of each domain, language and source."""
    leaf = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "domain", *leaf, "epoch")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of each document, counted and hashed, and all spans."""
    out = pii_crf.find(table(spark, sf_dir, "documents"), pii_crf.train())
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in pii_crf.BASE_KINDS]
    all_spans = (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return out.select("doc_id", *counts, F.sha2(pii_crf.joined("base"), 256).alias("base_sha256"), pii_crf.joined("concat(base, added)").alias("spans"), all_spans)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a model of four fifths of the ids; a row without an id is
    neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5
    out = langid_crf.predict(docs, langid_crf.train(docs.where(fifth != 0)))
    return out.select("doc_id", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template recurs across documents."""
    out = line_templates.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_report.n_lines", "lines_report.n_dropped", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by a model of the labels of two thirds of the ids; a row without
    an id is neither learned from nor held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    out = quality_gam.score(docs, quality_gam.train(docs, labels.where(third != 1)))
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in 13-word windows of benchmark items."""
    out = decontam_sa.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, one_in=20)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam_sa.digest("items").alias("items_sha256"), "contaminated", "longest", "longest_at")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL: the contract's rules first, then the method's own."""
    rules = spark.createDataFrame([(*r, 0) for r in URL_RULES], "host string, path string, verdict string, tier int")
    out = url_rules.judge(table(spark, sf_dir, "pages"), rules.union(url_rules.default_rules(spark, tier=1)))
    return out.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, the base rules, and the robust outliers of its group."""
    out = robust_rules.reject(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages of each document."""
    return license_diagonals.scan(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive."""
    ids = F.col("vec_id")
    label = F.when(ids % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), ids % 100 == 0, label, positives=5, negatives=10, window=(30, 90))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after five rounds over 40 centroids."""
    rows, found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64)
    whole = F.try_sum("cluster_inertia").over(Window.partitionBy())  # over the k centroids only
    named = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    found = found.select("cluster", "cluster_inertia", whole.alias("inertia"), named.alias("centroid_sha256"))
    return rows.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_lines": op5_lines,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_urls": op8_urls,
    "op9_rules": op9_rules,
    "op10_licenses": op10_licenses,
    "op11_negatives": op11_negatives,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
}
