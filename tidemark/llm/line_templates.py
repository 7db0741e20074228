"""Line deduplication with a log-template tree, in DataFrame operations only.

A line is parsed at fixed depth, with digits generalised to ``<*>``:

* level 1 is its number of tokens, level 2 its leading tokens: two fifths of them, four at
  most. That names a leaf. The wildcard branch of level 1 takes any leading tokens, and
  there as many trailing tokens name the leaf, so that fields among the first tokens part
  nothing;
* in a leaf the support of a token is the number of different lines that have it at its
  place. A line's own measure is the support that ``fixed_share`` of its tokens reach: that
  of the frame it was made from, however many other lines and frames the leaf has. A token
  of more than half that support, found in two documents, is fixed; any other is a variable
  field and becomes ``<*>`` as well. So a field's values may each recur any number of times.
  A line whose tokens are fixed to ``fixed_share``, with a measure of two lines or more,
  has the leaf's tokens and fields as its general template; lines of fewer than
  ``min_tokens`` tokens have none;
* every line that is not blank has an exact template, all its tokens.

A template that recurs in ``min_docs`` documents (``general_docs`` for general ones,
``short_general_docs`` for those of fewer than ``general_tokens`` tokens, ``short_docs`` for
exact ones of fewer than ``min_tokens``) is boilerplate or a copied passage: its first
occurrence, by doc_id and line number, stays and every other line of it goes. So a line that
goes agrees in ``fixed_share`` of its tokens, place by place, with lines of
``general_docs`` - 1 other documents. Blank lines stay.

Only (doc_id, text hash, line number, template hashes) rows are shuffled to find recurring
templates; counts are pre-aggregated by document, and a template that a third of all
lines share meets a single row of statistics in a join that adaptive execution can split.
Tokens are looked at only in leaves that recur in ``general_docs`` documents and hold
several exact templates, and there once for each different line, whose text is fetched
from one of its documents. Whole
texts move once, to meet the numbers of their dropped lines.

Edge cases: a null text stays null and has no lines; an empty text is one empty line;
if all lines go the text becomes empty; rows with equal doc_id and text are treated
alike and count as one document; a null doc_id counts as one document that comes
first; very long texts are split whole, and a very long line is hashed, not carried;
other columns pass through, but for an own ``lines_report``, which is replaced. Exact
and general templates are compared by two independent hashes of 96 bits in all: two
different ones are taken for the same with a chance of about 1e-29 a pair.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, stored

#: Rows of a few numbers up to which a table of leaves or templates is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table, marked for broadcasting if it has few rows: then the lines that
    look it up are not shuffled, and no task gets all lines of a hot leaf or template."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plain_line(line: Column) -> Column:
    """A line with single spaces between its tokens and none around them."""
    # Most lines hold single spaces only, which plain searches tell faster than the pattern.
    spaced = [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\r", "\f", "\x0b")]
    return F.trim(F.when(reduce(or_, spaced), F.regexp_replace(line, "[ \\t\\r\\f\\x0B]+", " ")).otherwise(line))


def without_digits(plain: Column) -> Column:
    return F.regexp_replace(plain, "[0-9]+", "<*>")


def two_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(F.lit(1), text).alias("t2")]


def templates(docs: DataFrame, min_tokens: int = 4) -> DataFrame:
    """(doc_id, row_key, line_no, n, t1, t2, lead, tail) of the lines that are not blank: the number
    of tokens, the hashes of the exact template, and those of both leaves for lines of
    ``min_tokens`` tokens or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = plain_line(F.col("line"))
    # Counted before numbers are generalised, which changes no token's bounds.
    lines = lines.where(plain != "").withColumn("n", F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1)
    lines = lines.withColumn("norm", without_digits(plain)).withColumn("depth", F.expr("least(4, (2 * n + 4) div 5)").cast("int"))
    lead, tail = F.expr("substring_index(norm, ' ', depth)"), F.expr("substring_index(norm, ' ', -depth)")
    leaves = [F.when(F.col("n") >= min_tokens, F.xxhash64("n", F.lit(kind), words)).alias(kind) for kind, words in (("lead", lead), ("tail", tail))]
    return lines.select("doc_id", "row_key", "line_no", F.col("n").cast("int").alias("n"), *two_hashes(F.col("norm")), *leaves)


def general_templates(docs: DataFrame, found: DataFrame, general_docs: int, fixed_share: float) -> DataFrame:
    """(t1, t2, g1, g2): the general templates, two at most, of exact templates that have one."""
    deep = found.where("lead is not null").select("doc_id", "row_key", "line_no", "t1", "t2", F.explode(F.array("lead", "tail")).alias("leaf"))
    by_doc = deep.groupBy("leaf", "doc_id").agg(F.min("t1").alias("least"), F.max("t1").alias("most"))
    leaves = by_doc.groupBy("leaf").agg(F.count("*").alias("docs"), (F.min("least") < F.max("most")).alias("several"))
    leaves = checkpointed(leaves.where((F.col("docs") >= general_docs) & F.col("several")).select("leaf"))
    doc = F.struct("doc_id")  # a null id is a document too
    at = F.min(F.struct("doc_id", "row_key", "line_no")).alias("at")
    members = deep.join(small(leaves), "leaf").groupBy("t1", "t2").agg(F.collect_set("leaf").alias("leaves"), F.min(doc).alias("least"), F.max(doc).alias("most"), at)
    members = checkpointed(members)
    # A line's text is fetched from one of its documents; tokens and templates go on as hashes.
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    fetched = texts.join(small(members), F.col("_id").eqNullSafe(F.col("at.doc_id")) & (F.col("_key") == F.col("at.row_key")))
    norm = without_digits(plain_line(F.get(F.split("text", "\n"), F.col("at.line_no"))))
    fetched = fetched.select("leaves", "t1", "t2", "least", "most", norm.alias("norm")).dropDuplicates(["t1", "t2"])
    tokens = fetched.select(F.explode("leaves").alias("leaf"), "t1", "t2", "least", "most", "norm")
    tokens = tokens.select("leaf", "t1", "t2", "least", "most", F.posexplode(F.split("norm", " ")).alias("place", "token"))
    tokens = checkpointed(tokens.select("leaf", "t1", "t2", "least", "most", F.xxhash64("place", "token").alias("part"), F.hash("token", "place").alias("check")))
    at = ["leaf", "part", "check"]
    support = tokens.groupBy(*at).agg(F.count("*").alias("support"), F.min("least").alias("least"), F.max("most").alias("most"))
    # Negative where all of a token's lines are of one document, so that it is never fixed.
    support = support.select(*at, F.when(F.col("least").eqNullSafe(F.col("most")), -F.col("support")).otherwise(F.col("support")).alias("support"))
    parts = tokens.select("t1", "t2", *at).join(support, at)
    lines = parts.groupBy("leaf", "t1", "t2").agg(F.collect_list(F.struct("support", "part", "check")).alias("parts"), F.count("*").alias("n"))
    supports = F.sort_array(F.transform("parts.support", F.abs), asc=False)
    measure = F.element_at(supports, F.ceil(F.lit(fixed_share) * F.col("n")).cast("int"))
    # Bound as the element of an array: a column would be worked out anew for each part.
    bound = F.filter(F.array(measure), lambda m: m >= 2)
    fixed = F.flatten(F.transform(bound, lambda m: F.filter(F.col("parts"), lambda x: 2 * x["support"] > m)))
    lines = lines.select("t1", "t2", "n", fixed.alias("fixed"))
    lines = lines.where(F.size("fixed") >= fixed_share * F.col("n"))
    # Places differ, so that a template is told by the combined hashes of its fixed parts.
    combined = lambda c, t: F.aggregate(F.col(f"fixed.{c}"), F.lit(0).cast(t), lambda a, x: a.bitwiseXOR(x))
    g1, g2 = F.xxhash64("n", F.size("fixed"), combined("part", "long")), F.hash("n", F.size("fixed"), combined("check", "int"))
    return lines.select("t1", "t2", g1.alias("g1"), g2.alias("g2")).distinct()


def later_lines(rows: DataFrame, need: Column) -> DataFrame:
    """The lines (doc_id, row_key, line_no, t1, t2, n) but for the first of each template, of
    templates that stand in ``need`` documents."""
    by_doc = rows.groupBy("t1", "t2", "doc_id").agg(F.min("line_no").alias("line_no"), F.max("n").alias("n"))
    stats = by_doc.groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.max("n").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    # Written, so that the join deals out its rows anew and a hot template can be split.
    recurring = checkpointed(stats.where(F.col("docs") >= need).select("t1", "t2", "first"))
    later = rows.join(small(recurring), ["t1", "t2"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    return later.select("doc_id", "row_key", "line_no")


def dropped_lines(docs: DataFrame, min_tokens: int = 4, general_tokens: int = 8, min_docs: int = 2, general_docs: int = 3, short_docs: int = 3, short_general_docs: int = 10, fixed_share: float = 0.75) -> DataFrame:
    """(doc_id, row_key, dropped): the numbers of the lines that repeat a recurring template."""
    found = stored(templates(docs, min_tokens))
    general = checkpointed(general_templates(docs, found, general_docs, fixed_share))
    alike = found.where("lead is not null").join(small(general), ["t1", "t2"]).select("doc_id", "row_key", "line_no", "n", F.col("g1").alias("t1"), F.col("g2").alias("t2"))
    exact = later_lines(found.drop("lead", "tail"), F.when(F.col("n") < min_tokens, short_docs).otherwise(min_docs))
    general = later_lines(alike, F.when(F.col("n") < general_tokens, short_general_docs).otherwise(general_docs))
    return exact.union(general).groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(docs: DataFrame, min_tokens: int = 4, general_tokens: int = 8, min_docs: int = 2, general_docs: int = 3, short_docs: int = 3, short_general_docs: int = 10, fixed_share: float = 0.75) -> DataFrame:
    """The documents with their columns, text without repeated lines, and a struct ``lines_report``
    of n_lines and n_dropped."""
    dropped = dropped_lines(docs.select("doc_id", "text"), min_tokens, general_tokens, min_docs, general_docs, short_docs, short_general_docs, fixed_share)
    dropped = dropped.select(F.col("doc_id").alias("_drop_id"), F.col("row_key").alias("_drop_key"), F.col("dropped").alias("_dropped"))
    # The split text crosses the join, so that it is split once and not for each line.
    others = [F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns) if c != "text"]
    rows = docs.select(*others, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.split("text", "\n").alias("_lines"))
    rows = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_key") == F.col("_drop_key")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_dropped")
    text = F.when(F.col("_dropped").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    n_lines = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    report = F.struct(n_lines.alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    back = [text.alias(c) if c == "text" else F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns) if c != "lines_report"]
    return rows.select(*back, report.alias("lines_report"))
