"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a tree of domains, languages and sources. At every node it
is shared by the children's weights; a child whose documents cannot fill its share,
even if repeated ``max_epochs`` times, gives what is left to its siblings. Only what
a whole subtree cannot use goes to the parent's siblings, because a node's capacity is
the sum of its leaves' capacities. Each leaf then takes whole epochs of its documents
and, of the last epoch, the prefix that fits in a seeded order of its own.

Shares are whole tokens in integer arithmetic (weights are whole numbers), so results
do not depend on the order of summation. The prefix of a leaf is found in two steps:
token sums of 4096 ranges of the seeded hash, then the documents of the one range in
which the budget ends. So no task sorts a whole leaf, however large. Texts are read
for counting and for the result and never shuffled while the tree has at most
``BROADCAST_LEAVES`` leaves; with more, the plan is joined by shuffle.

Edge cases: a null or wordless text has no tokens and is not taken; null lang or source is a leaf of its own, named
by the empty string; a node without a given weight has ``default_weight``; weight 0
takes nothing; a text of any length is counted whole and taken whole, and one of more tokens
than its leaf's share is not taken; an own column ``domain`` or ``epoch`` is replaced; rows that repeat a doc_id have one place in the order and are taken or
left together; leaves without tokens are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Leaves (three short names and numbers each) up to which the plan is broadcast.
BROADCAST_LEAVES = 20_000
LEVELS = ["domain", "lang", "source"]
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"


def n_tokens(text: str = "text") -> Column:
    """Whitespace-separated words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def leaf_names(domain: Column) -> list[Column]:
    return [F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source")]


def fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """nodes (weight, capacity, budget of the parent) with ``share``: whole tokens for each.

    In the order of capacity over weight, children are full as long as the share of what
    is left would exceed their capacity; the others divide the rest by weight.
    """
    ratio = [F.col("capacity") / F.col("weight"), *[F.col(c) for c in LEVELS if c in nodes.columns]]
    order = W.partitionBy(*parents).orderBy(*ratio)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    all_ = W.partitionBy(*parents)
    weight_on = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nodes = nodes.where("weight > 0").withColumn("full", F.col("capacity") * weight_on <= F.col("weight") * (F.col("budget") - before))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(all_)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_)
    nodes = nodes.withColumn("rest", rest).withColumn("open_weight", open_weight)
    return nodes.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(weight * rest) div open_weight"))).drop("full", "rest", "open_weight")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, budget: Column, max_epochs: int, default_weight: int) -> DataFrame:
    """(domain, lang, source, tokens, share) of each leaf with tokens.

    weights: (domain, lang, source, weight); lang and source null for a domain's weight,
    source null for that of a language in a domain.
    """
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    top = leaves.agg(F.sum("tokens").alias("tokens")).select(budget.cast("long").alias("budget"), F.lit(0).alias("root"))
    above, parents = top, ["root"]
    for depth in range(1, len(LEVELS) + 1):
        names = LEVELS[:depth]
        given = weights.where(" and ".join(f"{c} is {'not ' if c in names else ''}null" for c in LEVELS)).select(*names, "weight")
        nodes = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("root", F.lit(0))
        nodes = nodes.join(given, names, "left").withColumn("weight", F.coalesce(F.col("weight"), F.lit(default_weight)).cast("long"))
        nodes = fill(nodes.join(above, parents), parents)
        above, parents = nodes.select(*names, F.col("share").alias("budget")), names
    return nodes.select(*LEVELS, "tokens", "share")


def order_key(seed: int, epoch: Column) -> Column:
    """A document's place in the seeded order of an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def mix(docs: DataFrame, weights: DataFrame, domain: Column, budget: Column, max_epochs: int = 2, default_weight: int = 1, seed: int = 17) -> DataFrame:
    """The documents' columns with ``domain`` and ``epoch``, one row per document and epoch taken.

    domain: a document's domain. budget: tokens, as a Column that may use ``tokens``, all there are.
    """
    names = leaf_names(domain)
    small = checkpointed(docs.select("doc_id", *names, n_tokens().alias("tokens")).where("tokens > 0"))
    plan = leaf_budgets(small.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, budget, max_epochs, default_weight)
    plan = plan.selectExpr(*LEVELS, "share div tokens as epochs", "share % tokens as rest")
    plan = checkpointed(plan)
    few = plan.count() <= BROADCAST_LEAVES
    hint = F.broadcast if few else (lambda df: df)

    ranked = small.join(hint(plan), LEVELS).withColumn("key", order_key(seed, F.col("epochs"))).withColumn("range", F.substring("key", 1, 3))
    sums = ranked.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("range"))
    sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    last = checkpointed(sums.where("before <= rest and upto > rest").select(*LEVELS, "range", "before"))
    inside = ranked.join(hint(last), [*LEVELS, "range"])
    upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("key"))
    taken = inside.withColumn("upto", upto).where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("key"))
    plan = plan.join(last, LEVELS, "left").join(taken, LEVELS, "left").select(*LEVELS, "epochs", F.coalesce("key", "range").alias("cut"))
    plan = checkpointed(plan).select(*[F.col(c).alias(f"_{c}") for c in [*LEVELS, "epochs", "cut"]])

    own = docs.where(F.col("text").rlike(TOKEN)).select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), *names)
    rows = own.join(hint(plan), [F.col(c) == F.col(f"_{c}") for c in LEVELS])
    last_epoch = F.col("_epochs") - F.when(order_key(seed, F.col("_epochs")) <= F.col("_cut"), 0).otherwise(1)
    rows = rows.withColumn("_last", last_epoch).where("_last >= 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return rows.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns if c not in ("domain", "epoch")], "domain", "epoch")
