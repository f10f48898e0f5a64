"""Sources mixed to target shares of all tokens.

Each source first contributes as many whole copies of itself as its share allows; the
rest is a Pareto sample: documents rank by their random odds over their inclusion odds,
and the lowest are taken until the tokens are reached. Inclusion is in proportion to a
weight, such as a document's size, or equal. Documents whose odds would exceed certainty are
taken, and what they leave is shared out among the others anew, until none exceeds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the ranking variable in which tokens are summed before any row is ordered.
BINS = 4096


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> DataFrame:
    """``mix, source, target_share, max_repeats, have, total, need, short, copies, rest, reachable``.

    ``total`` is ``total_tokens`` for every mix; with ``"all"``, all tokens that the mix's
    sources have; with None, the largest size at which each source that has any documents
    can still give its share within ``max_repeats``. A source with less than its share
    gives what it can; ``reachable`` says which reach theirs, ``short`` how many tokens
    are lacking. Negative or null shares count as 0.
    """
    have = sizes.where(F.col("tokens") > 0).groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.select(
        "mix", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"),
    )
    t = t.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)).cast("bigint"))
    most = F.col("max_repeats") * F.col("have")
    # A short list of targets: the window sees one row for each.
    mix = Window.partitionBy("mix")
    if total_tokens is None:
        total = F.coalesce(F.min(F.when((most > 0) & (F.col("target_share") > 0), most / F.col("target_share"))).over(mix), F.lit(0.0))
    elif total_tokens == "all":
        total = F.sum(F.when(F.col("target_share") > 0, F.col("have")).otherwise(0)).over(mix).cast("double")
    else:
        total = F.lit(float(total_tokens))
    need = F.least(F.col("total") * F.col("target_share"), most.cast("double"))
    return (
        t.withColumn("total", total)
        .withColumn("need", need)
        .withColumn("short", F.floor(F.greatest(F.col("total") * F.col("target_share") - F.col("need"), F.lit(0.0)) + 1e-6).cast("bigint"))
        .withColumn("reachable", (F.col("total") > 0) & (F.col("need") >= F.col("total") * F.col("target_share") * (1 - 1e-9)))
        .withColumn("copies", F.when(F.col("have") > 0, F.floor(F.col("need") / F.col("have") + 1e-9)).otherwise(0).cast("bigint"))
        .withColumn("rest", F.greatest(F.col("need") - F.col("copies") * F.col("have"), F.lit(0.0)))
    )


def _uniform(*cols) -> F.Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _odds(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """``mix, source, _scale``: inclusion is ``_scale`` times the weight, and certain from 1 on.

    With the documents in falling order of weight, certainty is a prefix. For each prefix
    the tokens left over the weighted tokens of the rest is the scale; the first that
    makes the next document less than certain is the one. Rows are one for each distinct
    weight of a source, so the running sums are over weights, not over documents.
    """
    steps = docs.groupBy("source", "_w").agg(F.sum("tokens").cast("double").alias("_t"), F.sum(F.col("_w") * F.col("tokens")).alias("_wt"))
    falling = Window.partitionBy("mix", "source").orderBy(F.desc("_w"))
    rows = steps.join(F.broadcast(goal.where(F.col("rest") > 0).select("mix", "source", "rest")), "source")
    rows = rows.withColumn("_sure", F.sum("_t").over(falling) - F.col("_t"))
    rows = rows.withColumn("_tail", F.sum("_wt").over(falling.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_scale", F.greatest(F.col("rest") - F.col("_sure"), F.lit(0.0)) / F.col("_tail"))
    fit = rows.where(F.col("_scale") * F.col("_w") < 1)
    return fit.groupBy("mix", "source").agg(F.max_by("_scale", "_w").alias("_scale"))


def draw(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 1, total_tokens: float | str | None = None, weight: str | None = None) -> DataFrame:
    """``mix, source, key, copies, tokens``: the documents of each mix and how often they come.

    ``sizes`` has ``key, source, tokens`` and unique keys; rows without a source or without
    tokens are in no mix. Inclusion odds are in proportion to the column ``weight``, equal
    if that is None. No source is ever gathered: tokens are summed by bins of the ranking
    variable, and only the one bin in which the target is reached is ordered. Repeatable:
    the random numbers are hashes of mix, key and seed.
    """
    plan = budgets(sizes, targets, total_tokens)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    docs = sizes.where((F.col("tokens") > 0) & F.col("source").isNotNull()).select(
        key, "source", "tokens", F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(1e-9)).alias("_w")
    )
    goal = plan.where(F.col("have") > 0).select("mix", "source", "have", "copies", "rest", "max_repeats")
    goal = goal.join(F.broadcast(_odds(docs, goal)), ["mix", "source"], "left")
    # One row for each target that has documents.
    rows = docs.join(F.broadcast(goal), "source").where((F.col("copies") > 0) | (F.col("rest") > 0))
    chance = F.least(F.greatest(F.coalesce("_scale", F.lit(1.0)) * F.col("_w"), F.lit(1e-12)), F.lit(1 - 1e-12))
    u = _uniform("mix", key, F.lit(seed))
    q = (u / (1 - u)) / (chance / (1 - chance))
    rows = rows.withColumn("_q", q).withColumn("_bin", F.floor(F.lit(BINS) * (F.col("_q") / (1 + F.col("_q")))).cast("int"))
    bins = rows.groupBy("mix", "source", "_bin").agg(F.sum("tokens").alias("_t"), F.first("rest").alias("rest"))
    run = F.sum("_t").over(Window.partitionBy("mix", "source").orderBy("_bin"))  # at most BINS rows a target
    bins = bins.withColumn("_before", run - F.col("_t"))
    cutoff = bins.where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_t") > F.col("rest"))).select(
        "mix", "source", F.col("_bin").alias("_cut"), "_before"
    )
    marked = rows.join(F.broadcast(cutoff), ["mix", "source"], "left")
    inside = F.col("_bin") == F.col("_cut")
    edge = marked.where(inside)
    before = F.sum("tokens").over(Window.partitionBy("mix", "source").orderBy("_q", key)) - F.col("tokens")
    # The document in which the target falls is taken if more than half of it is below.
    edge = edge.withColumn("_extra", (F.col("_before") + before + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    clear = marked.where(F.coalesce(~inside, F.lit(True))).withColumn(
        "_extra", F.when(F.col("_cut").isNull(), F.col("rest") > 0).otherwise(F.col("_bin") < F.col("_cut")).cast("int")
    )
    both = clear.unionByName(edge)
    copies = F.least(F.col("copies") + F.col("_extra"), F.col("max_repeats"))
    return both.withColumn("copies", copies).where(F.col("copies") > 0).select("mix", "source", key, F.col("copies").cast("int").alias("copies"), "tokens")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> DataFrame:
    """``mix, source, target_share, reached_share, tokens, short, documents, most_copies, max_repeats, reachable`` for every target."""
    plan = budgets(sizes, targets, total_tokens).select("mix", "source", "target_share", "max_repeats", "reachable", "short")
    got = drawn.groupBy("mix", "source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    all_ = F.sum("tokens").over(Window.partitionBy("mix"))
    out = plan.join(got, ["mix", "source"], "left").na.fill(0, ["tokens", "documents", "most_copies"])
    return out.withColumn("reached_share", F.coalesce(F.try_divide("tokens", all_), F.lit(0.0))).select(
        "mix", "source", "target_share", "reached_share", "tokens", "short", "documents", "most_copies", "max_repeats", "reachable"
    )
