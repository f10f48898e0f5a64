"""A corpus graded against a written profile. No model is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.config import Profile
from .signals import boilerplate_groups, duplicate_groups, select

#: Verdicts.
PASS, FAIL, UNVERIFIED, NOT_GRADED = "PASS", "FAIL", "UNVERIFIED", "NOT GRADED"


def duplication(paragraphs: DataFrame, min_files: int = 3, enabled: tuple[str, ...] = ()) -> DataFrame:
    """``repeated, paragraphs, pct``: the share of paragraphs in any tier-0 repetition finding."""
    on = {s.name for s in select(0, enabled)}
    parts = []
    if "exact_dupes" in on:
        parts.append(duplicate_groups(paragraphs, min_files).select("fp", "copies"))
    if "boilerplate" in on:
        parts.append(boilerplate_groups(paragraphs, min_files).select("fp", "copies"))
    if not parts:
        hit = paragraphs.sparkSession.createDataFrame([], "fp string, copies bigint")
    else:
        hit = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
    repeated = hit.agg(F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("repeated"))
    total = paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"))
    # Two single rows.
    return repeated.join(F.broadcast(total)).withColumn(
        "pct", F.lit(100.0) * F.col("repeated") / F.greatest("paragraphs", F.lit(1))
    )


def staleness(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """``added, removed, changed``: distinct fingerprints on one side only."""
    a = current.select("fp").where(F.col("fp").isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = recorded.select("fp").where(F.col("fp").isNotNull()).distinct().withColumn("_b", F.lit(1))
    return a.join(b, "fp", "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("added"),
        F.count_if(F.col("_a").isNull()).alias("removed"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("changed"),
    )


def _check(order: int, verdict, requirement, note):
    return F.struct(
        F.lit(order).alias("ord"), verdict.alias("verdict"), F.lit(requirement).alias("requirement"), note.alias("note")
    )


def size_checks(profile: Profile, totals: DataFrame, repeated: DataFrame) -> DataFrame:
    """``ord, verdict, requirement, note`` for the limits a profile sets."""
    both = totals.select(F.col("words").alias("_words")).join(F.broadcast(repeated.select("pct")))
    checks = []
    verdict = lambda ok: F.when(ok, PASS).otherwise(FAIL)
    if profile.min_words is not None:
        checks.append(_check(
            0, verdict(F.col("_words") >= profile.min_words), f"at least {profile.min_words} words",
            F.format_string("%d words", "_words"),
        ))
    if profile.max_duplication_pct is not None:
        checks.append(_check(
            1, verdict(F.col("pct") <= profile.max_duplication_pct),
            f"repeated text at most {profile.max_duplication_pct:g}%",
            F.format_string("%s%% of paragraphs", F.bround("pct", 0).cast("bigint")),
        ))
    if not checks:
        return totals.sparkSession.createDataFrame([], "ord int, verdict string, requirement string, note string")
    return both.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def matches(want, have):
    """Either label contains the other, without regard to case and outer blanks."""
    w, h = F.lower(T.strip(want)), F.lower(T.strip(have))
    return F.contains(h, w) | F.contains(w, h)


def topic_checks(topics: DataFrame, tags: DataFrame, has_inventory: bool, stale: int) -> DataFrame:
    """``ord, topic, verdict, label`` for each required topic.

    ``topics`` has ``ord, topic``; ``tags`` has ``ord, label, status`` of the topic
    group. Without an inventory, or with one that no longer fits the text, nothing
    is graded; a confirmed match passes, a proposed one is unverified; with nothing
    confirmed at all nothing is graded; else it fails. The first match by tag order
    stands. Topics and tags are lists that people keep, so this nested loop is small;
    a topic that is blank is refused when the profile is read.
    """
    t = tags.select(F.col("ord").alias("tag_ord"), "label", "status")
    hit = topics.join(F.broadcast(t), matches(F.col("topic"), F.col("label")), "left")
    first = lambda s: F.min(F.when(F.col("status") == s, F.struct("tag_ord", "label")))
    by = hit.groupBy("ord", "topic").agg(first("confirmed").alias("sure"), first("proposed").alias("maybe"))
    any_sure = t.agg(F.count_if(F.col("status") == "confirmed").alias("_sure"))
    verdict = (
        F.when(F.lit(not has_inventory or stale > 0), NOT_GRADED)
        .when(F.col("sure").isNotNull(), PASS)
        .when(F.col("maybe").isNotNull(), UNVERIFIED)
        .when(F.col("_sure") == 0, NOT_GRADED)
        .otherwise(FAIL)
    )
    return by.join(F.broadcast(any_sure)).select(
        "ord", "topic", verdict.alias("verdict"), F.coalesce("sure.label", "maybe.label").alias("label")
    )


def overall(checks: DataFrame) -> DataFrame:
    """``verdict, waiting``: FAIL if any failed, else INCOMPLETE if any waits, else PASS.

    An empty list of checks passes.
    """
    waiting = F.count_if(F.col("verdict").isin(UNVERIFIED, NOT_GRADED))
    verdict = F.when(F.count_if(F.col("verdict") == FAIL) > 0, FAIL).when(waiting > 0, "INCOMPLETE").otherwise(PASS)
    return checks.agg(verdict.alias("verdict"), waiting.alias("waiting"))


def topic_lines(clusters: DataFrame, tags: DataFrame) -> DataFrame:
    """``cluster_id, label, standing`` with the tag that has the cluster's key, the last one if several.

    Confirmed tag before proposed tag before the cluster's own label before unnamed.
    """
    last = tags.where(F.col("key") != "").groupBy("key").agg(F.max(F.struct("ord", "label", "status")).alias("t"))
    use = F.col("t.status").isin("confirmed", "proposed")
    own = F.coalesce("label_proposed", F.lit(""))
    return clusters.join(last, clusters["cluster_id"] == last["key"], "left").select(
        "cluster_id",
        F.when(use, F.col("t.label")).when(own != "", own).otherwise("(unnamed)").alias("label"),
        F.when(use, F.col("t.status")).when(own != "", "proposed").otherwise("unnamed").alias("standing"),
    )


def page_lines(intended_use: str, overall_row, checks: list) -> list[str]:
    """The verdict page as text."""
    verdict = overall_row["verdict"] + (f" ({overall_row['waiting']} waiting)" if overall_row["verdict"] == "INCOMPLETE" else "")
    return [f"VERDICT: {verdict}", f"intended use: {intended_use or '-'}", ""] + [
        f"{c['verdict']:<11} {c['requirement']}: {c['note']}" for c in checks
    ]
