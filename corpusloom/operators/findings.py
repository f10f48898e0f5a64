"""The shape of a finding, and what is done with many of them.

A finding about a group names the group by ``key`` (fingerprint or chunk id) and
carries counts; which paragraphs and sources belong to it is a second, long table
``members``. So a footer that occurs in a third of all files stays a third of the
rows of that table and is never gathered into one array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import sentence_quote

#: Severities by rank, and what each kind of evidence is worth.
SEVERITIES = ("high", "medium", "low", "info")
CONFIDENCE = {
    "ablation": "measured by removing it",
    "real-queries": "measured on real queries",
    "structural": "read off the text itself",
    "synthetic": "measured on made-up queries",
}

FINDING = (
    "signal string, kind string, key string, severity string, evidence string, message string, advice string, "
    "fix_mode string, n_items bigint, n_sources bigint, detail map<string,string>"
)
MEMBER = "signal string, key string, item string, item_id bigint, source string"


@dataclass(frozen=True)
class Findings:
    """``rows``: one for each finding. ``members``: the paragraphs or chunks behind each."""

    rows: DataFrame
    members: DataFrame

    def with_lists(self) -> DataFrame:
        """Rows with ``paragraph_ids, chunk_ids, sources`` as arrays.

        For reports over findings of known size: the arrays hold every member.
        """
        ids = lambda item: F.array_sort(F.collect_set(F.when(F.col("item") == item, F.col("item_id"))))
        lists = self.members.groupBy("signal", "key").agg(
            ids("paragraph").alias("paragraph_ids"),
            ids("chunk").alias("chunk_ids"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        return self.rows.join(lists, ["signal", "key"], "left")


def severity_rank(severity: Column) -> Column:
    """0 for high to 3 for info; null for anything else."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def confidence(evidence: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, said in CONFIDENCE.items():
        text = F.when(evidence == name, F.lit(said)).otherwise(text)
    return text


def downgrade(rows: DataFrame, when: Column, severity: str, advice: str) -> DataFrame:
    """Findings that meet ``when`` with another severity and advice; none is dropped."""
    if severity not in SEVERITIES:
        raise ValueError(f"no such severity: {severity}")
    hit = F.coalesce(when, F.lit(False))
    return rows.withColumn("severity", F.when(hit, F.lit(severity)).otherwise(F.col("severity"))).withColumn(
        "advice", F.when(hit, F.lit(advice)).otherwise(F.col("advice"))
    )


def union_all(parts: list[Findings]) -> Findings:
    rows, members = parts[0].rows, parts[0].members
    for p in parts[1:]:
        rows, members = rows.unionByName(p.rows), members.unionByName(p.members)
    return Findings(rows, members)


def order_columns() -> list[Column]:
    """Report order: severity, signal, message; ties by key."""
    return [severity_rank(F.col("severity")), F.col("signal"), F.col("message"), F.col("key")]


def ranked(findings: Findings) -> DataFrame:
    return findings.rows.orderBy(*order_columns())


def top_per_signal(findings: Findings, n: int = 4) -> DataFrame:
    """The first ``n`` findings of each (evidence, signal), with ``shown`` and ``more``.

    A row-number filter is pushed into a top-n per partition before the shuffle, so
    a signal with most of the findings is cut down where it was made.
    """
    w = Window.partitionBy("evidence", "signal")
    top = (
        findings.rows.withColumn("shown", F.row_number().over(w.orderBy(*order_columns())))
        .where(F.col("shown") <= n)
    )
    total = findings.rows.groupBy("evidence", "signal").agg(F.count(F.lit(1)).alias("_all"))
    # One row for each signal: bounded by the registry.
    return top.join(F.broadcast(total), ["evidence", "signal"]).withColumn(
        "more", F.greatest(F.col("_all") - n, F.lit(0))
    ).drop("_all")


def summary(findings: Findings) -> DataFrame:
    """``severity, findings`` for every severity that occurs."""
    return findings.rows.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def flagged_paragraphs(findings: Findings) -> DataFrame:
    """``paragraph_id`` of every paragraph in a high or medium finding; chunks count nothing."""
    grave = findings.rows.where(F.col("severity").isin("high", "medium")).select("signal", "key")
    return (
        findings.members.where(F.col("item") == "paragraph")
        .join(grave, ["signal", "key"], "left_semi")
        .select(F.col("item_id").alias("paragraph_id"))
        .distinct()
    )


#: What a kind of finding means for someone who does not know the terms; ``%s`` is the text it is about.
PLAIN = {
    "boilerplate": "Many pages carry this same text, so a search may bring it up instead of an answer: %s",
    "exact_duplicate": "This text is there more than once: %s",
    "near_duplicate": "Two parts say nearly the same in other words: %s",
    "length_outlier": "This part is too short or too long to be found well: %s",
    "generic": "This part could stand in any of the documents: %s",
}


def in_plain_words(rows: DataFrame) -> DataFrame:
    """Adds ``plain``: what the finding means, with the text it quotes. A kind without words of its own keeps its message."""
    said = F.create_map(*[F.lit(x) for kv in PLAIN.items() for x in kv])[F.col("kind")]
    return rows.withColumn("plain", F.coalesce(F.replace(said, F.lit("%s"), sentence_quote(F.col("message"))), F.col("message")))
