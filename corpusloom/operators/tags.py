"""Tags: what a model proposed and a person decided."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topics import load_json, save_json

#: Fixed values.
GROUPS = ("data_type", "use_case", "topic")
STATUSES = ("proposed", "confirmed", "rejected")
SCHEMA = "`group` string, label string, reasoning string, status string, source string, evidence array<string>, key string"


@dataclass(frozen=True)
class Tag:
    group: str
    label: str
    reasoning: str = ""
    status: str = "proposed"
    source: str = "model"
    evidence: tuple[str, ...] = ()
    key: str = ""


@dataclass
class TagSet:
    """The small table a person edits, kept as JSON."""

    tags: list[Tag] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> TagSet:
        return cls([Tag(**{**t, "evidence": tuple(t.get("evidence", ()))}) for t in load_json(path) or []])

    def save(self, path: str | Path) -> None:
        save_json(path, [asdict(t) for t in self.tags])

    def group(self, name: str) -> list[Tag]:
        return [t for t in self.tags if t.group == name]

    def confirmed(self) -> list[Tag]:
        return [t for t in self.tags if t.status == "confirmed"]

    def add(self, tag: Tag) -> None:
        self.tags.append(tag)

    def decide(self, tag: Tag, answer: str, label: str = "") -> Tag:
        """``y`` confirms, ``n`` rejects, ``e`` confirms under another label, ``s`` leaves it."""
        change = {
            "y": {"status": "confirmed"},
            "n": {"status": "rejected"},
            "e": {"status": "confirmed", "label": label, "source": "user"},
            "s": {},
        }[answer]
        new = replace(tag, **change)
        self.tags[self.tags.index(tag)] = new
        return new

    def replace_proposals(self, new: list[Tag], groups: tuple[str, ...]) -> None:
        """Old proposals of ``groups`` make way for ``new``; what was decided stays and is not proposed again."""
        if odd := sorted({t.group for t in new} - set(groups)):
            raise ValueError(f"proposals outside {groups}: {odd}")
        kept = [t for t in self.tags if t.group not in groups or t.status != "proposed"]
        said = {(t.group, t.label.lower()) for t in kept} | {(t.group, "\0" + t.key) for t in kept if t.key}
        self.tags = kept + [
            t for t in new if (t.group, t.label.lower()) not in said and not (t.key and (t.group, "\0" + t.key) in said)
        ]

    def context(self) -> str:
        """Confirmed tags as lines for a prompt; nothing that is only proposed."""
        lines = [f"{g}: {', '.join(t.label for t in self.confirmed() if t.group == g)}" for g in GROUPS]
        return "\n".join(x for x in lines if not x.endswith(": "))

    def frame(self, spark) -> DataFrame:
        rows = [(t.group, t.label, t.reasoning, t.status, t.source, list(t.evidence), t.key) for t in self.tags]
        return spark.createDataFrame(rows, SCHEMA)


def merge_proposals(current: DataFrame, new: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``TagSet.replace_proposals`` on tables: a left anti join on (group, lower label), and on key."""
    kept = current.where(~F.col("group").isin(*groups) | (F.col("status") != "proposed"))
    low = F.lower("label").alias("_low")
    fresh = new.withColumn("_low", F.lower("label")).join(kept.select("group", low).distinct(), ["group", "_low"], "left_anti").drop("_low")
    keyed = kept.where(F.col("key") != "").select("group", "key").distinct()
    return kept.unionByName(fresh.join(keyed, ["group", "key"], "left_anti").select(kept.columns))
