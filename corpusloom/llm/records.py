"""Records that differ only in formatting, by hashing their structure bottom-up.

A paragraph is a leaf, or a record of ``field: value`` items in some notation: a sign,
a tab, a bar or a dash between field and value; lines, bullets, bars, semicolons, commas,
slashes, ampersands or full stops between items; tags, attributes or JSON. Leaves lose letter case and all but letters
and digits. The children of a record have no order, so their digests are sorted
before the parent is hashed; nested objects are unordered nodes in turn and JSON
arrays ordered ones. Equal roots make a group, and the canonical forms, compared in
full, confirm it.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import stored

#: Fixed value: from so many items on a paragraph of nothing else is a record.
LEAST_ITEMS = 4
_DROP = re.compile(r"[\W_]+")
_LEAD = re.compile(r"\W*(?:\d{1,3}[.)]\s+\W*)?")
_LETTER = re.compile(r"[^\W\d_]")
#: What stands between a field and its value: a sign; a tab, a bar or a dash.
_BETWEEN = (re.compile(r"=>|:=|->|→|[:=]"), re.compile(r"\t+"), re.compile(r"\|"), re.compile(r"\s[-–—]\s"))
#: What stands between items. A value may hold any sign but the one chosen.
_LINES = re.compile(r"[\n\r\u2028\u2029\v\f\x85]+")
_SPLITS = (
    re.compile(r"[\n\r\u2028\u2029\v\f\x85|;]+"), _LINES, re.compile(r"\|"), re.compile(r";"), re.compile(r"\t+"), re.compile(r","),
    re.compile(r"&(?:amp;)?"), re.compile(r"\s/\s"), re.compile(r"[•·▪‣]"), re.compile(r"(?<=\S)\.(?=\s|$)"),
)
_TAGS = re.compile(r"<(?P<field>[^\W\d_][\w.:-]*)(?:\s[^<>]*)?>(?P<value>[^<>]*)</(?P=field)\s*>")
_ATTRIBUTES = re.compile(r"(?P<field>[^\W\d_][\w.:-]*)\s*=\s*(?P<quote>[\"'])(?P<value>.*?)(?P=quote)", re.S)


def reduce_text(text: str) -> str:
    """Lower case, letters and digits only."""
    return _DROP.sub("", text.lower())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _tree(value) -> tuple[str, str]:
    """Digest and canonical form of a JSON value, children first."""
    if isinstance(value, dict):
        kids = sorted(_item(k, v) for k, v in value.items())
        return _digest("{" + "".join(d for d, _ in kids) + "}"), "{" + ",".join(c for _, c in kids) + "}"
    if isinstance(value, list):
        kids = [_tree(v) for v in value]
        return _digest("[" + "".join(d for d, _ in kids) + "]"), "[" + ",".join(c for _, c in kids) + "]"
    leaf = reduce_text("" if value is None else str(value))
    return _digest(leaf), leaf


def _item(field: str, value) -> tuple[str, str]:
    if isinstance(value, (dict, list)):
        d, c = _tree(value)
        name = reduce_text(str(field))
        return _digest(name + d), name + c
    return _tree(f"{field} {'' if value is None else value}")


def _pair(item: str, between: re.Pattern) -> tuple[str, str] | None:
    """Field and value of an item, in one pass over it; None if it has none."""
    start = _LEAD.match(item).end()
    at = between.search(item, start)
    if at is None or not _LETTER.search(item, start, at.start()):
        return None
    field, value = item[start : at.start()], item[at.end() :]
    # A tab, bar or dash parts an item only if it is the only one; else it is white space, a table or prose.
    if between is not _BETWEEN[0] and between.search(value.rstrip().removesuffix("|")):
        return None
    return field, value


def _items(text: str) -> list[tuple[str, str]] | None:
    """The items of a record; None if the text is anything else."""
    bare = text.strip().strip("﻿​‌‍⁠")
    if bare.startswith("{") and bare.rstrip(" ,;.!").endswith("}"):
        try:
            pairs = json.loads(bare.rstrip(" ,;.!"), object_pairs_hook=lambda p: p)
        except (ValueError, RecursionError):
            pairs = None
        if pairs is not None:
            return [_item(k, _plain(v)) for k, v in pairs]
        bare = bare.rstrip(" ,;.!")[1:-1]
    if bare.startswith("<"):
        return _marked_up(bare)
    signs = any(c in bare for c in ":=→>")
    for split in _SPLITS:
        parts = [p for p in split.split(bare) if _DROP.sub("", p)]
        if len(parts) < LEAST_ITEMS:
            continue
        for i, between in enumerate(_BETWEEN):
            # Tabs, bars and dashes part field and value only where each item is a line.
            if (i == 0 and not signs) or (i > 0 and split is not _LINES):
                continue
            found = []
            for p in parts:
                if (pair := _pair(p, between)) is None:
                    break
                found.append(pair)
            # A field may be left empty, but not most of them.
            if len(found) == len(parts) and 2 * sum(bool(_DROP.sub("", v)) for _, v in found) > len(found):
                return [_item(f, v) for f, v in found]
    return None


def _marked_up(bare: str) -> list[tuple[str, str]] | None:
    """Items of a record in tags, with or without one around all, or in the attributes of one tag."""
    one = re.fullmatch(r"<\w[\w.:-]*\s+([^<>]*?)/?>(?:\s*</\w[\w.:-]*>)?", bare, re.S)
    if one:
        found = list(_ATTRIBUTES.finditer(one[1]))
        return [_item(m["field"], m["value"]) for m in found] if found and not _ATTRIBUTES.sub("", one[1]).strip() else None
    around = re.fullmatch(r"<(\w[\w.:-]*)[^<>]*>(.*)</\1\s*>", bare, re.S)
    for inner in (bare, around[2] if around else ""):
        found = list(_TAGS.finditer(inner))
        if found and not _TAGS.sub("", inner).strip():
            return [_item(m["field"], m["value"]) for m in found]
    return None


def _plain(value):
    """Pairs back to objects; a repeated key keeps both values."""
    if isinstance(value, list) and value and all(isinstance(x, tuple) for x in value):
        out: dict = {}
        for k, v in value:
            while k in out:
                k += "\0"
            out[k] = _plain(v)
        return out
    return [_plain(v) for v in value] if isinstance(value, list) else value


def record_form(text: str | None) -> str | None:
    """``digest:canonical form`` of a record; None for any other text."""
    items = _items(text) if text else None
    if items is None or len(items) < LEAST_ITEMS:
        return None
    items.sort()
    return _digest("{" + "".join(d for d, _ in items) + "}") + ":" + "{" + ",".join(c for _, c in items) + "}"


@F.pandas_udf(StringType())
def _record_form(texts: pd.Series) -> pd.Series:
    return texts.map(record_form, na_action="ignore")


def reduced(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def with_roots(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``root`` and ``canon``, both null for a null text.

    Only texts with enough separators to be records go through Python; every other
    one is a leaf and stays in the JVM. Record roots start with ``r``, leaf roots
    with ``t``, so the two kinds never meet.
    """
    t = F.col(text)
    marks = F.length(t) - F.length(F.translate(t, ":=\t|<→–—", ""))
    dashes = F.length(t) - F.length(F.replace(t, F.lit(" - "), F.lit("  ")))
    form = rows.withColumn("_form", _record_form(F.when(marks + dashes >= LEAST_ITEMS, t)))
    leaf = reduced(t)
    return form.withColumns({
        "root": F.when(F.col("_form").isNotNull(), F.concat(F.lit("r"), F.split_part("_form", F.lit(":"), F.lit(1)))).otherwise(
            F.concat(F.lit("t"), F.substring(F.sha2(leaf, 256), 1, 32))
        ),
        "canon": F.coalesce(F.substring("_form", 34, 1 << 30), leaf),
    }).drop("_form")


#: Rows from which a group is crowded, so that its rows are not shuffled, and groups that are broadcast for it at most.
HOT, HOT_GROUPS = 100_000, 10_000


def equal_groups(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, keep``: every row that shares its form with another, and the smallest key of the group.

    ``key`` is unique. Null texts are in no group; texts without any letter or digit
    all equal one another. Digests find the groups: they are counted where they lie before
    anything wide moves, and only rows of groups of two or more bring their canonical form.
    Rows of a group of very many, which may be a third of all, are not shuffled at all.
    """
    formed = with_roots(rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    formed = stored(formed.select("key", "root", "canon"), "record-forms")
    twice = stored(formed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "record-groups")
    hot = twice.where(F.col("n") > HOT).select("root")
    split = 0 < hot.count() <= HOT_GROUPS
    if split:
        mine = formed.join(F.broadcast(hot), "root", "left_semi")
        held = formed.join(F.broadcast(hot), "root", "left_anti").join(twice.where(F.col("n") <= HOT).select("root"), "root", "left_semi")
    else:
        held = formed.join(twice.select("root"), "root", "left_semi")
    # Grouping by the canonical form itself is the full comparison.
    group = lambda df: df.groupBy("root", "canon").agg(F.min("key").alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    out = held.join(group(held), ["root", "canon"]).select(F.col("key").alias(key), "keep")
    if split:
        few = stored(group(mine), "crowded-groups")
        few = F.broadcast(few) if few.count() <= HOT_GROUPS else few
        out = out.unionByName(mine.join(few, ["root", "canon"]).select(F.col("key").alias(key), "keep"))
    return out


def collapsed(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, copies``: one row for each distinct form, with the number of rows that have it."""
    formed = with_roots(rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    return formed.groupBy("root", "canon").agg(F.min("key").alias(key), F.count(F.lit(1)).alias("copies")).select(key, "copies")
