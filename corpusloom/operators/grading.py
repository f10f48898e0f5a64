"""Detectors graded against planted defects."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from ..sources.config import Config
from .findings import Findings
from .signals import select

#: Keys a manifest may hold.
TOP_KEYS = {"defects"}
DEFECT_KEYS = {"id", "kinds", "snippets", "note"}
#: Snippets too short for a run of inner words, which every paragraph is searched for.
MOST_SHORT = 10_000
DEFECT = "case string, id string, kinds array<string>, snippets array<string>, note string"


class GradingError(ValueError):
    """A manifest or sweep that cannot be used."""


def discover(root: str | Path) -> list[Path]:
    """Folders below ``root`` with a manifest."""
    found = sorted(p.parent for p in Path(root).glob("*/manifest.json"))
    if not found:
        raise GradingError(f"no case with a manifest.json below {root}")
    return found


def read_manifest(case: str | Path) -> list[dict]:
    """The defects of a case; anything unknown, double or empty is an error."""
    path = Path(case) / "manifest.json"
    data = json.loads(path.read_text(encoding="utf-8"))
    if odd := sorted(set(data) - TOP_KEYS):
        raise GradingError(f"{path}: unknown keys {odd}")
    seen: set[str] = set()
    for d in data.get("defects", []):
        name = d.get("id")
        if odd := sorted(set(d) - DEFECT_KEYS):
            raise GradingError(f"{path}: defect {name}: unknown keys {odd}")
        if name in seen:
            raise GradingError(f"{path}: defect {name} occurs twice")
        for part in ("kinds", "snippets"):
            if not d.get(part):
                raise GradingError(f"{path}: defect {name} has no {part}")
        seen.add(name)
    return data.get("defects", [])


def defects_frame(spark: SparkSession, case: str, defects: list[dict]) -> DataFrame:
    return spark.createDataFrame([(case, d["id"], d["kinds"], d["snippets"], d.get("note", "")) for d in defects], DEFECT)


def resolve_snippets(paragraphs: DataFrame, snippets: DataFrame) -> DataFrame:
    """``snippet_id, paragraph_id`` wherever a paragraph contains a snippet, both normalised.

    ``snippets`` has ``snippet_id, snippet``. Containment has no equality to join
    on, so word runs give one: a snippet is tied to the fingerprint of its first
    complete words, and only paragraphs with the same run are searched. Snippets of
    fewer than three complete words are searched for in every paragraph; above
    ``MOST_SHORT`` of them this refuses. Null or blank snippets match nothing.
    """
    run = 3
    norm = snippets.select("snippet_id", T.norm_text(F.col("snippet")).alias("snip")).where(F.col("snip") != "")
    # The outer words may be cut inside a paragraph's word, so only inner ones are sure.
    inner = F.slice(F.split("snip", " "), 2, F.greatest(F.size(F.split("snip", " ")) - 2, F.lit(0)))
    # Both tables are read several times below, so they are worked out once.
    keyed = stored(norm.withColumn("_inner", inner), "snippets")
    long = keyed.where(F.size("_inner") >= run).withColumn("_key", F.xxhash64(F.array_join(F.slice("_inner", 1, run), " ")))
    short = keyed.where(F.size("_inner") < run)
    paras = stored(paragraphs.select(F.col("id").alias("paragraph_id"), T.norm_text(F.col("text")).alias("norm")), "normalised")
    w = F.split("norm", " ")
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - run + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, run), " "))
    )
    found = F.contains(F.col("norm"), F.col("snip"))
    # Ids and keys alone are exploded; a text is fetched once for each snippet it may hold.
    runs = paras.select("paragraph_id", F.explode(F.array_distinct(grams)).alias("_key"))
    tied = runs.join(_bounded(long.select("_key").distinct()), "_key", "left_semi").join(_bounded(long.select("snippet_id", "snip", "_key")), "_key")
    hits = tied.select("paragraph_id", "snippet_id", "snip").join(paras, "paragraph_id").where(found)
    short = short.select("snippet_id", "snip")
    n = short.count()
    if n == 0:
        return hits.select("snippet_id", "paragraph_id").distinct()
    if n > MOST_SHORT:
        raise GradingError(f"{n} snippets of fewer than five words; name at most {MOST_SHORT} of them, or longer ones")
    few = paras.join(F.broadcast(short), found)
    return hits.select("snippet_id", "paragraph_id").unionByName(few.select("snippet_id", "paragraph_id")).distinct()


def _bounded(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` marked for broadcast if they are counted to be no more than ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def resolve_defects(paragraphs: DataFrame, defects: DataFrame) -> DataFrame:
    """``case, id, paragraph_id``; a snippet that matches nothing is an error."""
    one = defects.select("case", "id", F.explode("snippets").alias("snippet")).withColumn(
        "snippet_id", F.concat_ws("\0", "case", "id", "snippet")
    )
    hits = resolve_snippets(paragraphs, one)
    if lost := one.join(hits, "snippet_id", "left_anti").select("case", "id", "snippet").head():
        raise GradingError(f"{lost['case']}/{lost['id']}: no paragraph contains {lost['snippet']!r}")
    return one.join(hits, "snippet_id").select("case", "id", "paragraph_id").distinct()


def finding_paragraphs(findings: Findings, chunks: DataFrame | None) -> DataFrame:
    """``signal, key, kind, paragraph_id``: members, chunks opened into their paragraphs."""
    m = findings.members
    direct = m.where(F.col("item") == "paragraph").select("signal", "key", F.col("item_id").alias("paragraph_id"))
    if chunks is not None:
        inside = chunks.select(F.col("id").alias("item_id"), F.explode("paragraph_ids").alias("paragraph_id"))
        direct = direct.unionByName(
            m.where(F.col("item") == "chunk").join(inside, "item_id").select("signal", "key", "paragraph_id")
        ).distinct()
    return direct.join(findings.rows.select("signal", "key", "kind"), ["signal", "key"])


def detects_frame(spark: SparkSession, max_tier: int, enabled: tuple[str, ...] = ()) -> DataFrame:
    """``signal, kind`` of the selected detectors: one row for each kind of defect they claim."""
    return spark.createDataFrame([(s.name, k) for s in select(max_tier, enabled) for k in s.detects], "signal string, kind string")


def score(found: DataFrame, defects: DataFrame, resolved: DataFrame, detects: DataFrame) -> DataFrame:
    """``signal, planted, found, tp, fp, missed, precision, recall``.

    ``found`` is ``finding_paragraphs``; a finding is true if it shares a kind and a
    paragraph with a defect, a defect is found if some finding does. Ratios over
    nothing are null. All joins are equalities on exploded (kind, paragraph).
    """
    kinds = defects.select("case", "id", F.explode("kinds").alias("kind")).distinct()
    claimed = kinds.join(F.broadcast(detects), "kind")  # the registry's few rows
    truth = claimed.join(resolved, ["case", "id"]).select("case", "id", "signal", "kind", "paragraph_id")
    pair = ["signal", "kind", "paragraph_id"]
    every = found.select("signal", "key").distinct()
    true = found.join(truth.select(*pair).distinct(), pair, "left_semi").select("signal", "key").distinct()
    hit = truth.join(found.select(*pair).distinct(), pair, "left_semi").select("case", "id", "signal").distinct()
    planted = claimed.select("case", "id", "signal").distinct()
    n = lambda df, name: df.groupBy("signal").agg(F.count(F.lit(1)).alias(name))
    out = detects.select("signal").distinct()
    for df, name in ((planted, "planted"), (hit, "found"), (every, "_all"), (true, "tp")):
        out = out.join(F.broadcast(n(df, name)), "signal", "left")  # one row a signal
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("planted", "found", "_all", "tp")}
    return out.withColumns(zero).select(
        "signal", "planted", "found", "tp", (F.col("_all") - F.col("tp")).alias("fp"),
        (F.col("planted") - F.col("found")).alias("missed"),
        F.try_divide("tp", "_all").alias("precision"), F.try_divide("found", "planted").alias("recall"),
    )


def defect_level(found: DataFrame, defects: DataFrame, resolved: DataFrame, detects: DataFrame) -> DataFrame:
    """``graded, found, missed, unclaimed`` in one row; unclaimed defects have no kind that is looked for."""
    kinds = defects.select("case", "id", F.explode("kinds").alias("kind")).distinct()
    graded = kinds.join(F.broadcast(detects.select("kind").distinct()), "kind", "left_semi")
    pair = ["kind", "paragraph_id"]
    hit = graded.join(resolved, ["case", "id"]).join(found.select(*pair).distinct(), pair, "left_semi")
    ids = lambda df: df.select("case", "id").distinct()
    state = (
        ids(defects)
        .join(ids(graded).withColumn("_g", F.lit(1)), ["case", "id"], "left")
        .join(ids(hit).withColumn("_h", F.lit(1)), ["case", "id"], "left")
    )
    return state.agg(
        F.count("_g").alias("graded"), F.count("_h").alias("found"),
        F.count_if(F.col("_g").isNotNull() & F.col("_h").isNull()).alias("missed"),
        F.count_if(F.col("_g").isNull()).alias("unclaimed"),
    )


def parse_sweep(spec: str) -> tuple[str, list[float]]:
    """``field=a:b[:s]`` (the end included) or ``field=v1,v2``; numeric settings only."""
    name, eq, rest = spec.partition("=")
    name = name.strip()
    numeric = {f.name: type(f.default) for f in fields(Config) if type(f.default) in (int, float)}
    if not eq or name not in numeric:
        raise GradingError(f"{spec!r}: expected field=..., with a field of {', '.join(sorted(numeric))}")
    kind = numeric[name]
    try:
        if ":" not in rest:
            return name, [kind(v) for v in rest.split(",")]
        bounds = [kind(v) for v in rest.split(":")]
    except ValueError as why:
        raise GradingError(f"{spec!r}: {why}") from None
    if len(bounds) == 2 and kind is int:
        bounds.append(1)
    if len(bounds) != 3 or bounds[2] <= 0:
        raise GradingError(f"{spec!r}: expected start:stop:step with a step above zero")
    start, stop, step = bounds
    count = int((stop - start + 1e-9) // step) + 1
    return name, [start + i * step if kind is int else round(start + i * step, 10) for i in range(max(count, 0))]


def threshold_sweep(scored: DataFrame, score: str, values: DataFrame) -> DataFrame:
    """``value, hits`` for each threshold: scored once, then counted by thresholds passed.

    A row is counted at the highest threshold it passes and a running sum over the
    few thresholds does the rest; the rows are never multiplied by the values.
    """
    steps = values.agg(F.array_sort(F.collect_set("value")).alias("_steps"))
    passed = F.size(F.filter("_steps", lambda v: v <= F.col(score)))
    counts = scored.join(F.broadcast(steps)).groupBy(passed.alias("_passed")).agg(F.count(F.lit(1)).alias("_n"))
    tally = counts.agg(F.map_from_entries(F.collect_list(F.struct("_passed", "_n"))).alias("_by"))
    exploded = steps.join(F.broadcast(tally)).select(F.posexplode("_steps").alias("pos", "value"), "_by")
    hits = F.aggregate(
        F.filter(F.map_entries("_by"), lambda e: e["key"] > F.col("pos")), F.lit(0).cast("bigint"), lambda s, e: s + e["value"]
    )
    return exploded.select("value", hits.alias("hits"))


def grade_case(corpus, case: str | Path, max_tier: int = 0) -> tuple[DataFrame, DataFrame]:
    """``score`` and ``defect_level`` of one case."""
    from .signals import run_all

    spark = corpus.docs.sparkSession
    defects = defects_frame(spark, Path(case).name, read_manifest(case))
    found = finding_paragraphs(run_all(corpus, corpus.config.merged(max_tier=max_tier)), corpus.chunks)
    resolved = resolve_defects(corpus.paragraphs, defects)
    detects = detects_frame(spark, max_tier)
    return score(found, defects, resolved, detects), defect_level(found, defects, resolved, detects)


def sweep_cases(make_corpus, cases: list[Path], spec: str, max_tier: int = 0) -> list[tuple[float, str, int, int, int]]:
    """``value, signal, tp, fp, found`` summed over cases; only signals that move.

    ``make_corpus(case, config)`` builds a corpus under the changed setting, since
    packing and thresholds alike may depend on it.
    """
    name, values = parse_sweep(spec)
    rows = []
    for v in values:
        sums: dict[str, list[int]] = {}
        for case in cases:
            corpus = make_corpus(case, name, v)
            for r in grade_case(corpus, case, max_tier)[0].collect():  # one row a signal
                s = sums.setdefault(r["signal"], [0, 0, 0])
                for i, c in enumerate(("tp", "fp", "found")):
                    s[i] += r[c]
        rows += [(v, s, *x) for s, x in sorted(sums.items())]
    moved = {s for s in {r[1] for r in rows} if len({r[2:] for r in rows if r[1] == s}) > 1}
    return [r for r in rows if r[1] in moved]


def table_lines(rows: list[dict], levels: list[dict]) -> list[str]:
    """The scores of each case, of all cases by signal, and one line over everything."""
    ratio = lambda a, b: f"{a / b:.2f}" if b else "-"
    line = lambda name, r: (
        f"  {name:<12} planted {r['planted']:>3}  found {r['found']:>3}  tp {r['tp']:>3}  fp {r['fp']:>3}  precision {ratio(r['tp'], r['tp'] + r['fp'])}  recall {ratio(r['found'], r['planted'])}"
    )
    total = lambda part: {k: sum(r[k] for r in part) for k in ("planted", "found", "tp", "fp")}
    out = []
    for level in levels:
        own = [r for r in rows if r["case"] == level["case"]]
        out += [level["case"], *[line(r["signal"], r) for r in own]]
        out.append("  defects: graded {graded}, found {found}, missed {missed}, unclaimed {unclaimed}".format(**level))
    out.append("all cases")
    out += [line(s, total([r for r in rows if r["signal"] == s])) for s in sorted({r["signal"] for r in rows})]
    sums = {k: sum(level[k] for level in levels) for k in ("graded", "found", "missed", "unclaimed")}
    return [*out, line("OVERALL", total(rows)), "  defects: graded {graded}, found {found}, missed {missed}, unclaimed {unclaimed}".format(**sums)]
