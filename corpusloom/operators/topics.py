"""Topics: agglomerative clustering of paragraph vectors, coverage, and the snapshot.

Centroid linkage with renormalised means is sequential: two merged centroids may
be closer than any two members were, so neither components nor reciprocal merges
give the same result. It is one kernel with a stated limit on its input and fails
above it.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Most vectors the agglomerative kernel takes: its similarity matrix is then 200 MB.
MOST_VECTORS = 5000
#: Fixed value: below so many words a paragraph is not embedded.
LEAST_WORDS = 10


class TooManyVectors(ValueError):
    """More vectors than the sequential kernel may hold."""


def merge_closest(x: np.ndarray, least: float, most: int) -> list[list[int]]:
    """Clusters of row numbers, each in merge order; survivors in order, later merges behind.

    The closest pair of centroids is merged until the best similarity is under
    ``least``; then, if more than ``most`` clusters have several members, those
    alone are merged on whatever their similarity. Ties go to the first pair by rows.
    """
    x = x.astype(np.float64)

    def run(groups: list[list[int]], enough) -> list[list[int]]:
        # One matrix that stays in place: a merged cluster takes over a slot of its parts, the
        # other is dead. ``rank`` keeps the order of rows, in which later merges lie behind.
        n = len(groups)
        groups, rank, alive, count = list(groups), np.arange(n), np.ones(n, bool), n
        c = np.array([V.unit(x[g].mean(0, keepdims=True))[0] for g in groups])
        s = c @ c.T
        np.fill_diagonal(s, -np.inf)
        best = s.max(1) if n else np.zeros(0)
        while count > 1:
            top = best.max()
            if enough(count, top):
                break
            rows = np.nonzero(best == top)[0]
            i = rows[rank[rows].argmin()]
            cols = np.nonzero(s[i] == top)[0]
            j = cols[rank[cols].argmin()]
            groups[i] = groups[i] + groups[j]
            centre = V.unit(x[groups[i]].mean(0, keepdims=True))[0]
            # Rows whose best was one of the two parts look again; others have one more to compare.
            lost = (best == s[:, i]) | (best == s[:, j])
            alive[j], rank[i], c[i] = False, n + len(groups) - count, centre
            count -= 1
            s[j] = s[:, j] = best[j] = -np.inf
            new = np.where(alive, c @ centre, -np.inf)
            new[i] = -np.inf
            s[i] = s[:, i] = new
            best = np.where(alive, np.maximum(best, new), -np.inf)
            again = np.nonzero(lost & alive)[0]
            best[again] = s[again].max(1)
            best[i] = new.max()
        left = np.nonzero(alive)[0]
        return [groups[k] for k in left[np.argsort(rank[left])]]

    if not len(x):
        return []
    groups = run([[i] for i in range(len(x))], lambda n, best: best < least)
    several = [g for g in groups if len(g) > 1]
    if len(several) > most:
        several = run(several, lambda n, best: n <= most)
    return several + [g for g in groups if len(g) == 1]


def agglomerate(vectors: DataFrame, key: str = "id", vec: str = "vec", least: float = 0.70, most: int = 12) -> DataFrame:
    """``cluster, ord, key`` of usable vectors; singletons have a null ``cluster``.

    ``cluster`` numbers the clusters in merge order, ``ord`` the members in theirs.
    Rows are taken in order of ``key``. Raises ``TooManyVectors`` above
    ``MOST_VECTORS`` rows, before anything is gathered.
    """
    fit = vectors.where(V.usable(F.col(vec))).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    if (n := fit.count()) > MOST_VECTORS:
        raise TooManyVectors(f"{n} vectors; the sequential kernel takes {MOST_VECTORS}")
    kind = dict(fit.dtypes)["key"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x = V.unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
        keys = pdf["key"].to_numpy()
        rows = [
            (c if len(g) > 1 else None, o, keys[m]) for c, g in enumerate(merge_closest(x, least, most)) for o, m in enumerate(g)
        ]
        out = pd.DataFrame(rows, columns=["cluster", "ord", "key"])
        return out.assign(cluster=out["cluster"].astype("Int64"))

    return fit.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(kernel, f"cluster bigint, ord bigint, key {kind}")


def cluster_ids(members: DataFrame) -> DataFrame:
    """``cluster, cluster_id``: 8 hex digits over the sorted fingerprints, repeats kept."""
    fps = F.array_join(F.array_sort(F.collect_list("fp")), "")
    return members.groupBy("cluster").agg(F.substring(F.sha2(fps, 256), 1, 8).alias("cluster_id"))


def coverage(members: DataFrame, total_words: DataFrame) -> DataFrame:
    """``cluster, paragraphs, words, pct_words, n_sources`` by words, most first.

    ``total_words`` has one row ``total``. A corpus without words gives 0 per cent.
    """
    by = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.coalesce(F.sum("words"), F.lit(0)).cast("bigint").alias("words"),
        F.countDistinct("source").alias("n_sources"),
    )
    pct = F.bround(F.lit(100.0) * F.col("words") / F.greatest("total", F.lit(1)), 1)
    return (
        by.join(F.broadcast(total_words))  # one row
        .withColumn("pct_words", pct)
        .drop("total")
        .orderBy(F.desc("words"), "cluster")
    )


def inventory(corpus) -> tuple[DataFrame, DataFrame]:
    """Members ``cluster, ord, id, source, fp, words, text`` and everything unclustered.

    Unclustered are singletons, paragraphs under ten words and paragraphs whose
    vector is unusable: together with the members they are all paragraphs.
    """
    cfg = corpus.config
    held = corpus.paragraphs.where(F.col("words") >= LEAST_WORDS).join(corpus.paragraph_vectors, "fp")
    found = agglomerate(held, "id", "vec", cfg.topic_similarity, cfg.max_topics).where(F.col("cluster").isNotNull())
    members = found.withColumnRenamed("key", "id").join(corpus.paragraphs, "id")
    return members, corpus.paragraphs.join(found.select(F.col("key").alias("id")), "id", "left_anti")


def typical_members(corpus) -> DataFrame:
    """Members of ``inventory`` with ``score``, their cosine to the centre of their cluster."""
    members, _ = inventory(corpus)
    held = members.join(corpus.paragraph_vectors, "fp").withColumn("u", V.normalise(F.col("vec")))
    means = held.select("cluster", F.posexplode("u")).groupBy("cluster", "pos").agg(F.avg("col").alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    centres = means.groupBy("cluster").agg(V.normalise(mean).alias("centre"))
    return held.join(centres, "cluster").withColumn("score", V.dot(F.col("u"), F.col("centre"))).drop("u", "centre", "vec")


def snapshot(corpus, names: dict[str, str] | None = None, created: str | None = None, chat_model: str = "") -> dict:
    """The inventory as one document. Gathers fingerprints, at most ``MOST_VECTORS`` of them clustered."""
    members, rest = inventory(corpus)
    members = members.cache()
    names, total = names or {}, corpus.totals().first()
    words = members.sparkSession.createDataFrame([(total["words"],)], "total bigint")
    ids = {r["cluster"]: r["cluster_id"] for r in cluster_ids(members).collect()}
    clusters = []
    for c in coverage(members, words).collect():
        own = members.where(F.col("cluster") == c["cluster"])
        sources = own.groupBy("source").count().orderBy(F.desc("count"), "source").collect()
        rows = own.orderBy("ord").select("fp", T.preview(F.col("text"), 120).alias("p")).collect()
        clusters.append({
            "id": ids[c["cluster"]], "label_proposed": names.get(ids[c["cluster"]], ""), "paragraphs": c["paragraphs"],
            "words": c["words"], "pct_words": c["pct_words"], "sources": {s["source"]: s["count"] for s in sources},
            "paragraph_fps": [r["fp"] for r in rows], "representative": rows[0]["p"],
        })
    loose = rest.select("fp", "words").collect()
    loose_words = sum(r["words"] for r in loose)
    return {
        "created": created or time.strftime("%Y-%m-%d %H:%M"),
        "chat_model": chat_model, "embed_model": corpus.embedder.name,
        "params": {"topic_similarity": corpus.config.topic_similarity, "max_topics": corpus.config.max_topics},
        "totals": {"files": total["files"], "paragraphs": total["paragraphs"], "words": total["words"]},
        "clusters": clusters,
        "unclustered": {
            "paragraphs": len(loose), "words": loose_words,
            "pct_words": round(100 * loose_words / max(total["words"], 1), 1), "paragraph_fps": [r["fp"] for r in loose],
        },
    }


def save_json(path: str | Path, data) -> None:
    """Written beside and renamed, so that a reader never sees half a file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(part, path)


def load_json(path: str | Path):
    """None where there is no such file."""
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.is_file() else None


def inventory_lines(data: dict) -> list[str]:
    """The snapshot as text."""
    t = data["totals"]
    out = [f"{t['paragraphs']} paragraphs, {t['words']} words in {t['files']} files", ""]
    for c in data["clusters"]:
        out.append(f"[{c['id']}] {c['label_proposed'] or '(unnamed)'}: {c['paragraphs']} paragraphs, {c['words']} words, {c['pct_words']}%")
        out += [f"    {n}x {s}" for s, n in c["sources"].items()]
        out.append(f"    e.g. \"{c['representative']}\"")
    u = data["unclustered"]
    out.append(f"ungrouped: {u['paragraphs']} paragraphs, {u['words']} words, {u['pct_words']}%")
    return out
