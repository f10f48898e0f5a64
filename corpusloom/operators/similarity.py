"""Exact cosine search and join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stored


def top_k(vectors: DataFrame, query: list[float], k: int = 5, vec: str = "vec") -> DataFrame:
    """The ``k`` rows with the highest cosine to ``query``, with ``score``.

    Every task keeps its own best ``k``. An unusable query gives no rows; unusable
    vectors and those of another length never match.
    """
    q = np.asarray(query, float)
    if not len(q) or not np.isfinite(q).all() or not q.any():
        return vectors.withColumn("score", F.lit(0.0)).limit(0)
    q = q / np.linalg.norm(q)
    lit = F.array(*[F.lit(float(x)) for x in q])
    fit = vectors.where(V.usable(F.col(vec), len(q)))
    return fit.withColumn("score", V.dot(V.normalise(F.col(vec)), lit)).orderBy(F.desc("score"), *[
        c for c, t in vectors.dtypes if t in ("bigint", "int", "string")
    ]).limit(k)


def top_k_of_many(vectors: DataFrame, queries: DataFrame, key: str, k: int = 5, vec: str = "vec", block: int = 16_384) -> DataFrame:
    """``query, key, rank, score``: for each row of ``queries`` the ``k`` rows of ``vectors`` with the highest cosine. Exact.

    Both have unique ``key`` and ``vec``; a query that is among the rows finds itself.
    Rows and queries are cut into blocks that meet in one task each, which keeps the best
    ``k`` of its rows for each query; ties go to the smaller key. Unusable vectors never
    match, and ask nothing.
    """
    fit = lambda df: stored(df.where(V.usable(F.col(vec))).select(F.col(key).alias("key"), F.col(vec).alias("vec")), "units")
    rows, asks = fit(vectors), fit(queries)
    kind = dict(rows.dtypes)["key"]
    nr, nq = (max(1, math.ceil(df.count() / block)) for df in (rows, asks))
    cut_ = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows.select("key", "vec", F.lit(False).alias("ask"), cut_(nr).alias("i"), every(nq).alias("j")).unionByName(
        asks.select("key", "vec", F.lit(True).alias("ask"), every(nr).alias("i"), cut_(nq).alias("j"))
    )

    def meet(t: pa.Table) -> pa.Table:
        ask = np.array(t.column("ask").to_pylist(), bool)
        keys, x = np.array(t.column("key").to_pylist()), V.matrix(t.column("vec"), np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        q, r, out = np.nonzero(ask)[0], np.nonzero(~ask)[0], []
        for at in range(0, len(q) if len(r) else 0, 512):
            part = q[at : at + 512]
            s = x[part] @ x[r].T
            least = np.partition(s, max(len(r) - k, 0), 1)[:, max(len(r) - k, 0)]
            i, j = np.nonzero(s >= least[:, None])
            order = np.lexsort((keys[r[j]], -s[i, j], i))
            i, j = i[order], j[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((keys[part[i[top]]], keys[r[j[top]]], s[i[top], j[top]]))
        cat = lambda c: np.concatenate([o[c] for o in out]).tolist() if out else []
        at = t.column("key").type
        return pa.table({"query": pa.array(cat(0), at), "key": pa.array(cat(1), at), "score": pa.array(cat(2), pa.float64())})

    found = both.groupBy("i", "j").applyInArrow(meet, f"query {kind}, key {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")).alias("rank")
    return found.select("query", "key", rank, "score").where(F.col("rank") <= k)


def classes(vectors: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Identical vectors as one class.

    Gives ``(class_id, vec)`` with the smallest key of each class, and the
    membership ``(key, class_id)``. Unusable vectors belong to no class. Vectors
    that differ in length but not in direction are different here.
    """
    fit = vectors.where(V.usable(F.col(vec))).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    reps = fit.groupBy("vec").agg(F.min("key").alias("class_id"))
    members = fit.join(reps, "vec").select("key", "class_id")
    return reps.select("class_id", "vec"), members


def _far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the rows, each the farthest from those before it."""
    at, near = [0], x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    return x[at]


def cosine_pairs(reps: DataFrame, key: str, vec: str, threshold: float, block: int = 2000, most_cells: int = 4096) -> DataFrame:
    """``a, b, score`` for every pair ``a < b`` with a cosine of at least ``threshold``. Exact.

    Angles obey the triangle inequality. Rows go to the cell of their nearest
    pivot; a row is also a guest in each cell of lower number whose pivot is at most
    twice the threshold's angle further away than its own. Two rows within the
    threshold then meet in exactly one cell. Cells larger than ``block`` are cut
    into blocks, and block against block is one matrix product, so no task holds
    more than two blocks whatever the skew. At low thresholds guests are many and
    this is a blocked all-pairs product: the work is that of the answer sought.

    ``key`` must be unique and ``vec`` usable and of one length; see ``classes``.
    """
    spark = reps.sparkSession
    # Read several times below, so worked out once.
    rows = stored(reps.select(F.col(key).alias("key"), F.col(vec).alias("vec")), "reps")
    kind = dict(rows.dtypes)["key"]
    n = rows.count()
    cells = max(1, min(most_cells, math.ceil(n / block)))
    some = rows.orderBy(F.xxhash64("key"), "key").limit(4 * cells).collect()  # at most 4 * most_cells rows
    if not some:
        return spark.createDataFrame([], f"a {kind}, b {kind}, score double")
    p = _far_apart(V.unit(np.array([r["vec"] for r in some], np.float64)), cells)
    reach = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = V.unit(V.matrix(b.column("vec"), np.float64))
            angle = np.arccos(np.clip(x @ p.T, -1, 1))
            home = angle.argmin(1)
            near = angle <= angle[np.arange(len(x)), home][:, None] + reach
            near &= np.arange(len(p))[None, :] < home[:, None]
            near[np.arange(len(x)), home] = True
            i, c = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(c == home[i]), b.column("key").take(pa.array(i)), V.lists(x.astype(np.float32)[i])],
                names=["cell", "home", "key", "vec"],
            )

    placed = rows.mapInArrow(route, f"cell int, home boolean, key {kind}, vec array<float>")
    sizes = {(r["cell"], r["home"]): r["count"] for r in placed.groupBy("cell", "home").count().collect()}  # two rows a cell
    blocks = F.create_map(*[
        x for (c, h), m in sizes.items() for x in (F.lit(f"{c}{h}"), F.lit(math.ceil(m / block)))
    ])
    of = lambda home: F.coalesce(blocks[F.concat(F.col("cell").cast("string"), F.lit(str(home)))], F.lit(0))
    mine = F.pmod(F.xxhash64("key", F.lit(7)), F.when(F.col("home"), of(True)).otherwise(of(False))).cast("int")
    b = placed.withColumn("nh", of(True).cast("int")).withColumn("ng", of(False).cast("int")).withColumn("mine", mine)
    # Task (i, j): home block i against home block j >= i, or against guest block j - nh.
    as_first = F.sequence(F.col("mine"), F.col("nh") + F.col("ng") - 1)
    as_later = F.when(F.col("mine") > 0, F.sequence(F.lit(0), F.col("mine") - 1)).otherwise(F.array().cast("array<int>"))
    tasks = F.when(
        F.col("home"),
        F.concat(
            F.transform(as_first, lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"))),
            F.transform(as_later, lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"))),
        ),
    ).when(
        F.col("nh") > 0,
        F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.alias("i"), (F.col("nh") + F.col("mine")).alias("j"))),
    ).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    spread = b.select("cell", "home", "mine", "key", "vec", F.explode(tasks).alias("t")).select(
        "cell", F.col("t.i").alias("i"), F.col("t.j").alias("j"), (F.col("home") & (F.col("mine") == F.col("t.i"))).alias("left"), "key", "vec"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iat[0] == pdf["j"].iat[0]
        left = pdf["left"].to_numpy()
        keys, x = pdf["key"].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x = V.unit(x)
        l, r = np.nonzero(left)[0], np.nonzero(left if same else ~left)[0]
        s = x[l] @ x[r].T
        if same:
            s = np.triu(s, 1) + np.tril(np.full_like(s, -2.0))
        i, j = np.nonzero(s >= threshold)
        ka, kb = keys[l[i]], keys[r[j]]
        swap = np.array([u > v for u, v in zip(ka, kb)], bool)
        return pd.DataFrame({"a": np.where(swap, kb, ka), "b": np.where(swap, ka, kb), "score": s[i, j]})

    return spread.groupBy("cell", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, score double")
