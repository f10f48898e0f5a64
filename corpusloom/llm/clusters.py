"""Vectors in clusters of mutually similar ones, by bisecting k-means across the cluster.

The node of largest dispersion is split in two, again and again. Splits of nodes larger
than one task's share are made by passes over all rows: every task sends its rows down
the tree as it is and returns counts, sums and the least cosine to the centre for each
side of each open node, and a few rows by hash from which the next split starts; the
sums give the centres that the split is made with. A node is a leaf once it is compact:
all its rows lie within half the limit's angle of its centre, so that any two are within
the limit. What fits one task is split on there by the same rule, until every leaf is
compact. Rows and leaves are all reported, single ones too.

A split can tear what belongs together. ``_across`` finds every such link, exactly:
leaves are balls, single rows points, and every two of them are held against each other.
Balls are few, so this costs the square of the rows in no leaf with others; no index
gives an exact answer for less where vectors have no structure.

``confirm`` checks at the end that any two members of a joined cluster are within the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut, stored
from . import partition

#: Rows that one task splits on by itself, and rows of a block that cosines are compared in.
NODE, CELL = 16_384, 4096
#: Nodes of the distributed tree at most; where more would be needed, tasks take larger nodes.
NODES = 65_536
#: Nodes split in one pass, the largest dispersions first, and rows that a split starts from.
WAVE, SEEDS = 512, 64
#: Rows of a node up to which its cosines are held at once.
HELD = 1024
#: Balls and points in a block of the closing comparison.
UNITS = 32_768


def bisect(x: np.ndarray, limit: float) -> np.ndarray:
    """A leaf number for each row: nodes are split in two until all are compact."""
    leaf, n = np.empty(len(x), np.int64), 0
    half_angle = math.cos(math.acos(limit) / 2)
    stack = [np.arange(len(x))] if len(x) else []
    while stack:
        rows = stack.pop()
        y = x[rows]
        compact = len(rows) == 1 or (y @ V.unit(y.mean(0, keepdims=True))[0]).min() >= half_angle
        if not compact and len(rows) <= HELD:
            close = y @ y.T >= limit
            compact = bool(close.all())
            if not compact:
                # A row with no other within the limit ends alone however the node is split.
                lone = close.sum(1) <= 1
                leaf[rows[lone]] = np.arange(n, n + lone.sum())
                n += int(lone.sum())
                rows, y = rows[~lone], y[~lone]
                if len(rows) < 2:
                    continue
        if compact:
            leaf[rows] = n
            n += 1
            continue
        half = partition.two_means(y, 4)
        if half.all() or not half.any():
            half = np.arange(len(rows)) == (y @ y[0]).argmin()
        stack += [rows[~half], rows[half]]
    return leaf


class Tree:
    """Splits made so far. ``child[i]`` are the two nodes below node ``i`` or -1, ``apart[i]`` the difference of their centres."""

    def __init__(self, centre: np.ndarray):
        self.child, self.apart, self.centre = [(-1, -1)], [np.zeros_like(centre)], [centre]

    def split(self, node: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        at = len(self.child)
        self.child[node], self.apart[node] = (at, at + 1), right - left
        for c in (left, right):
            self.child.append((-1, -1))
            self.apart.append(np.zeros_like(c))
            self.centre.append(c)
        return at, at + 1

    def frozen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.child, np.int32), np.stack(self.apart).astype(np.float32), np.stack(self.centre).astype(np.float32)


def _down(x: np.ndarray, child: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    at = np.zeros(len(x), np.int64)
    going = np.nonzero(child[at, 0] >= 0)[0]
    while len(going):
        side = np.einsum("ij,ij->i", x[going], apart[at[going]]) > 0
        at[going] = child[at[going], side.astype(int)]
        going = going[child[at[going], 0] >= 0]
    return at


def grow(rows: DataFrame, limit: float, n: int, node: int = NODE) -> tuple[Tree, dict[int, int], set[int]]:
    """The distributed part of the tree, the rows of each end node, and which of these are compact already."""
    spark = rows.sparkSession
    node = max(node, math.ceil(n / NODES))
    start = partition.sample(rows, "key", 1024)
    tree = Tree(V.unit(start.mean(0, keepdims=True))[0])
    if n <= node:
        return tree, {0: n}, set()
    half_angle = math.cos(math.acos(limit) / 2)
    seeds, waiting, counts, compact = {0: start}, [(-float(n), 0)], {}, set()
    d = start.shape[1]
    while waiting:
        waiting.sort()
        wave, waiting = [i for _, i in waiting[:WAVE]], waiting[WAVE:]
        guess = {}
        for i in wave:
            h = partition.two_means(seeds[i]) if len(seeds[i]) > 1 else np.zeros(len(seeds[i]), bool)
            if h.all() or not h.any():
                h = np.arange(len(seeds[i])) == 0
            s = seeds[i]
            guess[i] = V.unit(s[h].mean(0)[None])[0] - (V.unit(s[~h].mean(0)[None])[0] if (~h).any() else 0)
        slot = np.full(len(tree.child), -1)
        slot[wave] = range(len(wave))
        held = spark.sparkContext.broadcast((*tree.frozen(), slot, np.stack([guess[i] for i in wave]).astype(np.float32)))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            child, apart, centre, slot, guess = held.value
            k = 2 * len(guess)
            count, total, low = np.zeros(k, np.int64), np.zeros((k, d)), np.ones(k)
            some: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(k)]
            for b in batches:
                if not b.num_rows:
                    continue
                x = V.matrix(b.column("vec"))
                at = _down(x, child, apart)
                mine = np.nonzero(slot[at] >= 0)[0]
                x, at, h = x[mine], at[mine], b.column("h").to_numpy()[mine]
                s = 2 * slot[at] + (np.einsum("ij,ij->i", x, guess[slot[at]]) > 0)
                np.add.at(total, s, x)
                count += np.bincount(s, minlength=k)
                np.minimum.at(low, s, np.einsum("ij,ij->i", x, centre[at]))
                order = np.lexsort((h, s))
                begin = np.searchsorted(s[order], np.arange(k + 1))
                for j in np.nonzero(np.diff(begin))[0]:
                    few = order[begin[j] : begin[j + 1]][:SEEDS]
                    some[j] = sorted(some[j] + [(int(h[r]), x[r]) for r in few], key=lambda t: t[0])[:SEEDS]
            used = np.nonzero(count)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(low[used]), pa.array(list(total[used]), pa.list_(pa.float64())),
                 pa.array([[t[0] for t in some[j]] for j in used], pa.list_(pa.int64())), pa.array([np.concatenate([t[1] for t in some[j]]) for j in used], pa.list_(pa.float32()))],
                names=["slot", "n", "low", "total", "hs", "some"],
            )

        def add(t: pa.Table) -> pa.Table:
            hs = np.concatenate([np.asarray(h) for h in t.column("hs").to_pylist()])
            xs = np.concatenate([np.asarray(v, np.float32).reshape(-1, d) for v in t.column("some").to_pylist()])
            first = np.argsort(hs, kind="stable")[:SEEDS]
            total = V.matrix(t.column("total"), np.float64).sum(0)
            return pa.table({
                "slot": t.column("slot")[:1], "n": pa.array([int(t.column("n").to_numpy().sum())]), "low": pa.array([float(t.column("low").to_numpy().min())]),
                "total": pa.array([total], pa.list_(pa.float64())), "hs": pa.array([hs[first]], pa.list_(pa.int64())), "some": pa.array([xs[first].reshape(-1)], pa.list_(pa.float32())),
            })

        schema = "slot int, n bigint, low double, total array<double>, hs array<bigint>, some array<float>"
        hashed = rows.select("vec", F.xxhash64("key", F.lit(len(tree.child))).alias("h"))
        # Two rows for each node of the wave.
        found = {r["slot"]: r for r in hashed.mapInArrow(tally, schema).groupBy("slot").applyInArrow(add, schema).collect()}
        held.destroy()
        for j, i in enumerate(wave):
            sides = [found.get(2 * j + s) for s in (0, 1)]
            there = [r for r in sides if r is not None]
            counts[i] = sum(r["n"] for r in there)
            if there and min(r["low"] for r in there) >= half_angle:
                compact.add(i)
                continue
            if counts[i] <= node:
                continue
            some = np.concatenate([np.asarray(r["some"], np.float32).reshape(-1, d) for r in there])
            if len(there) < 2:  # the guess split nothing: its seeds lie on one side, others are at hand now
                seeds[i] = some
                waiting.append((-float(counts[i]), i))
                continue
            centres = [V.unit(np.asarray(r["total"])[None])[0].astype(np.float32) for r in sides]
            left, right = tree.split(i, *centres)
            half = some @ (centres[1] - centres[0]) > 0
            for c, r, mask in ((left, sides[0], ~half), (right, sides[1], half)):
                seeds[c] = some[mask] if mask.any() else some[:1]
                waiting.append((float(np.linalg.norm(r["total"]) - r["n"]), c))
            del seeds[i], counts[i]
    return tree, counts, compact


def divide(rows: DataFrame, limit: float = 0.75, node: int = NODE) -> DataFrame:
    """``key, leaf, seen`` of every row: its leaf, named by the leaf's smallest key, and the rows of that leaf.

    ``rows`` are ``units``. Any two rows of a leaf are within ``limit``. No row is dropped
    for reasons of size; an empty table gives no rows.
    """
    kind = dict(rows.dtypes)["key"]
    n = rows.count()
    if not n:
        return rows.select("key", F.col("key").alias("leaf"), F.lit(0).cast("bigint").alias("seen"))
    tree, counts, compact = grow(rows, limit, n, node)
    share = max(node, math.ceil(n / NODES))
    # Nodes that lie together share a task as long as they fit.
    task, room, number = {}, share, 0
    for i in sorted(counts):
        if i in compact:
            continue
        if counts[i] > room:
            number, room = number + 1, share
        task[i], room = number, room - counts[i]
    child, apart, _ = tree.frozen()
    of = np.full(len(child), -1)
    for i, t in task.items():
        of[i] = t
    held = rows.sparkSession.sparkContext.broadcast((child, apart, of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child, apart, of = held.value
        for b in batches:
            if b.num_rows:
                at = _down(V.matrix(b.column("vec")), child, apart)
                yield pa.RecordBatch.from_arrays([pa.array(of[at], pa.int32()), pa.array(at, pa.int32()), b.column("key"), b.column("vec")], names=["task", "node", "key", "vec"])

    def finish(t: pa.Table) -> pa.Table:
        at, x = t.column("node").to_numpy(), V.matrix(t.column("vec"))
        keys = np.array(t.column("key").to_pylist())
        leaf, n = np.empty(len(x), np.int64), 0
        for i in np.unique(at):
            here = np.nonzero(at == i)[0]
            leaf[here] = bisect(x[here], limit) + n
            n = int(leaf[here].max()) + 1
        order = np.lexsort((keys, leaf))
        first = np.searchsorted(leaf[order], np.arange(n))
        name = keys[order[first]]
        at = t.column("key").type
        return pa.table({"key": t.column("key"), "leaf": pa.array(name[leaf].tolist(), at), "seen": pa.array(np.bincount(leaf, minlength=n)[leaf], pa.int64())})

    routed = rows.mapInArrow(route, f"task int, node int, key {kind}, vec array<float>")
    out = routed.where(F.col("task") >= 0).groupBy("task").applyInArrow(finish, f"key {kind}, leaf {kind}, seen bigint")
    if compact:
        whole = routed.where(F.col("task") < 0).select("node", "key")
        names = whole.groupBy("node").agg(F.min("key").alias("leaf"), F.count(F.lit(1)).alias("seen"))
        out = out.unionByName(whole.join(F.broadcast(names), "node").select("key", "leaf", "seen"))  # one row a node
    return stored(out, "leaves")


def _small(keys: DataFrame, most: int = 100_000) -> DataFrame:
    """``keys`` marked for broadcast if they are counted to be no more than ``most``."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _merge(links: DataFrame) -> DataFrame:
    """``key, label``: the smallest label reachable through shared keys and labels."""
    state = cut(links.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_")).select("key", "label", F.col("label").alias("low")))
    while True:
        by_key = state.groupBy("key").agg(F.min("low").alias("k_low"))
        wide = state.join(by_key, "key")
        by_label = wide.groupBy("label").agg(F.min("k_low").alias("l_low"))
        new = cut(wide.join(by_label, "label").select("key", "label", F.least("low", "k_low", "l_low").alias("new"), "low"))
        moved = new.where(F.col("new") != F.col("low")).head(1)
        state = new.select("key", "label", F.col("new").alias("low"))
        if not moved:
            break
    return state.groupBy("key").agg(F.min("low").alias("label"))


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins ``a[i]`` and ``b[i]`` in ``root``, in place: each points to the smallest it is joined with."""
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root[:] = root[root]


def _across(merged: DataFrame, rows: DataFrame, limit: float) -> DataFrame | None:
    """``key, label``: links of labels (a row in no group is its own) between which any pair is within ``limit``. Exact.

    The rows of a group well inside the limit around its centre are a ball with the
    radius of the farthest, and the row nearest the centre stands for it; any other row is
    a point. Standing rows and points within the limit are links at once. A further pair
    needs centres no further apart than the limit's angle and both radii; where that leaves
    a doubt about two labels that nothing joins yet, the rows themselves are compared. No
    task holds more than two blocks. None if there is no link.
    """
    kind = dict(rows.dtypes)["key"]
    one = rows.select("vec").head(1)
    if not one:
        return None
    angle = math.acos(limit)
    labelled = rows.join(_small(merged), "key", "left")
    centre = stored(_centres(labelled.where("label is not null").withColumnRenamed("label", "cluster"), len(one[0]["vec"])), "centres")
    centre = centre.select(F.col("cluster").alias("label"), "centroid")
    cos = V.dot(F.col("vec"), F.col("centroid"))
    near = labelled.join(_small(centre, 10_000), "label", "left").select("key", F.coalesce("label", "key").alias("label"), cos.alias("cos"))
    ball = F.coalesce(F.col("cos") >= math.cos(angle * 0.7), F.lit(False))
    placed = stored(near.withColumn("ball", ball).withColumn("unit", F.when(F.col("ball"), F.col("label")).otherwise(F.col("key"))), "placed")
    balls = placed.where("ball").groupBy("label").agg(
        F.acos(F.least(F.min("cos"), F.lit(1.0))).alias("r"), F.count(F.lit(1)).alias("n"), F.max_by("key", F.struct("cos", "key")).alias("key")
    )
    balls = stored(balls.join(centre, "label"), "balls")
    standing = rows.join(_small(balls.select("key", "label", "r", "n", "centroid"), 10_000), "key")
    points = rows.join(_small(placed.where("not ball").select("key", "label")), "key")
    all_ = points.select(F.col("key").alias("unit"), "label", F.lit(-1.0).alias("r"), F.lit(1).cast("bigint").alias("n"), "vec", F.lit(None).cast("array<float>").alias("centre")).unionByName(
        standing.select(F.col("label").alias("unit"), "label", "r", "n", "vec", F.transform("centroid", lambda x: x.cast("float")).alias("centre"))
    )
    count = placed.select(F.count_distinct("unit", "ball")).first()[0]
    nb = max(1, math.ceil(count / UNITS))
    mine = F.pmod(F.xxhash64("unit", "r"), F.lit(nb)).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    spread = all_.withColumn("mine", mine).withColumn("t", F.explode(other)).select("unit", "label", "r", "n", "vec", "centre", "mine", "t.i", "t.j")

    def meet(t: pa.Table) -> pa.Table:
        x, r, n, mine = V.matrix(t.column("vec")), t.column("r").to_numpy(), t.column("n").to_numpy(), t.column("mine").to_numpy()
        names, label = np.unique(np.array(t.column("label").to_pylist()), return_inverse=True)
        root, host, guest = np.arange(len(names)), [], []
        left, right = np.nonzero(mine == t.column("i")[0].as_py())[0], np.nonzero(mine == t.column("j")[0].as_py())[0]
        y = x[right]
        for at in range(0, len(left), 512):
            p, q = np.nonzero(x[left[at : at + 512]] @ y.T >= limit)
            _join(root, label[left[at + p]], label[right[q]])
        middle = x.copy()
        if (r >= 0).any():
            middle[r >= 0] = V.matrix(t.column("centre").filter(pa.array(r >= 0)))
        for l, g in ((left[r[left] >= 0], right), (left[r[left] < 0], right[r[right] >= 0])):
            y = middle[g]
            for at in range(0, len(l) if len(g) else 0, 512):
                p = l[at : at + 512]
                wide = np.maximum(r[p], 0)[:, None] + np.maximum(r[g], 0)[None] + angle + 1e-3
                i, j = np.nonzero(middle[p] @ y.T >= np.cos(np.minimum(wide, math.pi)) - 1e-6)
                p, q = p[i], g[j]
                apart = root[label[p]] != root[label[q]]
                p, q = p[apart], q[apart]
                # The host is a ball, of two the larger.
                swap = (r[q] >= 0) & ((r[p] < 0) | (n[q] > n[p]) | ((n[q] == n[p]) & (q > p)))
                host.append(np.where(swap, q, p))
                guest.append(np.where(swap, p, q))
        moved = np.nonzero(root != np.arange(len(root)))[0]
        pairs = np.unique(np.stack([np.concatenate(host), np.concatenate(guest)]), axis=1) if host else np.zeros((2, 0), int)
        unit, at = t.column("unit"), t.column("label").type
        a = pa.concat_arrays([pa.array(names[root[moved]].tolist(), at), unit.take(pa.array(pairs[0])).combine_chunks()])
        b = pa.concat_arrays([pa.array(names[moved].tolist(), at), unit.take(pa.array(pairs[1])).combine_chunks()])
        own = pa.array(names[np.concatenate([moved, label[pairs[1]]])].tolist(), at)
        link = pa.array([True] * len(moved) + [False] * pairs.shape[1], pa.bool_())
        return pa.table({"link": link, "a": a, "b": b, "b_label": own, "ball": pa.array([False] * len(moved) + (r[pairs[1]] >= 0).tolist(), pa.bool_())})

    met = stored(spread.groupBy("i", "j").applyInArrow(meet, f"link boolean, a {kind}, b {kind}, b_label {kind}, ball boolean"), "met")
    links = met.where("link").select("a", "b").distinct()
    doubt = met.where("not link").select(F.col("a").alias("host"), F.col("b").alias("unit"), "b_label", "ball").distinct()
    if doubt.head(1):
        # What links of other tasks have joined meanwhile is in doubt no more.
        low = cut(_merge(_both_ways(links)))
        to = lambda c: low.select(F.col("key").alias(c), F.col("label").alias(f"{c}_low"))
        doubt = doubt.join(to("host"), "host", "left").join(to("b_label"), "b_label", "left")
        doubt = stored(doubt.where(F.coalesce("host_low", "host") != F.coalesce("b_label_low", "b_label")).select("host", "unit", "ball"), "doubt")
    if doubt.head(1):
        guests = placed.join(doubt, ["unit", "ball"]).select("host", "key", "label", F.lit(False).alias("home"))
        homes = placed.where("ball").join(doubt.select(F.col("host").alias("label")).distinct(), "label").select(F.col("label").alias("host"), "key", "label", F.lit(True).alias("home"))
        # Of the guests, those that the host's radius leaves within reach.
        reach = balls.select(F.col("label").alias("host"), F.cos(F.least(F.col("r") + angle + 1e-3, F.lit(math.pi))).alias("least"), "centroid")
        reach = _small(stored(reach.join(doubt.select("host").distinct(), "host"), "reach"), 10_000)
        guests = rows.join(_small(stored(guests, "guests")), "key").join(reach, "host").where(cos >= F.col("least") - 1e-6).select("host", "key", "label", "home")
        guests = stored(guests, "near-guests")
        homes = homes.join(guests.select("host").distinct(), "host", "left_semi")
        held = stored(homes.unionByName(guests), "held")
        blocks = lambda home: F.ceil(F.sum((F.col("home") == home).cast("int")) / CELL).cast("int")
        nb_ = held.groupBy("host").agg(blocks(True).alias("ni"), blocks(False).alias("nj"))
        cut_ = rows.join(_small(held), "key").join(nb_, "host")
        own = F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("ni")).otherwise(F.col("nj"))).cast("int")
        against = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("nj")).otherwise(F.col("ni")) - 1))
        cut_ = cut_.withColumn("own", own).withColumn("against", against)
        i, j = (F.when(F.col("home") == h, F.col("own")).otherwise(F.col("against")) for h in (True, False))

        def compare(t: pa.Table) -> pa.Table:
            x, home = V.matrix(t.column("vec")), np.array(t.column("home").to_pylist(), bool)
            y, hit = x[home], np.zeros(len(x), bool)
            g = np.nonzero(~home)[0]
            for at in range(0, len(g) if len(y) else 0, 1024):
                hit[g[at : at + 1024]] = (x[g[at : at + 1024]] @ y.T >= limit).any(1)
            b = t.column("label").filter(pa.array(hit)).unique()
            return pa.table({"a": pa.array([t.column("host")[0].as_py()] * len(b), t.column("host").type), "b": b})

        tasks = cut_.select("host", "label", "home", "vec", i.alias("i"), j.alias("j"))
        links = links.unionByName(tasks.groupBy("host", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"))
    links = stored(links.distinct(), "across")
    if not links.head(1):
        return None
    return _both_ways(links)


def _both_ways(links: DataFrame) -> DataFrame:
    """``a, b`` as ``key, label`` with each label its own key too, as ``_merge`` takes them."""
    low = links.select(F.least("a", "b").alias("label"), F.greatest("a", "b").alias("key"))
    return low.select("key", "label").unionByName(low.select(F.col("label").alias("key"), "label").distinct())


def units(items: DataFrame, key: str = "key") -> DataFrame:
    """``key, vec`` with unit vectors, stored."""
    kind = dict(items.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), V.lists(V.unit(V.matrix(b.column(1))))], names=["key", "vec"])

    return stored(items.select(F.col(key).alias("key"), "vec").mapInArrow(work, f"key {kind}, vec array<float>"), "units")


def assign(leaves: DataFrame, rows: DataFrame, limit: float = 0.75) -> DataFrame:
    """``key, cluster, seen`` of every row that is in a cluster of two or more; ``cluster`` is its smallest key.

    ``leaves`` are those of ``divide``, joined where a split tore them. ``seen`` is the size
    of the row's leaf; where it equals the cluster's, the cluster is confirmed already. Rows
    without any other within the limit are in no cluster.
    """
    merged = leaves.where(F.col("seen") > 1).select("key", F.col("leaf").alias("label"))
    across = _across(merged, rows, limit)
    if across is not None:
        wider = cut(_merge(across))
        lone = wider.join(merged.select("key"), "key", "left_anti")
        moved = merged.join(wider.select(F.col("key").alias("label"), F.col("label").alias("to")), "label", "left")
        merged = moved.select("key", F.coalesce("to", "label").alias("label")).unionByName(lone)
    return merged.join(leaves.select("key", "seen"), "key").select("key", F.col("label").alias("cluster"), "seen")


def divided(leaves: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``key, cluster`` of every row: its confirmed cluster, or else its leaf, which is one by itself."""
    both = leaves.select("key", "leaf").join(confirmed.select("key", "cluster"), "key", "left")
    return both.select("key", F.coalesce("cluster", "leaf").alias("cluster"))


def confirm(assigned: DataFrame, rows: DataFrame, limit: float = 0.75) -> DataFrame:
    """Of ``assigned`` (stored; vectors in ``rows``) the clusters in which any two members are within ``limit``. Exact.

    Clusters that one task has seen whole need nothing further. Of the others, members all within half the limit's angle of their centre need no comparison of
    pairs. The others are compared block by block; no task holds more than two blocks.
    """
    kind = dict(assigned.dtypes)["key"]
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("seen"))
    open_ = cut(sizes.where(F.col("seen") < F.col("n")).select("cluster"))
    some = assigned.join(open_, "cluster", "left_semi").select("key", "cluster")
    doubtful = rows.join(_small(some), "key")
    one = doubtful.select("vec").head(1)
    if not one:
        return assigned.drop("seen")
    doubtful = stored(doubtful, "doubtful")
    centre = _centres(doubtful, len(one[0]["vec"]))
    farthest = doubtful.join(centre, "cluster").groupBy("cluster", "size").agg(F.min(V.dot(F.col("vec"), F.col("centroid"))).alias("far"))
    open_ = farthest.where(F.col("far") < math.cos(math.acos(limit) / 2) + 1e-6)
    blocks = open_.select("cluster", F.ceil(F.col("size") / CELL).cast("int").alias("nb"))
    split = doubtful.join(blocks, "cluster").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")),
    )
    spread = split.select("cluster", "mine", "vec", F.explode(tasks).alias("t")).select("cluster", "mine", "vec", "t.i", "t.j")

    def work(t: pa.Table) -> pa.Table:
        x, mine = V.matrix(t.column("vec")), t.column("mine").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        low = 1.0
        left, right = x[mine == i], x[mine == j]
        for at in range(0, len(left), 1024):
            if len(right):
                low = min(low, float((left[at : at + 1024] @ right.T).min()))
        return pa.table({"cluster": pa.array([t.column("cluster")[0].as_py()], t.column("cluster").type), "low": pa.array([low], pa.float64())})

    low = spread.groupBy("cluster", "i", "j").applyInArrow(work, f"cluster {kind}, low double")
    torn = low.groupBy("cluster").agg(F.min("low").alias("low")).where(F.col("low") < limit).select("cluster")
    return assigned.join(torn, "cluster", "left_anti").drop("seen")


def _centres(assigned: DataFrame, dim: int) -> DataFrame:
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.sum(F.get("vec", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dim)]
    )
    return sums.select("cluster", "size", V.normalise(F.array(*[f"s{i}" for i in range(dim)])).alias("centroid"))


def describe(assigned: DataFrame, dim: int, typical: int = 3) -> DataFrame:
    """``cluster, size, centroid, dispersion, typical``: each cluster and its most typical members.

    Sums are made where the rows lie, so a cluster of a third of all rows is never gathered.
    """
    centre = _centres(assigned, dim)
    scored = assigned.join(centre.drop("size"), "cluster").select("cluster", "key", V.dot(F.col("vec"), F.col("centroid")).alias("cos"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("c"), "key"))), 1, typical)
    salted = scored.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(64)))
    part = salted.withColumn("_r", F.row_number().over(Window.partitionBy("cluster", "_s").orderBy(F.desc("cos"), "key")))
    tops = part.where(F.col("_r") <= typical).groupBy("cluster").agg(best.alias("best"))
    spread = scored.groupBy("cluster").agg(F.avg(1 - F.col("cos")).alias("dispersion"))
    return centre.join(spread, "cluster").join(tops, "cluster").select(
        "cluster", "size", F.transform("centroid", lambda x: x.cast("float")).alias("centroid"), "dispersion",
        F.transform("best", lambda b: b["key"]).alias("typical"),
    )
