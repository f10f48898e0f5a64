"""The most similar vectors of every vector.

An inverted file of coarse centroids with product-quantised residuals. Coarse centroids
and codebooks are fitted on a bounded sample; every vector is put into the list of its
nearest centroid and coded. There are three times as many lists as the square root of
the vectors. A query visits the lists of its nearest centroids and no others: asymmetric
distances, the query as it is against decoded codes, choose candidates among their rows,
and these are ranked by their exact cosine. A pair that either side finds counts for
both. The sums of table entries that make up an asymmetric distance are evaluated as one
matrix product of queries with decoded codes; the figures are the same and processors
are much faster at it than at looking up 64 table entries for each pair.

Lists that lie together share a bin, which is what one task holds; a list above a bin's
size is spread over several. A row travels once to its own bin, and once to each other
bin of which it asks a list, there as a query only, with its numbers rounded to 24 bits:
cosines then differ by less than a millionth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stored
from . import partition

#: Numbers of a subspace, words of its codebook, and residuals that a codebook is fitted on.
SUB, CODEWORDS, BOOK_SAMPLE = 2, 256, 8192
#: Vectors that fitting looks at: at least so many, eight for each list, and at most so many.
SAMPLE, MOST_SAMPLE = 65_536, 131_072
#: Rows of a bin, and queries that meet them in one task at most.
BIN, QUERIES = 16_384, 65_536
#: Lists that a query visits.
PROBES = 56
#: Rows kept by asymmetric distance for each query and bin.
CANDIDATES = 48


def coarse_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids by k-means; those that stay empty start anew. In an order in which neighbours lie together."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(k))
        sums = np.add.reduceat(x[order], np.minimum(at, len(x) - 1), 0)
        empty = np.bincount(near, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = V.unit(sums)
    leaves, _ = partition.bisect(c, k, least=2)
    return c[np.concatenate(leaves)]


def codebooks(residuals: np.ndarray, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """``d / 2`` books of ``CODEWORDS`` pairs by k-means in each subspace, on at most ``BOOK_SAMPLE`` residuals."""
    rng = np.random.default_rng(seed)
    n, d = residuals.shape
    if n > BOOK_SAMPLE:
        residuals, n = residuals[rng.choice(n, BOOK_SAMPLE, replace=False)], BOOK_SAMPLE
    k = min(CODEWORDS, n)
    out = np.zeros((d // SUB, CODEWORDS, SUB), np.float32)
    for m in range(d // SUB):
        x = residuals[:, m * SUB : (m + 1) * SUB]
        c = x[rng.choice(n, k, replace=False)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
            count = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, x[:, j], k) for j in range(SUB)], 1)
            c[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
        out[m, :k] = c
        out[m, k:] = c[0]
    return out


def encode(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    codes = np.empty((len(residuals), len(books)), np.uint8)
    for m, c in enumerate(books):
        x = residuals[:, m * SUB : (m + 1) * SUB]
        codes[:, m] = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
    return codes


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)


class Index:
    """Centroids, codebooks and the lists that each vector is in and asks."""

    def __init__(self, rows: DataFrame, n: int, lists: int | None, probes: int):
        lists = lists or max(1, int(3 * math.sqrt(n)))
        fit = partition.sample(rows, "key", min(MOST_SAMPLE, max(SAMPLE, 8 * lists)))
        lists = max(1, min(lists, len(fit) // 4))
        self.coarse = coarse = coarse_centroids(fit, lists)
        self.books = books = codebooks(fit - coarse[(fit @ coarse.T).argmax(1)])
        ask = min(probes, lists)
        kind = dict(rows.dtypes)["key"]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = V.unit(V.matrix(b.column("vec")))
                s = x @ coarse.T
                home = s.argmax(1)
                near = np.sort(np.argpartition(-s, ask - 1, 1)[:, :ask], 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), V.lists(x), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in encode(x - coarse[home], books)], pa.binary()),
                     pa.array([r.tobytes() for r in near], pa.binary())],
                    names=["key", "vec", "list", "codes", "asks"],
                )

        self.placed = stored(rows.mapInArrow(place, f"key {kind}, vec array<float>, list int, codes binary, asks binary"), "ivf")
        self.sizes = np.zeros(lists, np.int64)
        for r in self.placed.groupBy("list").count().collect():  # one row a list
            self.sizes[r["list"]] = r["count"]

    def asked(self) -> np.ndarray:
        """How many queries ask each list."""
        lists = len(self.coarse)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(lists, np.int64)
            for b in batches:
                n += np.bincount(np.frombuffer(b"".join(b.column("asks").to_pylist()), np.int32), minlength=lists)
            yield pa.RecordBatch.from_arrays([pa.array(range(lists), pa.int32()), pa.array(n)], names=["list", "n"])

        out = np.zeros(lists, np.int64)
        for r in self.placed.select("asks").mapInArrow(count, "list int, n bigint").groupBy("list").agg(F.sum("n").alias("n")).collect():
            out[r["list"]] = r["n"]
        return out

    def scored_share(self) -> float:
        """The share of all pairs that is scored at all."""
        n = self.sizes.sum()
        return float((self.asked() * self.sizes).sum() / n / n)


def nearest(items: DataFrame, key: str = "key", k: int = 5, probes: int = PROBES, lists: int | None = None) -> DataFrame:
    """``key, other, rank, cosine``: the ``k`` most similar others of each item.

    ``items`` has unique keys and usable vectors ``vec`` of one length, an even number.
    ``probes`` is the number of lists that a query asks; a share of neighbours is missed,
    see the README for what was measured. Ties by key. Fewer than two items give no rows.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("key"), F.col("vec").alias("vec"))
    kind = dict(rows.dtypes)["key"]
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], f"key {kind}, other {kind}, rank int, cosine double")
    index = Index(rows, n, lists, probes)
    coarse, books, sizes = index.coarse, index.books, index.sizes
    # Bins in the order of the lists; a list above a bin's size takes several of its own.
    first, parts, b, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, BIN
    for c, m in enumerate(sizes):
        if m > room and room < BIN:
            b, room = b + 1, BIN
        first[c], parts[c] = b, max(1, -(-m // BIN))
        b, room = (b + parts[c], BIN) if parts[c] > 1 else (b, room - m)
    bins = int(b + 1)
    of_list = np.zeros((len(sizes), bins), bool)
    for c in range(len(sizes)):
        of_list[c, first[c] : first[c] + parts[c]] = True

    def wanted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        asks = np.frombuffer(b"".join(b.column("asks").to_pylist()), np.int32).reshape(b.num_rows, -1)
        want = np.zeros((b.num_rows, bins), bool)
        for j in range(asks.shape[1]):
            want |= of_list[asks[:, j]]
        return asks, want

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins, np.int64)
        for b in batches:
            n += wanted(b)[1].sum(0) if b.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(bins), pa.int32()), pa.array(n)], names=["bin", "n"])

    asking = dict(index.placed.select("asks").mapInArrow(load, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect())  # one row a bin
    blocks = np.array([max(1, math.ceil(asking.get(i, 0) / QUERIES)) for i in range(bins)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            home, h = b.column("list").to_numpy(), b.column("h").to_numpy()
            mine = first[home] + h % parts[home]
            asks, want = wanted(b)
            # A query goes to one block of each bin it asks, a row of the bin to all.
            i, s = np.nonzero(want)
            block = h[i] // 7 % blocks[s]
            j = np.repeat(np.arange(len(home)), blocks[mine])
            all_ = np.concatenate([np.arange(x) for x in blocks[mine]])
            both = np.unique(np.stack([np.concatenate([i, j]), np.concatenate([s, mine[j]]), np.concatenate([block, all_])]), axis=1)
            i, s, block = both
            here = s == mine[i]
            query = want[i, s] & (block == h[i] // 7 % blocks[s])
            take = pa.array(i)
            codes = b.column("codes").take(take)
            # Only rows of the bin bring their vector as it is, codes and list; guests bring a shorter one and what they ask.
            far = pa.array([v.tobytes() for v in _shorter(V.matrix(b.column("vec")))], pa.binary()).take(take)
            no = pa.array(~here)
            vec, none = b.column("vec").take(take), lambda x: pa.scalar(None, x.type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array(block, pa.int32()), b.column("key").take(take), _where(no, none(vec), vec), _where(no, far, none(far)), b.column("list").take(take),
                 pa.array(query), pc.if_else(no, none(codes), codes), pa.array([a.tobytes() for a in asks.astype(np.uint16 if len(coarse) < 65_536 else np.int32)], pa.binary()).take(take)],
                names=["bin", "block", "key", "vec", "far", "list", "query", "codes", "asks"],
            )

    def search(t: pa.Table) -> pa.Table:
        keys = np.array(t.column("key").to_pylist())
        home, query = t.column("list").to_numpy(), t.column("query").to_numpy()
        here = np.asarray(t.column("vec").is_valid())
        members, out = np.nonzero(here)[0], []
        x = np.empty((len(keys), coarse.shape[1]), np.float32)
        x[members] = V.matrix(t.column("vec").filter(pa.array(here)))
        if not here.all():
            x[~here] = _longer(b"".join(t.column("far").filter(pa.array(~here)).to_pylist()), x.shape[1])
        members = members[np.argsort(home[members], kind="stable")]
        asking = np.nonzero(query)[0]
        if len(members) and len(asking):
            codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
            approx = coarse[home[members]] + decode(codes, books)
            held, begin, size = np.unique(home[members], return_index=True, return_counts=True)
            asks = np.frombuffer(b"".join(t.column("asks").take(pa.array(asking)).to_pylist()), np.uint16 if len(coarse) < 65_536 else np.int32).reshape(len(asking), -1)
            slot = np.full(len(coarse), -1)
            slot[held] = np.arange(len(held))
            for i in range(0, len(asking), 1024):
                q = asking[i : i + 1024]
                visits = np.zeros((len(q), len(held) + 1), bool)
                np.put_along_axis(visits, slot[asks[i : i + 1024]], True, 1)
                visits = visits[:, :-1]  # lists of other bins are in the last column
                ends = np.cumsum(visits * size, 1)
                at = ends - visits * size
                # Scores of the lists a query visits lie side by side; no other row is scored.
                s = np.full((len(q), max(1, int(ends[:, -1].max()))), -np.inf, np.float32)
                for j in np.nonzero(visits.any(0))[0]:
                    r = np.nonzero(visits[:, j])[0]
                    u, m = begin[j], size[j]
                    s[r[:, None], at[r, j][:, None] + np.arange(m)] = x[q[r]] @ approx[u : u + m].T
                take = min(CANDIDATES, s.shape[1])
                best = np.argpartition(-s, take - 1, 1)[:, :take]
                r, c = np.repeat(np.arange(len(q)), take), best.ravel()
                keep = np.isfinite(s[r, c])
                r, c = r[keep], c[keep]
                # From the place among a query's scores back to the row: which of its lists begins last before it.
                vr, vj = np.nonzero(visits)
                wide = s.shape[1] + 1
                of = np.searchsorted(vr * wide + at[vr, vj], r * wide + c, "right") - 1
                row = members[begin[vj[of]] + c - at[vr[of], vj[of]]]
                keep = row != q[r]
                r, row = r[keep], row[keep]
                cos = np.einsum("ij,ij->i", x[q[r]].astype(np.float64), x[row].astype(np.float64))
                order = np.lexsort((keys[row], -cos, r))
                r, row, cos = r[order], row[order], cos[order]
                top = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((keys[q[r[top]]], keys[row[top]], cos[top]))
        cat = lambda j: np.concatenate([o[j] for o in out]) if out else np.array([])
        kinds = t.column("key").type
        return pa.table({"key": pa.array(cat(0).tolist(), kinds), "other": pa.array(cat(1).tolist(), kinds), "cosine": pa.array(cat(2), pa.float64())})

    hashed = index.placed.withColumn("h", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)))
    sent = hashed.mapInArrow(route, f"bin int, block int, key {kind}, vec array<float>, far binary, list int, query boolean, codes binary, asks binary")
    found = stored(sent.groupBy("bin", "block").applyInArrow(search, f"key {kind}, other {kind}, cosine double"), "found")
    # Found by either side; a pair comes twice at most, so 2k rows hold the best k.
    both = found.unionByName(found.select(F.col("other").alias("key"), F.col("key").alias("other"), "cosine"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= 2 * k)
    ranked = ranked.groupBy("key", "other").agg(F.max("cosine").alias("cosine"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k)
    return ranked.groupBy("key").agg(top.alias("top")).select("key", F.posexplode("top").alias("rank", "t")).select(
        "key", F.col("t.other").alias("other"), F.col("rank") + 1, (-F.col("t.c")).alias("cosine")
    ).toDF("key", "other", "rank", "cosine")


def _shorter(x: np.ndarray) -> np.ndarray:
    """Each number of 32 bits rounded to its upper 24."""
    bits = x.astype("<f4").view("<u4")
    return (bits + np.uint32(0x80)).view(np.uint8).reshape(len(x), -1, 4)[:, :, 1:]


def _longer(short: bytes, d: int) -> np.ndarray:
    part = np.frombuffer(short, np.uint8).reshape(-1, d, 3)
    out = np.zeros((len(part), d, 4), np.uint8)
    out[:, :, 1:] = part
    return out.reshape(len(part), -1).view("<f4")


def _where(mask: pa.Array, yes, no) -> pa.Array:
    """``if_else`` for lists and bytes, where either side may be null."""
    column = no if isinstance(yes, pa.Scalar) else yes
    at = pa.array(np.where(np.asarray(mask) == isinstance(yes, pa.Scalar), -1, np.arange(len(column))))
    return column.take(pc.if_else(pc.less(at, 0), pa.scalar(None, pa.int64()), at))


def brute_force(x: np.ndarray, queries: np.ndarray, k: int = 5) -> np.ndarray:
    """Row numbers of the exact ``k`` nearest others of each query row, to measure recall against."""
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -2
    return np.argsort(-s, 1, kind="stable")[:, :k]
