"""New batches held against everything accepted before.

A history is a folder that outlives the session: ``History.create`` makes it,
``History.open`` takes it up again, ``ingest`` adds one batch. It holds

* ``texts``: one row for each accepted text, with root, fingerprint and text, bucketed by node;
* ``blocks``: its block keys, bucketed by key. ``lead`` marks the earliest node of a key, so the
  lead rows are one a key however large a family is; later nodes of a key lie apart;
* ``runs``: the runs that are complete. A run that broke off is not read, and is written anew.

The fingerprint is b-bit minwise. Of 240 lanes one bit each makes the signature for the
Hamming check, and 13 bits each the blocks: for table ``j`` the lanes are rotated by ``j``
and three of them, 39 bits, are the block; no lane is in two tables. A sign fingerprint
of the usual 64 bits would leave texts with half their runs in common some 17 bits
apart, beyond what any block table can serve; lanes keep the same tables and the same
Hamming check but collide in a block with the third power of the overlap. With 80
tables a pair at exactly one half is missed in (7/8)^80, one of some 40,000 cases, at
0.6 in fewer than one of a hundred million; the Hamming bound adds less.

A batch is read once and moves by itself. Its distinct keys go to the buckets of
``blocks``, where each finds at most one lead node; nothing of the index is shuffled or
sorted. Pairs pass the signatures first, and only texts of pairs that do are fetched and
compared in full. What the lead nodes do not settle is held against the later nodes of
its keys. A batch so small that its keys can be written into the query reads only the
buckets they lie in; a larger one reads the key and node columns of the index once.

Accepting is sequential by definition (a text is only held against accepted ones):
rounds of leaders thin out families, then rounds over verified links decide the rest.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_dir
from .records import with_roots

VERSION = 2
LANES, TABLES, PER_BLOCK, LANE_BITS = 240, 80, 3, 13
BLOCK_BITS = PER_BLOCK * LANE_BITS
#: Words a text must have, and the run length, for nearness; the share of runs in common.
LEAST_WORDS, RUN, SHARE = 20, 3, 0.5
#: Signature bits that may differ: 60 are expected at one half in common, the spread is 6.7.
MOST_BITS = 100
#: Nodes of one key that meet as single pairs; beyond it slices of so many meet in a task of their own.
FEW, SLICE = 256, 1000
#: Rows from which a key is crowded, so that its rows are not shuffled; keys that are broadcast for it at most.
HOT, HOT_KEYS = 100_000, 10_000
#: Values written into a query, so that it reads only their buckets; rows of a batch that are hashed in one bucket.
LITERALS, BUILT = 2000, 5_000_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, LANES, dtype=np.uint32)
_AT = np.array([[j + o * TABLES for o in range(PER_BLOCK)] for j in range(TABLES)])
_TABLE = np.arange(TABLES, dtype=np.uint64) << np.uint64(BLOCK_BITS)
_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def runs(text: str, cache: dict[str, int] | None = None) -> tuple[int, np.ndarray]:
    """Number of words, and the hashes of all runs of three words in their order."""
    cache = {} if cache is None else cache
    words = _WORD.findall(text.lower())
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    if len(h) < RUN:
        return len(words), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return len(words), _mix(h[:-2] * _M1 + h[1:-1] * _M2 + _mix(h[2:]))


def lanes(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each lane, mixed: 240 numbers of 64 bits."""
    low = np.full(LANES, np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096, None] * _A
            part += _B
            part ^= part >> np.uint32(16)
            np.minimum(low, part.min(0), out=low)
        return _mix(low.astype(np.uint64) + np.arange(LANES, dtype=np.uint64) * _M1)


def signature(mixed: np.ndarray) -> np.ndarray:
    """One bit of each lane, in four numbers of 64 bits."""
    bits = np.zeros(256, np.uint8)
    bits[:LANES] = (mixed >> np.uint64(40)) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def block_keys(mixed: np.ndarray) -> np.ndarray:
    """One key for each rotated table: the table's number, then 39 bits of lanes."""
    f = (mixed & np.uint64((1 << LANE_BITS) - 1))[_AT]
    return (_TABLE | (f[:, 0] << np.uint64(2 * LANE_BITS)) | (f[:, 1] << np.uint64(LANE_BITS)) | f[:, 2]).view(np.int64)


def root_key(root: str) -> int:
    """The root as one more block, in a table of its own."""
    return (TABLES << BLOCK_BITS) | (xxhash.xxh64_intdigest(root) & ((1 << BLOCK_BITS) - 1))


def near(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether of two texts' distinct runs at least half are in both."""
    if not len(p) or not len(q) or len(p) > 2 * len(q) or len(q) > 2 * len(p):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= SHARE * (len(p) + len(q) - both)


SIGNATURE = ("s0", "s1", "s2", "s3")
FEATURES = "node bigint, root string, text string, s0 bigint, s1 bigint, s2 bigint, s3 bigint, keys array<bigint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for b in batches:
        sigs, keys = np.zeros((b.num_rows, 4), np.int64), []
        fit = np.zeros(b.num_rows, bool)
        for i, (text, root) in enumerate(zip(b.column("text").to_pylist(), b.column("root").to_pylist())):
            words, sh = runs(text, cache)
            own = [np.array([root_key(root)], np.int64)]
            if words >= LEAST_WORDS:
                mixed = lanes(sh)
                sigs[i], fit[i] = signature(mixed), True
                own.append(block_keys(mixed))
            keys.append(np.concatenate(own))
        if len(cache) > 500_000:
            cache.clear()
        offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        # Texts too short to be near any other have no signature.
        cols = [pa.array(np.ascontiguousarray(sigs[:, j]), mask=~fit) for j in range(4)]
        yield pa.RecordBatch.from_arrays(
            [b.column("node"), b.column("root"), b.column("text"), *cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["node", "root", "text", *SIGNATURE, "keys"],
        )


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``node, root, text, s0..s3, keys`` of the distinct texts of ``id, text``; ``node`` is the smallest id.

    Texts are one if both their words and their root agree, which decides everything
    here. Copies meet before anything costly is computed.
    """
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    formed = with_roots(rows.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text")).withColumn("_w", F.sha2(words, 256))
    first = formed.groupBy("root", "_w").agg(F.min(F.struct("id", "text")).alias("x"))
    return first.select(F.col("x.id").alias("node"), "root", F.col("x.text").alias("text")).mapInArrow(_features, FEATURES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``a, b, old, same, a_text, b_text`` the pairs of the same root, or near by their texts."""
    cache: dict[str, int] = {}
    held: dict[int, np.ndarray] = {}

    def of(node, text):
        if node not in held:
            if len(held) > 4096:
                held.clear()
            held[node] = np.unique(runs(text, cache)[1])
        return held[node]

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text", "same")]
        keep = [same or near(of(p, s), of(q, t)) for p, q, s, t, same in zip(*cols)]
        if len(cache) > 500_000:
            cache.clear()
        yield b.select(["a", "b", "old"]).filter(pa.array(keep, pa.bool_()))


def _meet(t: pa.Table, own: bool) -> pa.Table:
    """Two slices of one crowded key: all links ``a, b, old`` of an earlier node, of the index or (if ``own``) the batch, and one of the batch."""
    node, old = t.column("node").to_numpy(), np.array(t.column("old").to_pylist(), bool)
    mine, i, j = t.column("mine").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    bits = np.unpackbits(np.stack([t.column(s).to_numpy() for s in SIGNATURE], 1).astype(np.int64).view(np.uint8), axis=1).astype(np.float32)
    texts, ones, held = t.column("text"), bits.sum(1), {}

    def of(k):
        if k not in held:
            held[k] = np.unique(runs(texts[k].as_py())[1])
        return held[k]

    out: list[tuple[int, int, bool]] = []
    left, right = np.nonzero(mine == i)[0], np.nonzero(mine == j)[0]
    for at in range(0, len(left), 512):
        l = left[at : at + 512]
        apart = ones[l][:, None] + ones[right][None] - 2 * (bits[l] @ bits[right].T)
        for p, q in zip(*np.nonzero(apart <= MOST_BITS)):
            a, b = l[p], right[q]
            if (i == j and a >= b) or (old[a] and old[b]) or (not own and not (old[a] or old[b])):
                continue
            if old[b] or (not old[a] and node[b] < node[a]):
                a, b = b, a
            if near(of(a), of(b)):
                out.append((int(node[a]), int(node[b]), bool(old[a])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()), "old": pa.array([o[2] for o in out], pa.bool_())})


class _Work:
    """Tables of one ingest, deleted with it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n = spark, path, 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class History:
    """The index of all accepted texts, in a folder of its own.

    ``ingest`` takes the rows ``id, text`` of one batch, which may be empty, and gives the
    ``node`` of those that are new: the smallest id of each accepted text. Ids rise with
    arrival within a batch, and are none of an earlier one unless the text is the same. Null ids
    and null texts count as no row; other columns are not read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, done: list[int]):
        self.spark, self.path, self.buckets, self.done = spark, path, buckets, done
        name = uuid.uuid4().hex[:12]
        self._texts, self._blocks = f"history_texts_{name}", f"history_blocks_{name}"
        made = [
            (self._texts, "node BIGINT, root STRING, text STRING, s0 BIGINT, s1 BIGINT, s2 BIGINT, s3 BIGINT, run INT", "run", "node"),
            (self._blocks, "key BIGINT, node BIGINT, run INT, lead BOOLEAN", "run, lead", "key"),
        ]
        for table, columns, parts, by in made:
            where = f"{path}/{'texts' if table == self._texts else 'blocks'}"
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING PARQUET PARTITIONED BY ({parts}) CLUSTERED BY ({by}) SORTED BY ({by}) "
                f"INTO {buckets} BUCKETS OPTIONS ('compression'='zstd') LOCATION '{where}'"
            )
            if done:
                spark.sql(f"MSCK REPAIR TABLE {table}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int | None = None) -> History:
        """A new, empty index at ``path``. ``buckets`` is for good: as many as partitions suit the index when it is large."""
        shared_dir(spark)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/made")
        return cls(spark, path, buckets, [])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The index at ``path``, of this session or any before."""
        made = spark.read.parquet(f"{path}/made").first()
        if made["version"] != VERSION:
            raise ValueError(f"{path} is an index of version {made['version']}, not {VERSION}")
        try:
            done = sorted(r[0] for r in spark.read.schema("run int").parquet(f"{path}/runs").collect())  # one row a run
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = []
        return cls(spark, path, made["buckets"], done)

    def close(self) -> None:
        """Forgets the session's tables; the index stays."""
        for name in (self._blocks, self._texts):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def delete(self) -> None:
        """Closes the index and deletes its files."""
        self.close()
        remove(self.spark, self.path)

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(table).where(F.col("run").isin(self.done) if self.done else F.lit(False))

    def texts(self) -> DataFrame:
        """``node, root, text, s0..s3, run`` of everything accepted."""
        return self._read(self._texts)

    def blocks(self, lead: bool) -> DataFrame:
        return self._read(self._blocks).where(F.col("lead") == lead).select("key", F.col("node").alias("a"))

    def nodes(self, since: int = 0) -> DataFrame:
        """``node`` of what was accepted from run ``since`` on."""
        return self.texts().where(F.col("run") >= since).select("node")

    def _near(self, table: DataFrame, column: str, wanted: DataFrame, by: str, few: bool) -> DataFrame:
        """``table`` by itself, or only the buckets of ``wanted``, if the batch is so small that these can be named."""
        return table.where(F.col(column).isin([r[0] for r in wanted.select(by).distinct().collect()])) if few else table

    def _built(self, df: DataFrame, n: int) -> DataFrame:
        """``df`` as the side that is moved and hashed, so that the index streams past unsorted; not if a bucket would hold too many."""
        return df.hint("shuffle_hash") if n * (TABLES + 1) / self.buckets <= BUILT else df

    def _commit(self, run: int, new: DataFrame, taken: DataFrame, lead: DataFrame, later: DataFrame) -> DataFrame:
        """Writes a run: texts of ``taken``, the ``key, node`` of leads and of later nodes, and only then the run's own row."""
        view = f"history_run_{uuid.uuid4().hex[:12]}"
        parts = (
            (self._texts, new.drop("keys").join(taken, "node", "left_semi"), f"run={run}", "node", "node, root, text, s0, s1, s2, s3"),
            (self._blocks, lead, f"run={run}, lead=true", "key", "key, node"),
            (self._blocks, later, f"run={run}, lead=false", "key", "key, node"),
        )
        for table, df, part, by, cols in parts:
            df.repartition(self.buckets, by).createOrReplaceTempView(view)
            self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({part}) SELECT {cols} FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.range(run, run + 1).select(F.col("id").cast("int").alias("run")).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        self.done = [*self.done, run]
        return self.texts().where(F.col("run") == run).select("node")

    def _begin(self, rows: DataFrame) -> tuple[int, _Work, DataFrame]:
        run = max(self.done, default=-1) + 1
        work = _Work(self.spark, f"{self.path}/work-{run}")
        remove(self.spark, work.path)
        return run, work, work.store(distinct_texts(rows))

    def accept_all(self, rows: DataFrame) -> DataFrame:
        """``node`` of the rows' texts, which join the index without any check, as the history's first part does."""
        if self.done:
            raise ValueError("only an empty index takes rows without a check")
        run, work, new = self._begin(rows)
        mine = new.select(F.explode("keys").alias("key"), "node")
        # Counted where the rows lie first, so a family is no hot key.
        keyed = work.store(mine.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
        later = self._known_of(mine, keyed.where(F.col("n") > 1)).where(F.col("node") != F.col("first")).select("key", "node")
        out = self._commit(run, new, new.select("node"), keyed.select("key", F.col("first").alias("node")), later)
        remove(self.spark, work.path)
        return out

    def _known_of(self, mine: DataFrame, keyed: DataFrame) -> DataFrame:
        """``mine`` joined with what is known of its keys (``n`` rows each). Rows of very crowded keys stay where they lie."""
        hot = keyed.where(F.col("n") > HOT)
        if not 0 < hot.count() <= HOT_KEYS:
            return mine.join(keyed, "key")
        cold = mine.join(F.broadcast(hot.select("key")), "key", "left_anti").join(keyed.where(F.col("n") <= HOT), "key")
        return cold.unionByName(mine.join(F.broadcast(hot), "key"))

    def ingest(self, rows: DataFrame) -> DataFrame:
        """``node`` of the batch's texts that are new, which join the index."""
        run, work, new = self._begin(rows)
        n = new.count()
        few = n * (TABLES + 1) <= LITERALS
        mine = new.select(F.explode("keys").alias("key"), "node")
        own = mine.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
        known = self._near(self.blocks(True), "key", mine, "key", few)
        keyed = work.store(self._built(own, n).join(known, "key", "left"))
        touched = work.store(self._known_of(mine, keyed.where((F.col("n") > 1) | F.col("a").isNotNull())))

        pairs = touched.select(F.coalesce("a", "first").alias("a"), F.col("node").alias("b"), F.col("a").isNotNull().alias("old")).where("old or a != b").distinct()
        links = self._verified(work, pairs, new, n)
        # A node first in all of its keys, with none in the index, is new for certain.
        after = touched.where(F.col("a").isNotNull() | (F.col("first") != F.col("node"))).select("node").distinct().withColumn("held", F.lit(True))
        state = new.select("node").join(after, "node", "left").na.fill(False, ["held"])
        leader = state.where("not held").select(F.col("node").alias("a"))
        sure = links.where("old").select("b").unionByName(links.where("not old").join(leader, "a", "left_semi").select("b"))
        sure = sure.select(F.col("b").alias("node")).distinct().withColumn("gone", F.lit(True))
        state = work.store(state.join(sure, "node", "left").na.fill(False, ["gone"]))
        taken, open_ = state.where("not held").select("node"), state.where("held and not gone").select("node")
        if open_.head(1):
            taken = taken.unionByName(self._undecided(work, work.store(touched.join(open_, "node", "left_semi").select("key", "node", "a")), open_, new, n))

        clear = keyed.where((F.col("n") == 1) & F.col("a").isNull()).select("key", F.col("first").alias("node")).join(taken, "node", "left_semi")
        kept = touched.join(taken, "node", "left_semi").select("key", "node", "a")
        lead = work.store(kept.where(F.col("a").isNull()).groupBy("key").agg(F.min("node").alias("node")))
        later = kept.select("key", "node").join(lead, ["key", "node"], "left_anti")
        out = self._commit(run, new, taken, clear.select("key", "node").unionByName(lead), later)
        remove(self.spark, work.path)
        return out

    def _verified(self, work: _Work, pairs: DataFrame, new: DataFrame, n: int) -> DataFrame:
        """Of ``a, b, old`` the pairs that are alike: equal roots, or signatures within the bound and then texts that are near."""
        side = lambda df, p: df.select(F.col("node").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("root", "text", *SIGNATURE)])
        apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SIGNATURE), F.lit(0))
        same = F.col("a_root") == F.col("b_root")
        old = self._built(pairs.where("old"), n)
        hist = self._near(self.texts(), "node", old, "a", n * (TABLES + 1) <= LITERALS)
        both = old.join(side(hist, "a"), "a").unionByName(pairs.where("not old").join(side(new, "a"), "a")).join(side(new, "b"), "b")
        # Short texts have no signature: the comparison is null, and only the root counts.
        both = both.where(same | (apart <= MOST_BITS)).select("a", "b", "old", same.alias("same"), *[F.when(~same, F.col(f"{p}_text")).alias(f"{p}_text") for p in "ab"])
        return work.store(both.mapInArrow(_compare, "a bigint, b bigint, old boolean"))

    def _undecided(self, work: _Work, held: DataFrame, open_: DataFrame, new: DataFrame, n: int) -> DataFrame:
        """``node`` accepted of ``open_``, whose keys are ``held`` (``key, node, a``).

        Rounds of leaders first, while any key is crowded: a node that is first in all its
        keys and has none in the index is accepted for certain, and what is alike to it is
        settled against it alone. The rest is held against the later nodes of its keys in
        the index and against one another. Keys of few nodes give single pairs, crowded
        ones slices that are compared inside a task; nothing is left out for its size.
        """
        done: list[DataFrame] = []
        some = held.where(F.col("a").isNotNull()).select("key").distinct()
        # Only keys of nodes still open are looked up among the later nodes of the index.
        more = work.store(self.blocks(False).join(self._built(some, n), "key", "left_semi"))
        crowd = lambda: (held.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > FEW
        crowded = crowd()
        if crowded:
            gone = self._against(work, held, more, new, n, own=False).select(F.col("b").alias("node")).distinct()
            open_, held, more = work.store(open_.join(gone, "node", "left_anti")), work.store(held.join(gone, "node", "left_anti")), more.limit(0)
        for _ in range(8 if crowded else 0):
            if not crowd():
                break
            sizes = work.store(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"))
            later = self._known_of(held.select("key", "node"), sizes).where("node > first")
            later = work.store(later.select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(False).alias("old")).distinct())
            # First in all of its keys: accepted for certain, and compared here with all it shares a key with.
            front = work.store(open_.join(later.select(F.col("b").alias("node")), "node", "left_anti"))
            links = self._verified(work, later.join(front.select(F.col("node").alias("a")), "a", "left_semi"), new, n)
            done.append(front)
            gone = front.unionByName(links.select(F.col("b").alias("node")))
            open_, held = work.store(open_.join(gone, "node", "left_anti")), work.store(held.join(gone, "node", "left_anti"))
        links = self._against(work, held, more, new, n)
        settled = links.where("old").select(F.col("b").alias("node")).distinct()
        taken, same = open_.join(settled, "node", "left_anti"), None
        links = links.where("not old").select("a", "b")
        links = links.join(settled.withColumnRenamed("node", "a"), "a", "left_anti").join(settled.withColumnRenamed("node", "b"), "b", "left_anti")
        if crowded:
            full = held.groupBy("key").count().where(F.col("count") > FEW)
            roots = held.where(F.shiftright("key", BLOCK_BITS) == TABLES).join(full, "key", "left_semi").select("node").distinct()
            same = work.store(roots.join(new.select("node", "root"), "node").join(settled, "node", "left_anti"))
        while True:
            now = links
            if same is not None:
                # Of one root the earliest that is left stands for the rest, so no pairs are made.
                star = same.join(same.groupBy("root").agg(F.min("node").alias("a")), "root").where("a < node").select("a", F.col("node").alias("b"))
                now = links.unionByName(star)
            now = work.store(now.distinct())
            if not now.head(1):
                break
            heads = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_anti").distinct()
            gone = work.store(now.join(heads, "a", "left_semi").select(F.col("b").alias("node")).distinct())
            taken = taken.join(gone, "node", "left_anti")
            rest = now.join(heads, "a", "left_anti").join(gone.withColumnRenamed("node", "a"), "a", "left_anti")
            links = rest.join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
            if same is not None:
                same, links = work.store(same.join(gone, "node", "left_anti")), work.store(links)
        for d in done:
            taken = taken.unionByName(d)
        return work.store(taken)

    def _against(self, work: _Work, held: DataFrame, more: DataFrame, new: DataFrame, n: int, own: bool = True) -> DataFrame:
        """Links ``a, b, old`` of the nodes of ``held`` with the later index nodes ``more`` of their keys and, if ``own``, among themselves."""
        mine = held.select("key", "node", F.lit(False).alias("old"))
        both = mine.unionByName(more.select("key", F.col("a").alias("node"), F.lit(True).alias("old")))
        size = both.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("old")).cast("int")).alias("m")).where("n > 1 and m > 0")
        crowded = (size.agg(F.max("n")).first()[0] or 0) > FEW
        if crowded:
            # ``who`` tells keys with the same nodes, which are compared once.
            who = F.sum(F.xxhash64("node").cast("decimal(20,0)")).cast("string")
            size = work.store(size.join(both.groupBy("key").agg(who.alias("who")), "key"))
        left = (both if own else both.where("old")).select("key", F.col("node").alias("a"), "old")
        right = mine.select("key", F.col("node").alias("b"))
        if crowded:
            right = right.join(size.where(F.col("n") <= FEW).select("key"), "key", "left_semi")
        pairs = left.join(right, "key").where("old or a < b").select("a", "b", "old").distinct()
        links = self._verified(work, pairs, new, n)
        if not crowded:
            return links
        full = size.where(F.col("n") > FEW).groupBy("n", "who").agg(F.min("key").alias("key"))
        parts = F.ceil(F.col("n") / SLICE).cast("int")
        rows = both.join(full.select("key", parts.alias("parts")), "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        twos = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
        rows = rows.select("key", "node", "old", "mine", F.explode(twos).alias("t")).select("key", "node", "old", "mine", "t.i", "t.j")
        what = ("node", *SIGNATURE, "text")
        wide = rows.where("not old").join(new.select(*what), "node").unionByName(self._built(rows.where("old"), n).join(self.texts().select(*what), "node"))
        met = wide.where(F.col("s0").isNotNull()).groupBy("key", "i", "j").applyInArrow(lambda t: _meet(t, own), "a bigint, b bigint, old boolean")
        # Equal roots of the index settle a node at once; the batch's own are for the caller.
        roots = both.join(full.select("key").where(F.shiftright("key", BLOCK_BITS) == TABLES), "key")
        first = self._built(roots.where("old").select("node"), n).join(self.texts().select("node", "root"), "node").groupBy("root").agg(F.min("node").alias("a"))
        equal = roots.where("not old").select("node").join(new.select("node", "root"), "node").join(first, "root")
        equal = equal.select("a", F.col("node").alias("b"), F.lit(True).alias("old"))
        return work.store(links.unionByName(met.distinct()).unionByName(equal))
