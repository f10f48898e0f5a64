import numpy as np
import pytest

from corpusloom.llm import clusters, neighbours, partition


def frame(spark, x, keys=None):
    keys = keys or [f"k{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(k, v.tolist(), 0) for k, v in zip(keys, x)], "key string, vec array<float>, cell int")


def found(spark, x, node=100):
    """Nodes above ``node`` rows are split by passes over all rows, smaller ones in a task."""
    rows = clusters.units(frame(spark, x))
    leaves = clusters.divide(rows, node=node)
    return clusters.confirm(clusters.assign(leaves, rows).cache(), rows), rows


def blobs(rng, sizes, dim=32, noise=0.04):
    parts = []
    for s in sizes:
        c = rng.normal(size=dim)
        parts.append(c / np.linalg.norm(c) + rng.normal(scale=noise, size=(s, dim)))
    return np.vstack(parts).astype(np.float32)


def components(x, limit):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close, label = u @ u.T >= limit, {}
    for i in range(len(x)):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += np.nonzero(close[j])[0].tolist()
    return label


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(clusters, "CELL", 120)
    monkeypatch.setattr(clusters, "HELD", 32)
    monkeypatch.setattr(clusters, "WAVE", 3)
    monkeypatch.setattr(clusters, "SEEDS", 8)


def test_clusters_equal_components(spark, small_cells):
    rng = np.random.default_rng(1)
    x = np.vstack([blobs(rng, [260, 40, 25, 10, 5, 3, 2, 2]), rng.normal(size=(350, 32)).astype(np.float32)])
    x *= rng.uniform(0.5, 3, size=(len(x), 1)).astype(np.float32)
    got = {r["key"]: r["cluster"] for r in found(spark, x)[0].collect()}
    label = components(x, 0.75)
    want = {f"k{i:05d}": f"k{c:05d}" for i, c in label.items() if sum(v == c for v in label.values()) > 1}
    assert got == want


def test_clusters_of_nothing_and_of_one_direction(spark, small_cells):
    x = np.ones((400, 32), np.float32)
    assert found(spark, x[:0])[0].count() == 0
    assert found(spark, x[:1])[0].count() == 0
    got = found(spark, x)[0].collect()
    assert len(got) == 400 and {r["cluster"] for r in got} == {"k00000"}


def test_chains_are_not_confirmed(spark):
    angle = np.radians([0, 35, 70, 200, 205])
    x = np.zeros((5, 32), np.float32)
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    got = found(spark, x)[0]
    assert {r["key"] for r in got.collect()} == {"k00003", "k00004"}


def test_describe(spark):
    rng = np.random.default_rng(2)
    x = blobs(rng, [30, 7])
    got, vecs = found(spark, x)
    rows = {r["cluster"]: r for r in clusters.describe(got.join(vecs, "key"), 32).collect()}
    assert {c: r["size"] for c, r in rows.items()} == {"k00000": 30, "k00030": 7}
    u = x[:30] / np.linalg.norm(x[:30], axis=1, keepdims=True)
    centre = u.mean(0) / np.linalg.norm(u.mean(0))
    assert np.allclose(rows["k00000"]["centroid"], centre, atol=1e-5)
    assert rows["k00000"]["typical"] == [f"k{i:05d}" for i in np.argsort(-(u @ centre))[:3]]


def test_bisect_splits_what_is_not_compact():
    rng = np.random.default_rng(3)
    x = blobs(rng, [50, 50, 50])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaves, spread = partition.bisect(x, 3, least=2)
    assert sorted(len(l) for l in leaves) == [50, 50, 50] and max(spread) < 5
    assert partition.bisect(x[:0], 5) == ([], [])
    y = np.vstack([x, rng.normal(size=(300, 32))]).astype(np.float32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    leaf = clusters.bisect(y, 0.75)
    close = y @ y.T
    assert all(close[np.ix_(leaf == i, leaf == i)].min() >= 0.75 for i in np.unique(leaf))
    assert sorted(np.bincount(leaf))[-3:] == [50, 50, 50]
    assert len(clusters.bisect(y[:0], 0.75)) == 0


@pytest.mark.parametrize("wave", [1, 512])
def test_the_tree_holds_every_row(spark, monkeypatch, wave):
    monkeypatch.setattr(clusters, "WAVE", wave)
    rng = np.random.default_rng(6)
    x = np.vstack([blobs(rng, [500, 90]), rng.normal(size=(400, 32)).astype(np.float32)])
    rows = clusters.units(frame(spark, x))
    tree, counts, compact = clusters.grow(rows, 0.75, len(x), 100)
    child, _, _ = tree.frozen()
    ends = {i for i in range(len(child)) if child[i, 0] < 0}
    assert set(counts) == ends and sum(counts.values()) == len(x)
    assert all(n <= 100 for i, n in counts.items() if i not in compact)
    leaves = {r["key"]: (r["leaf"], r["seen"]) for r in clusters.divide(rows, node=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = {}
    for k, (leaf, _) in leaves.items():
        groups.setdefault(leaf, []).append(int(k[1:]))
    assert len(leaves) == len(x)
    assert all(len(g) == leaves[k][1] and int(k[1:]) == min(g) and (u[g] @ u[g].T).min() >= 0.7499 for k, g in groups.items())


def test_every_row_is_in_a_cluster(spark):
    angle = np.radians([0, 35, 70, 200, 205, 300])
    x = np.zeros((6, 32), np.float32)
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    rows = clusters.units(frame(spark, x))
    leaves = clusters.divide(rows)
    all_ = clusters.divided(leaves, clusters.confirm(clusters.assign(leaves, rows), rows))
    sizes = sorted(r["size"] for r in clusters.describe(all_.join(rows, "key"), 32).collect())
    assert sum(sizes) == 6 and sizes in ([1, 1, 2, 2], [1, 1, 1, 1, 2])


@pytest.mark.parametrize("size", [150, 8192])
def test_neighbours_recall(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "BIN", size)
    monkeypatch.setattr(neighbours, "QUERIES", 300)
    rng = np.random.default_rng(4)
    x = np.vstack([blobs(rng, [300, 60, 40], dim=64, noise=0.1), rng.normal(size=(400, 64)).astype(np.float32)])
    got = {}
    for r in neighbours.nearest(frame(spark, x)).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["other"], r["cosine"]))
    assert all(sorted(a for a, _, _ in v) == [1, 2, 3, 4, 5] for v in got.values()) and len(got) == len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = neighbours.brute_force(u, np.arange(len(u)))
    hit = sum(len({f"k{j:05d}" for j in exact[i]} & {o for _, o, _ in got[f"k{i:05d}"]}) for i in range(len(u)))
    assert hit / exact.size >= 0.9
    assert all(k not in {o for _, o, _ in v} for k, v in got.items())


def test_neighbours_where_few_rows_are_scored(spark, monkeypatch):
    """Families and loosely structured vectors at the shipped number of lists asked."""
    monkeypatch.setattr(neighbours, "BIN", 1000)
    rng = np.random.default_rng(14)
    x = np.vstack([blobs(rng, [3000, *[12] * 700], dim=64, noise=0.08), rng.normal(size=(600, 64)).astype(np.float32) @ np.diag(0.97 ** np.arange(64))]).astype(np.float32)
    rows = clusters.units(frame(spark, x))
    assert neighbours.Index(rows, len(x), 600, neighbours.PROBES).scored_share() < 0.15
    got = {}
    for r in neighbours.nearest(rows, lists=600).collect():
        got.setdefault(int(r["key"][1:]), set()).add(int(r["other"][1:]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = np.concatenate([np.arange(0, 3000, 10), np.arange(3000, len(x), 25)])
    exact = neighbours.brute_force(u, some)
    assert sum(len(set(e) & got[i]) for i, e in zip(some, exact)) / exact.size >= 0.9


def test_neighbours_of_few(spark):
    x = np.eye(32, dtype=np.float32)
    assert neighbours.nearest(frame(spark, x[:0])).count() == 0
    assert neighbours.nearest(frame(spark, x[:1])).count() == 0
    assert neighbours.nearest(frame(spark, x[:3])).count() == 6
    same = neighbours.nearest(frame(spark, np.ones((9, 32), np.float32))).collect()
    assert len(same) == 45


def test_codes_come_close():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    books = neighbours.codebooks(x)
    back = neighbours.decode(neighbours.encode(x, books), books)
    assert ((x - back) ** 2).sum() / (x**2).sum() < 0.2


def exact(x, limit=0.75):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = {}
    for i, c in components(x, limit).items():
        groups.setdefault(c, []).append(i)
    return {f"k{i:05d}": f"k{min(g):05d}" for g in groups.values() if len(g) > 1 and (u[g] @ u[g].T).min() >= limit for i in g}


def beside(rng, v, cos):
    """A vector at the cosine ``cos`` to the unit vector ``v``."""
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def outsider(rng, x, r, low=0.77, high=0.8):
    """A vector within the limit of row ``r`` of the unit vectors ``x`` and of no other."""
    for _ in range(10_000):
        q = beside(rng, x[r], rng.uniform(low, high))
        if (x @ q >= 0.74).sum() == 1:
            return q
    raise AssertionError


def test_an_outsider_of_one_member_in_another_slice(spark, small_cells):
    rng = np.random.default_rng(11)
    parts = []
    for _ in range(6):
        # Each family is three slices, and has one outsider near one member only.
        c = rng.normal(size=64)
        x = np.stack([beside(rng, c / np.linalg.norm(c), 0.94) for _ in range(300)])
        parts += [x, outsider(rng, x, 7)[None]]
    x = np.vstack(parts).astype(np.float32)
    assert {r["key"]: r["cluster"] for r in found(spark, x)[0].collect()} == exact(x) == {}


def test_links_between_rows_that_share_no_cell(spark, small_cells):
    rng = np.random.default_rng(12)
    lone = rng.normal(size=(1500, 64))
    lone /= np.linalg.norm(lone, axis=1, keepdims=True)
    x = np.vstack([lone, [beside(rng, v, 0.77) for v in lone[:400]]]).astype(np.float32)
    got, want = {r["key"]: r["cluster"] for r in found(spark, x)[0].collect()}, exact(x)
    assert len(want) == 800 and got == want


def test_groups_with_one_near_pair_across(spark, monkeypatch):
    """Rows of two found groups that only a comparison of their rows can join, in blocks."""
    monkeypatch.setattr(clusters, "CELL", 16)
    monkeypatch.setattr(clusters, "UNITS", 2)
    rng = np.random.default_rng(13)
    a = np.stack([beside(rng, np.eye(64)[0], 0.94) for _ in range(50)])
    q = outsider(rng, a, 7, 0.76, 0.77)
    far = rng.normal(size=64)
    x = np.vstack([a, q[None], [beside(rng, q, 0.995) for _ in range(3)], [beside(rng, far / np.linalg.norm(far), 0.95) for _ in range(5)]]).astype(np.float32)
    rows = clusters.units(frame(spark, x))
    parts = {f"k{i:05d}": "k00000" if i < 50 else "k00050" if i < 54 else "k00054" for i in range(len(x))}
    merged = spark.createDataFrame(list(parts.items()), "key string, label string")
    got = {(r["key"], r["label"]) for r in clusters._across(merged, rows, 0.75).collect()}
    assert got == {("k00050", "k00000"), ("k00000", "k00000")}
