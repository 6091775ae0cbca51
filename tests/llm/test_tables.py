"""Merkle manifest, embedding near-duplicates and whitening against brute force, and their edge cases."""

import hashlib

import numpy as np
import pytest

from tessella.llm import merkle, multiindex, whiten

VECTORS = "vec_id long, embedding array<float>, label int, cls long, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], g, 7, 7) for i, v, g in rows], VECTORS)


# -- manifest


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def climb(nodes, arity):
    """(root, siblings by level of each node)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for i, w in enumerate(where):
            run = runs[w // arity]
            paths[i].append((run[: w % arity], run[w % arity + 1 :]))
            where[i] = w // arity
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def brute_manifest(rows, arity=2):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: h(code(r[0]), code(r[3]), code(r[2]), code(None if r[4] is None else r[4] + add), code(r[1]))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tree = {}
    for k in langs:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tree[k] = climb([leaf(r) for r in by[k]], arity)
    root, top = climb([tree[k][0] for k in langs], arity)
    out = []
    for k, above in zip(langs, top, strict=True):
        for r, path in zip(by[k], tree[k][1], strict=True):
            node = leaf(r, int(r[0] is not None and r[0] % 3 == 0))
            for left, right in path + above:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), tree[k][0], root, h(*(s for left, right in path + above for s in left + right)), node, node == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_against_brute_force(spark, arity):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(arity)
    rows = [(int(i), "x" * int(rng.integers(0, 5)) + "é", ["en", "de", "", None, "Ä"][min(4, int(rng.exponential(1.2)))], "s", int(rng.integers(9))) for i in rng.permutation(57)]
    rows += [(None, None, "en", None, None), (3, "twice", "en", "s", 1), (3, "twice", "en", "s", 1), (4, "alone", "zz", None, None)]
    df = spark.createDataFrame([(*r, "g", "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, group string, key string, idx int")
    changed = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(df, merkle.COLUMNS, "lang", "doc_id", changed, arity=arity, rows_per_part=7).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_manifest(rows, arity)


def test_manifest_levels_by_shuffles_are_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, merkle.manifest(df, merkle.COLUMNS, "lang", "doc_id").collect()))
    monkeypatch.setattr(merkle, "SMALL", 0)
    assert sorted(map(tuple, merkle.manifest(df, merkle.COLUMNS, "lang", "doc_id", rows_per_part=9).collect())) == want
    assert all(r[-1] for r in want) and merkle.manifest(df.limit(0), merkle.COLUMNS, "lang", "doc_id").count() == 0


# -- near-duplicate vectors


def brute_links(rows, least):
    ok = lambda v: v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v) and g is not None else None for _, v, g in rows]
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                n[a] += 1
                n[b] += 1
                top[find(a)] = find(b)
    least_id = {}
    for k in range(len(rows)):
        least_id[find(k)] = min(least_id.get(find(k), 10**9), rows[k][0])
    return sorted((rows[k][0], n[k], least_id[find(k)], rows[k][0] == least_id[find(k)]) for k in range(len(rows)))


def planted(rng, d=16):
    """Loose vectors, a chain, a group of near copies, copies, and vectors that link with nothing."""
    rows = [(k, rng.normal(size=d), int(rng.integers(3))) for k in range(150)]
    rows += [(200 + k, np.array([np.cos(k * 0.15), np.sin(k * 0.15), *[0] * (d - 2)]), 1) for k in range(20)]
    centre = rng.normal(size=d)
    rows += [(300 + k, centre + rng.normal(size=d) * 0.1, 2) for k in range(140)]
    rows += [(500 + k, centre, 2) for k in range(25)] + [(600 + k, 3 * centre, 1) for k in range(3)]
    rows += [(700, None, 1), (701, np.zeros(d), 1), (702, [float("nan")] + [1.0] * (d - 1), 1), (703, [None] + [1.0] * (d - 1), 1), (704, centre, None), (705, [], 1), (706, centre[:-1], 2), (707, centre[:-1], 2), (708, [1e-30] * d, 0), (709, [1e30] * d, 0)]
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("block,per_cell", [(2048, 1024), (16, 8)])
def test_embedding_links_against_brute_force(spark, block, per_cell):
    rows = planted(np.random.default_rng(3))
    got = multiindex.near_duplicates(table(spark, rows), block=block, per_cell=per_cell).collect()
    assert sorted(map(tuple, got)) == brute_links(rows, 0.98)


def test_embedding_recall_of_random_partners(spark):
    """Pairs at the least similarity itself, in random directions, in a fine grid."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t = rng.normal(size=a.shape)
    t -= (t * a).sum(1, keepdims=True) * a
    b = 0.981 * a + (1 - 0.981**2) ** 0.5 * t / np.linalg.norm(t, axis=1, keepdims=True)
    rows = [(k, v, 0) for k, v in enumerate(np.concatenate((a, b)))]
    got = multiindex.near_duplicates(table(spark, rows), per_cell=16).collect()
    assert sum(r["n_links"] for r in got) >= 0.99 * len(rows)
    assert all(r["component_id"] in (r["vec_id"], r["vec_id"] - 2000) for r in got)


def test_traversal_is_the_sorted_list_of_cells():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b, most = np.sort(rng.integers(0, 9, rng.integers(1, 8))), np.sort(rng.integers(0, 9, rng.integers(1, 8))), int(rng.integers(0, 16))
        cells = list(multiindex.traverse(a.tolist(), b.tolist(), np.arange(len(a)), np.arange(len(b)), most, 100))
        sums = [int(a[c // 100] + b[c % 100]) for c in cells]
        assert sums == sorted(sums) and len(set(cells)) == len(cells) == sum(int(x + y) <= most for x in a for y in b)


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(6)
    for _ in range(100):
        link = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.choice([0.02, 0.2, 0.8])
        r, c = forest = multiindex.forest(link)
        assert len(r) <= sum(link.shape) and all(link[x, y] for x, y in zip(*forest, strict=True))

        def parts(pairs, shape=link.shape):
            top = list(range(sum(shape)))
            for x, y in pairs:
                old, new = top[x], top[shape[0] + y]
                top = [new if t == old else t for t in top]
            return [top.index(t) for t in top]

        assert parts(zip(*np.nonzero(link), strict=True)) == parts(zip(r, c, strict=True))


def test_embedding_edges(spark):
    assert multiindex.near_duplicates(table(spark, [])).count() == 0
    rows = [(1, None, 0), (None, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, 0.0], None)]
    assert sorted(map(repr, map(tuple, multiindex.near_duplicates(table(spark, rows)).collect()))) == sorted(map(repr, [(1, 0, 1, True), (None, 0, None, False), (2, 0, 2, True), (3, 0, 3, True)]))
    rows = [(5, [1.0], 0), (5, [1.0], 0), (None, [2.0], 0), (None, [-1.0], 0)]
    assert sorted(map(repr, map(tuple, multiindex.near_duplicates(table(spark, rows)).collect()))) == sorted(map(repr, [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, False)]))


# -- whitening


def brute_whitening(x, k=4):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values / values.sum()


@pytest.mark.parametrize("d,n", [(24, 400), (3, 50), (70, 40)])
def test_whitening_against_eigh(spark, d, n):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(n, d)) * (1 + np.arange(d)) / d
    rows = [(k, x, 0) for k, x in enumerate(np.concatenate((v, v[: n // 3])))]
    rows += [(9000, None, 0), (9001, [None] + [1.0] * (d - 1), 0), (9002, [float("inf")] * d, 0), (9003, [], 0), (9004, [1.0] * (d + 1), 0)]
    got = {(r["vec_id"], r["component"]): r for r in whiten.whiten(table(spark, rows)).collect()}
    x = np.floor(256 * np.array([r[1] for r in rows[:-5]], np.float32).astype(float)).astype(np.int64)
    many, far, z, share = brute_whitening(x)
    k = min(4, d)
    assert len(got) == len(x) * k
    for c in range(k):
        mine = np.array([got[i, c + 1]["whitened"] for i in range(len(x))])
        assert min(np.abs(mine - z[:, c]).max(), np.abs(mine + z[:, c]).max()) < 1e-9
        assert abs(got[0, c + 1]["explained"] / share[c] - 1) < 1e-9
    assert all(r["n"] == many and r["deviation"] == far[i] and r["identity_error"] < 1e-9 for (i, _), r in got.items())


def test_subspace_iteration_on_close_and_equal_values():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    values = np.concatenate(([5.0, 5.0, 3.0, 2.999], np.linspace(2.9, 0, 56)))
    m = (q * values) @ q.T
    found, axes = whiten.leading(lambda b: m @ b, 60, 4)
    assert np.abs(found - values[:4]).max() < 1e-12 and np.abs(m @ axes - axes * found).max() < 1e-10 and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12
    assert 0 <= whiten.lowest(lambda b: m @ b, 60, 10, 1) <= 1e-12 or whiten.lowest(lambda b: m @ b, 60, 10, 1) < 0.2


def test_whitening_edges(spark):
    assert whiten.whiten(table(spark, [])).count() == 0
    assert whiten.whiten(table(spark, [(1, None, 0), (2, [None], 0)])).count() == 0
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)])).count() == 0  # no variance
    line = whiten.whiten(table(spark, [(k, [float(k), 2.0 * k, 0.0], 0) for k in range(5)])).collect()  # one dimension
    assert {r["component"] for r in line} == {1} and len(line) == 5 and abs(line[0]["explained"] - 1) < 1e-12
    far = whiten.whiten(table(spark, [(1, [3e7], 0), (2, [-3e7], 0), (3, [0.0], 0)])).collect()
    assert {r["vec_id"]: r["deviation"] for r in far} == {1: (3 * 256 * 30_000_000) ** 2 if (3 * 256 * 30_000_000) ** 2 < 2**63 else None, 2: None if (3 * 256 * 30_000_000) ** 2 >= 2**63 else (3 * 256 * 30_000_000) ** 2, 3: 0}
