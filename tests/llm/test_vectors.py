"""Top-k search and near-duplicate vectors against brute force."""

import math
import random

import numpy as np
from corpora import with_clashes

from tillscope.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=160, d=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).astype(np.float32).tolist(), 0) for i in range(n)]
    for i in range(0, 60):  # copies and near copies, many of one vector
        rows.append((1_000 + i, [x + (0.01 * rng.normal() if i % 2 else 0) for x in rows[7][1]], 0))
    rows += [(2_000, None, 1), (2_001, [None] * d, 1), (2_002, [float("nan")] * d, 1), (2_003, [float("inf")] + [0.0] * (d - 1), 1), (2_004, [0.0] * d, 1), (None, [1.0] * d, 1)]
    rows += [(2_005, [2.0] * 5, 1), (2_006, [2.0] * 5, 1), (2_020, [2.0] * 5, 1), (2_020, [2.0] * 5, 1), (2_040, [], 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [r for r in rows if r[0] is not None]


def valid(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark):
    df, rows = table(spark)
    found = {}
    for r in topk.every_twentieth(with_clashes(df), topk.Search(k=5, lists=3, chunk_rows=40, block_rows=6)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    vectors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if valid(v)]
    queries = {(i, tuple(v)) for i, v in vectors if i % 20 == 0}
    assert set(found) == {i for i, _ in queries}
    for i, v in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in vectors if j != i))[:5]
        assert sorted(found[i]) == [(k + 1, -s, j) for k, (s, j) in enumerate(scores)]


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(20, [1.0, 2.0], 0), (21, [1e30, -1e30], 0)], SCHEMA)
    rows = topk.every_twentieth(few).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [(20, 1, 21)]
    assert topk.every_twentieth(few.limit(0)).count() == 0


def brute_components(x, ids, threshold=0.9):
    near = x @ x.T >= threshold
    labels = list(range(len(ids)))

    def root(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        labels[max(root(a), root(b))] = min(root(a), root(b))
    smallest = {}
    for i in range(len(ids)):
        smallest[root(i)] = min(smallest.get(root(i), ids[i]), ids[i])
    return near.sum(1) - 1, [smallest[root(i)] for i in range(len(ids))]


def test_near_duplicate_vectors(spark):
    df, rows = table(spark)
    good = [(i, v) for i, v, _ in rows if valid(v) and any(v)]
    x = np.zeros((len(good), 12))
    for k, (_, v) in enumerate(good):
        x[k, : len(v)] = np.float32(v)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, component = brute_components(x, [i for i, _ in good])
    expected = sorted([(i, int(n), c, i == c) for (i, _), n, c in zip(good, links, component, strict=True)]
                      + [(i, 0, i, True) for i, v, _ in rows if not (valid(v) and any(v))])
    for cells in (embed_dedup.Cells(), embed_dedup.Cells(cell_rows=40, reach=0.4473, block_rows=16)):
        found = embed_dedup.near_duplicates(with_clashes(df), cells).where("vec_id is not null")
        assert sorted(tuple(r) for r in found.collect()) == expected
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_default_reach(spark):
    """Hard links of cosine just over the threshold, in cells much smaller than the default's."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.91 * a + math.sqrt(1 - 0.91**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), embed_dedup.Cells(cell_rows=60)).agg({"n_links": "sum"}).first()[0]
    assert found >= 0.9 * 1_200


def test_all_links_in_many_cells_of_few_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1_000, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for threshold in (0.9, 0.8):
        found = embed_dedup.near_duplicates(df, embed_dedup.Cells(threshold=threshold, cell_rows=10, exact=True)).agg({"n_links": "sum"}).first()[0]
        assert found == int((u @ u.T >= threshold).sum()) - len(u)


def test_measured_recall_in_many_cells(spark):
    """Links found at the measured reach among brute-force ones: isotropic vectors and noisy copies, few to many dimensions."""
    rng = np.random.default_rng(8)
    for d in (4, 16, 64):
        base = rng.normal(size=(500, d))
        noisy = base[:300] + 0.35 * rng.normal(size=(300, d)) * np.linalg.norm(base[:300], axis=1, keepdims=True) / math.sqrt(d)
        x = np.concatenate([base, noisy]).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        all_links = int((u @ u.T >= 0.9).sum()) - len(u)
        found = embed_dedup.near_duplicates(df, embed_dedup.Cells(cell_rows=16, probes=200)).agg({"n_links": "sum"}).first()[0]
        assert 0.95 * all_links <= found <= all_links, (d, found, all_links)


def test_unite_keeps_smallest_labels():
    rng = random.Random(2)
    pairs = np.array([(rng.randrange(50), rng.randrange(50)) for _ in range(30)])
    labels = embed_dedup.unite(np.arange(50), pairs[:, 0], pairs[:, 1])
    assert all(labels[a] == labels[b] for a, b in pairs) and all(labels[i] <= i for i in range(50))
