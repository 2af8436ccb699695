"""Work and vectors sent for the nearest vectors: they follow the rows, not the rows times the leaves."""

import numpy as np

from vidsift.llm import vector_neighbours as vn


def scenes(n, dims, seed, blur=0.35):
    """Scenes of ten like vectors, far from one another."""
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(n // 10, dims)), 10, axis=0) + blur * rng.normal(size=(n, dims))


def found(spark, x, **more):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = vn.nearest_vectors(d, vec_id="vec_id", vector="v", dims=x.shape[1], **more).select("vec_id", "neighbour_id", "neighbour_rank").collect()
    assert len(got) == 5 * len(x) and len({(r.vec_id, r.neighbour_id) for r in got}) == len(got)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2.0)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    return np.mean([r.neighbour_id in want[r.vec_id] for r in got])


def test_a_row_is_sent_to_few_shards(spark, monkeypatch):
    """Visits to leaves that each hold a row once sent each of these rows to some fifteen shards."""
    plans, least = [], vn.Plan.least
    monkeypatch.setattr(vn.Plan, "least", lambda *a: plans.append(least(*a)) or plans[-1])
    x = scenes(6000, 48, 1, blur=0.6)
    assert found(spark, x, leaf_rows=32, shard_rows=300) >= 0.98
    assert plans[0].sent <= 8 * len(x)


def test_vectors_without_any_order(spark):
    """Noise: neighbours lie anywhere, so rows ask in most leaves, and each neighbour comes once."""
    assert found(spark, np.random.default_rng(2).normal(size=(1500, 24)), leaf_rows=64, shard_rows=200) >= 0.98


def test_near_leaves_without_looking_at_all_nodes():
    """With room for all leaves all come, nearest first; with room for a few, few nodes are compared."""
    u = scenes(20_000, 24, 3)
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    tree = vn.fit_tree(u, len(u), leaf_rows=8, branches=8)
    at = np.argsort(tree.leaf)[(tree.leaf < 0).sum() :]  # the leaves' nodes, by number
    some = tree.near(u[:50], tree.leaves)
    assert (np.sort(some, axis=1) == np.arange(tree.leaves)).all()
    sims = np.take_along_axis(u[:50] @ tree.centroid[at].T, some, 1)
    assert (np.diff(sims, axis=1) <= 1e-6).all()

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, key):
            out = np.asarray(self)[key]
            Counted.seen += len(out)
            return out

    tree.centroid = tree.centroid.view(Counted)
    few = tree.near(u[:1], 8)
    assert few.shape == (1, 8) and (few >= 0).all() and Counted.seen < tree.leaves / 4
