import numpy as np
from pyspark.sql import functions as F

from loamworks.llm import embed_dedup, shared
from loamworks.llm.shared import spanning_edges


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def roots_of(n, i, j):
    label = np.arange(n)
    child, root = spanning_edges(i, j, n)
    label[child] = root
    return label


def block_of(x, times, base=None):
    tree = embed_dedup.cover_tree(x)
    order = np.argsort(tree[0][:, -1], kind="stable")
    return embed_dedup.Block(x[order], tuple(t[order] for t in tree), times[order], 0.95, base), order


def test_screens_and_whole_nodes_lose_no_link():
    """Spread, tight and mixed groups, with and without directions: counts and classes as by brute force."""
    rng = np.random.default_rng(0)
    for dim, groups, scale in ((3, 5, 0.3), (8, 30, 0.25), (40, 3, 0.02), (64, 40, 0.03), (64, 1, 0.5)):
        centers = rng.normal(size=(groups, dim)) / np.sqrt(dim)
        x = unit(centers[rng.integers(groups, size=1200)] + rng.normal(scale=scale, size=(1200, dim)))
        x = x[np.argsort(x @ x[0] > x @ x[1], kind="stable")]  # so that the blocks lie apart
        times, near = rng.integers(1, 4, 1200), x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        base = np.linalg.qr(rng.normal(size=(dim, 20)))[0] if dim > 20 else None
        (a, at_a), (b, at_b) = block_of(x[:500], times[:500], base), block_of(x[500:], times[500:], base)
        counts, edges = np.zeros(1200, np.int64), []
        for p, q, ids in ((a, a, at_a), (b, b, at_b + 500), (a, b, np.concatenate([at_a, at_b + 500]))):
            found, (i, j) = embed_dedup.dual_links(p, q, 0.95)
            counts[ids] += found
            edges.append((ids[i], ids[j]))
        assert (counts == near @ times).all()
        assert (roots_of(1200, *map(np.concatenate, zip(*edges))) == roots_of(1200, *np.nonzero(near))).all()


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    """Vectors without groups, dealt into many blocks: both sides are read from what was written, and each block is written once."""
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(600, 64)))
    x[300:310] = unit(x[:10] + rng.normal(scale=0.005, size=(10, 64)))
    plans, whole = [], shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df, n=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, n))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_vectors(rows, 0.95, block=50)
    assert got.filter("n_links > 0").agg(F.count("*"), F.sum("n_links"), F.sum("component_id")).first()[:] == (20, 20, 90)
    assert len(plans) == 1 and "CartesianProduct" in plans[0] and "Exchange" not in plans[0]


def test_cells_share_blocks_and_blocks_of_one_dimension_meet(spark, monkeypatch):
    """More cells than blocks, some cells larger than a block, two dimensions, and zeros of both signs: links and classes as by brute force."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(9, 30))
    x = unit(np.concatenate([centers[rng.integers(9, size=500)] + rng.normal(scale=0.3, size=(500, 30)), centers[:1] + rng.normal(scale=0.02, size=(300, 30))]))
    x[:20, 0], x[20:40] = -0.0, x[:20]
    x[20:40, 0] = 0.0
    vectors = [r.tolist() for r in x] + [r[:7].tolist() for r in x]
    near = np.zeros((1600, 1600), bool)
    for at, u in ((0, unit(x)), (800, unit(x[:, :7]))):
        near[at : at + 800, at : at + 800] = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embed_dedup, "CELL", 50)
    got = embed_dedup.near_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>"), 0.95, block=200).toPandas().sort_values("vec_id")
    assert len(got) == 1600 and (got["n_links"].to_numpy() == near.sum(1)).all()
    assert (got["component_id"].to_numpy() == roots_of(1600, *np.nonzero(near))).all()
