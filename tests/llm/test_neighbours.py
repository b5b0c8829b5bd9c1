import numpy as np
import pytest

neighbours = pytest.importorskip("palimpsest.llm.neighbours")


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.stack([vectors[i] for i in ids]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        order = sorted(range(len(ids)), key=lambda j: (-round(row[j], 9), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if row[j] >= least}
    return out


def clusters(rng, n_topics, per, dim=64):
    base = rng.normal(size=(n_topics, dim))
    return {f"m{t:03d}_{j:03d}": (base[t] + 0.15 * rng.normal(size=dim)).astype(np.float32) for t in range(n_topics) for j in range(per)}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1.0) for i, v in rows], "id string, vec array<float>, cos double")
    return {(r.memory_a, r.memory_b) for r in neighbours.pairs(neighbours.nearest(df, **kw)).collect()}


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)  # cells split on both sides
    vectors = clusters(np.random.default_rng(1), 40, 16)
    want = brute(vectors, 10, 0.9)
    got = run(spark, list(vectors.items()))
    assert len(want) > 500 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_exact_mode(spark):
    """Every cell within reach, every pair by its exact cosine: nothing is lost, on one level and on two."""
    rng = np.random.default_rng(7)
    vectors = {f"v{i:04d}": x for i, x in enumerate((rng.normal(size=(60, 64)).repeat(10, 0) + 0.25 * rng.normal(size=(600, 64))).astype(np.float32))}
    want = brute(vectors, 10, 0.9)
    assert len(want) > 500 and run(spark, list(vectors.items()), exact=True) == want


def test_two_levels(spark, monkeypatch):
    """With few coarse cells the second level is used; the same neighbours are found."""
    monkeypatch.setattr(neighbours, "MAX_CELLS", 4)
    monkeypatch.setattr(neighbours, "CELL", 10)
    vectors = clusters(np.random.default_rng(3), 60, 16)
    want = brute(vectors, 10, 0.9)
    got = run(spark, list(vectors.items()))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert run(spark, list(vectors.items()), exact=True) == want


def test_thousands_of_groups_that_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 4)
    monkeypatch.setattr(neighbours, "NEAR_CELLS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    vectors = clusters(np.random.default_rng(5), 2100, 3)
    got = run(spark, list(vectors.items()))
    want = {(f"m{t:03d}_{a:03d}", f"m{t:03d}_{b:03d}") for t in range(2100) for a in range(3) for b in range(a + 1, 3)}
    assert len(got & want) >= 0.9 * len(want)


def test_dirty_rows_and_copies(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=64).astype(np.float32)
    rows = [(f"c{i:02d}", v) for i in range(15)] + [("c00", v), ("near", v + 0.01), ("null", None), ("short", v[:63]), ("zero", v * 0), ("nan", np.r_[v[:63], np.nan]), ("inf", np.r_[v[:63], np.inf]), (None, v), ("far", -v)]
    got = run(spark, rows)
    names = {x for p in got for x in p}
    assert names == {f"c{i:02d}" for i in range(15)} | {"near"}
    # The ten lowest other copies are the nearest of each copy; the near vector's are the ten lowest copies.
    want = {(f"c{j:02d}", f"c{i:02d}") for i in range(15) for j in range(10) if j < i} | {(f"c{i:02d}", f"c{j:02d}") for i in range(10) for j in range(11) if i < j} | {(f"c{i:02d}", "near") for i in range(10)}
    assert got == want


def test_empty(spark):
    assert run(spark, []) == set() and run(spark, [("a", None)]) == set()


def test_codes_weigh_the_parallel_error():
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    along = []
    for aim in (0.0, 0.6):
        c = neighbours.Codec(x, 8, aim=aim)
        rest = u - c.centroids[neighbours._nearest(u, c.centroids, 1)[:, 0]]
        along.append(float(np.abs(((rest - c.decode(c.encode(u, rest))) * u).sum(1)).mean()))
    assert along[1] < 0.5 * along[0]


def test_vectors_are_placed_once(spark, monkeypatch):
    """Sizes of groups and the search read what one pass placed; the copies of vectors are deleted afterwards."""
    plans, gone, write, drop = {}, [], neighbours.materialize, neighbours.discard

    def written(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(neighbours, "materialize", written)
    monkeypatch.setattr(neighbours, "discard", lambda df: (gone.append(df.columns), drop(df)))
    vectors = clusters(np.random.default_rng(2), 20, 8)
    assert run(spark, list(vectors.items())) >= {("m000_000", "m000_001")} & brute(vectors, 10, 0.9)
    assert "MapInPandas" in plans["placed"]
    assert "MapInPandas" not in plans["cells"] and "MapInPandas" not in plans["near"]
    assert len(gone) == 1 and "vec" in gone[0]
