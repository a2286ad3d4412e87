import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import gridjoin

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n string, pos string, block string"


def brute(rows, cosine=0.93):
    """Row by row with a plain loop; rows of one id are one vertex."""
    ok = [r[0] is not None and r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], dtype=np.float32).astype(float) if k else None for r, k in zip(rows, ok, strict=True)]
    unit = [None if u is None else u / np.sqrt(np.sum((u / abs(u).max()) ** 2)) / abs(u).max() for u in unit]
    links, near = [0] * len(rows), defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                near[rows[i][0]].add(rows[j][0])
                near[rows[j][0]].add(rows[i][0])
    low = {}
    for start in sorted(k for k in {r[0] for r in rows} if k is not None):
        stack = [start]
        while stack:
            at = stack.pop()
            if at not in low:
                low[at] = start
                stack += near[at]
    return Counter((r[0], n, low[r[0]] if k else r[0], (low[r[0]] if k else r[0]) == r[0]) for r, n, k in zip(rows, links, ok, strict=True))


def cloud(seed, n, dim=12, spread=0.09, labels=(1, 2)):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((max(2, n // 12), dim))
    rows = []
    for i in range(n):
        v = centers[rng.integers(len(centers))] + rng.standard_normal(dim) * spread * rng.integers(1, 4)
        rows.append((i * 3 + 1, v.astype(np.float32).tolist(), int(rng.choice(labels))))
    return rows


def odd():
    rows = cloud(1, 150)
    v = rows[0][1]
    rows += [(2000 + i, None, 1) for i in range(2)] + [(2010, [], 1), (2011, [0.0] * 12, 1), (2012, [None] + v[1:], 1), (2013, [math.nan] + v[1:], 1),
             (2014, [math.inf] + v[1:], 1), (2015, v, None), (None, v, rows[0][2]), (2016, v[:5], rows[0][2]), (2017, v[:5], rows[0][2]),
             (2018, [x * 2 for x in v], rows[0][2]), (2019, [-0.0] + [1.0] * 11, 7), (2020, [0.0] + [1.0] * 11, 7), (2021, [1e-30] * 12, 7), (2022, [3e37] * 12, 7)]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], rows[6][2])]
    rows += [(3000 + i, [1.0, 2.0, 3.0] + [0.0] * 9, 5) for i in range(120)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", "p", "b") for r in rows], SCHEMA).repartition(3)


def tight(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(i, (np.ones(dim) + rng.standard_normal(dim) * 0.01).astype(np.float32).tolist(), 1) for i in range(n)]
    return rows + [(n + i, (np.ones(dim) + rng.standard_normal(dim) * 0.35).astype(np.float32).tolist(), 1) for i in range(n)]


@pytest.mark.parametrize("rows", [odd(), tight(4, 250), cloud(9, 300, dim=3, labels=(1,))], ids=["odd", "tight", "flat"])
def test_links_and_components_against_brute_force(spark, rows, monkeypatch):
    """With blocks of 16 rows, so that several levels of intervals are joined."""
    monkeypatch.setattr(gridjoin, "LEAF_ROWS", 16)
    monkeypatch.setattr(gridjoin, "BLOCK_NUMBERS", 16)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in gridjoin.near_vectors(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_recursion_inside_a_pair_of_blocks(monkeypatch):
    monkeypatch.setattr(gridjoin, "LEAF_ROWS", 8)
    eps = math.sqrt(2 - 2 * 0.93)
    for seed in range(5):
        rows = np.array([r[1] for r in cloud(seed, 200, dim=6) + tight(seed, 40, dim=6)])
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        rows = rows[np.lexsort(np.floor(rows[:, ::-1] / eps).T)]
        a, b = rows[:130], rows[130:]
        grid = lambda u: u[:, :3]
        assert (gridjoin.linked(a, b, grid, 0.93, eps) == (a @ b.T >= 0.93)).all()
        want = rows @ rows.T >= 0.93
        np.fill_diagonal(want, False)
        assert (gridjoin.linked(rows, None, grid, 0.93, eps) == want).all()


def test_long_vectors_and_empty_table(spark):
    rows = cloud(5, 40, dim=700)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in gridjoin.near_vectors(frame(spark, rows)).collect())
    assert got == brute(rows)
    assert gridjoin.near_vectors(frame(spark, [])).count() == 0
