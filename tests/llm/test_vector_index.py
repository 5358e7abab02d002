"""The pivot-permutation index: order matters, every length is indexed, extremes, blocks and both kinds of lists."""

import numpy as np
import pytest

from lexaudit.llm import vector_dedup as v


def brute(x, threshold=0.95):
    """(n_links, component) of each vector; only vectors of one length meet."""
    n = len(x)
    u = [np.array(r, float) / np.abs(r).max() for r in x]
    u = [r / np.linalg.norm(r) for r in u]
    near = [[j for j in range(n) if j != i and len(x[i]) == len(x[j]) and u[i] @ u[j] >= threshold] for i in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in near[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    return [(len(r), c) for r, c in zip(near, comp, strict=True)]


def groups(rng, dims, centres, each):
    return [list(map(float, c + rng.normal(size=dims) * s)) for c in rng.normal(size=(centres, dims)) for s in [0, *rng.uniform(0, 0.5, each)]]


@pytest.mark.parametrize("levels", [1, 2])
def test_recall_and_exact_counts(spark, levels):
    rng = np.random.default_rng(levels)
    x = groups(rng, 16, 150, 7)
    x += [list(map(float, r)) for r in rng.normal(size=16) + rng.normal(size=(200, 16)) * 0.03]  # one dense group
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in v.near_vectors(df, block=64, levels=levels).collect()}
    want = brute(x)
    assert len(got) == len(x) and all(got[i].n_links <= want[i][0] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want)
    assert sum(got[i].component_id == want[i][1] for i in got) >= 0.99 * len(x)


def test_every_length_is_indexed(spark):
    rng = np.random.default_rng(7)
    x = groups(rng, 8, 40, 4) + groups(rng, 12, 30, 3) + groups(rng, 3, 2, 2) + [[1.0], [2.0], [-1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in v.near_vectors(df, block=100).collect()}
    want = brute(x)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want)
    assert all(got[i].n_links <= want[i][0] for i in got) and got[len(x) - 2].component_id == len(x) - 3 and got[len(x) - 1].n_links == 0


def test_extreme_components(spark):
    x = [[1e300, 1e300, 0.0], [1e-300, 1e-300, 0.0], [5e-324, 5e-324, 0.0], [1.7e308, 1.7e308, 1.0], [0.0, 0.0, 1e-320], [0.0, -0.0, 3.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.near_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4)}


def test_order_of_pivots_decides():
    a = np.array([[0, 1, 2, 3]], np.uint16)
    b = np.array([[0, 1, 2, 3], [1, 0, 2, 3], [3, 2, 1, 0], [4, 5, 0, 1], [4, 5, 6, 0]], np.uint16)
    assert v.similar(a, b, 2, 1.0).tolist() == [[True, True, True, True, False]]
    assert v.similar(a, b, 2, 0.3).tolist() == [[True, True, False, False, False]]


def test_pairs_count_in_one_list():
    rng = np.random.default_rng(3)
    d = np.array([rng.permutation(12)[:6] for _ in range(80)], np.uint16)
    k = np.arange(80)
    for levels in (1, 2):
        names = v.list_names(d, levels)
        for i in range(80):
            for j in range(i):
                meets = [(a, b) for a, b in ((i, j), (j, i)) if names[a, 0] in names[b]]
                counted = sum(bool(v.here(d[[a]], d[[b]], k[[a]], k[[b]], levels)[0]) for a, b in meets)
                assert counted == bool(meets)


def test_kind_of_lists_does_not_follow_the_size():
    assert v.near_vectors.__kwdefaults__["levels"] == 1 and not hasattr(v, "levels_for")
