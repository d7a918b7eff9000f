"""Whitening against numpy's full eigendecomposition and exact whole numbers."""

import math

import numpy as np
import pytest

from tidewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"
INF, NAN = float("inf"), float("nan")


def vectors(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    made = (rng.standard_normal((n, d)) * np.linspace(5, 0.5, d) + 3).astype(np.float32)
    made[: n // 3] = made[0]  # a third are copies
    return [(i, row.tolist()) for i, row in enumerate(made)]


def reference(rows):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(v) for v in ((n * x - sums) ** 2).sum(axis=1)]
    z = (x - np.array([s / n for s in sums])).astype(float)
    values, found = np.linalg.eigh(z.T @ z / n)
    return deviation, z, values[::-1], found[:, ::-1]


def check(spark, rows, kept, components):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), components).collect()
    deviation, z, values, found = reference(kept)
    some = min(components, int((values > values.sum() * 1e-12).sum()))
    assert len(got) == len(kept) * some
    by = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(by[kept[-1][0], k + 1].whitened / (z[-1] @ found[:, k])) for k in range(some)]
    for i, (v, _) in enumerate(kept):
        for k in range(some):
            r = by[v, k + 1]
            assert (r.n, r.deviation) == (len(kept), deviation[i])
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert r.whitened * signs[k] == pytest.approx(z[i] @ found[:, k] / math.sqrt(values[k]), abs=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("components", [4, 32])
def test_whitened_against_eigh(spark, components):
    rows = vectors()
    check(spark, rows, rows, components)


def test_odd_vectors_are_left_out(spark):
    good = vectors(60, 5)
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [NAN] * 5), (94, [1.0, INF, 0.0, 0.0, 0.0]), (95, [-INF] * 5), (96, [1.0] * 4)]
    check(spark, odd + good, good, 3)


def test_fewer_components_where_there_is_no_variance(spark):
    flat = [(i, [*v[:3], 7.0, 7.0]) for i, v in vectors(50, 5)]
    check(spark, flat, flat, 5)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        out = whitening.whitened(df)
        assert out.collect() == [] and out.columns[0] == "vec_id"


def test_null_and_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, v) for _, v in vectors(40, 4)] + [(7, [0.0, 1.0, 2.0, 3.0])] * 2, SCHEMA)
    for name in ("x", "n", "high", "low", "at", "part", "component", "whitened"):
        df = df.selectExpr("*", f"'{name}' AS {name}")
    got = whitening.whitened(df, 2).collect()
    assert len(got) == 84 and sum(r.vec_id == 7 for r in got) == 4


def test_huge_entries_have_no_deviation_but_do_not_fail(spark):
    rows = [*vectors(30, 3), (99, [3e38, 0.0, -3e38])]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA), 2).collect()
    # next to that variance, all other is rounding
    assert len(got) == 31 and {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def test_sums_beyond_a_long(spark):
    rows = [(i, [7e13, -7e13]) for i in range(5000)]
    found = whitening.blocks(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.sums == [5000 * (math.floor(64 * 7e13) + 1_000_000), 5000 * (math.floor(64 * -7e13) + 1_000_000)]


@pytest.mark.parametrize(("d", "wanted", "seed"), [(64, 32, 1), (150, 10, 2), (200, 32, 3), (40, 40, 4), (1, 1, 5)])
def test_jacobi_davidson_reaches_double_precision(d, wanted, seed):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((4 * d, d)) * np.exp(np.linspace(1, -1, d))
    a = z.T @ z / len(z)
    passes = []

    def product(columns):
        passes.append(columns.shape[1])
        return a @ columns

    values, found = whitening.eigenpairs(product, d, wanted)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:wanted], rtol=1e-12)
    assert np.abs(a @ found - found * values).max() < 1e-13 * values[0]
    assert np.abs(found.T @ found - np.eye(wanted)).max() < 1e-13
    print(d, wanted, len(passes), "passes")


def test_equal_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((50, 50)))[0]
    a = q @ np.diag([9.0] * 5 + [4.0] * 10 + [1.0] * 35) @ q.T
    values, found = whitening.eigenpairs(lambda b: a @ b, 50, 12)
    assert np.allclose(values, [9.0] * 5 + [4.0] * 7) and np.abs(found.T @ found - np.eye(12)).max() < 1e-12


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(3)
    z = rng.standard_normal((30, 30))
    a, right = z + z.T, rng.standard_normal((30, 3))
    shifts = np.array([0.3, -1.0, 50.0])
    got = whitening.minres(lambda v: a @ v, lambda v: v, shifts, right, 60)
    for k, s in enumerate(shifts):
        assert np.allclose((a - s * np.eye(30)) @ got[:, k], right[:, k], atol=1e-6)
