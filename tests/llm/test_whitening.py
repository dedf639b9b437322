import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspan.llm import queries
from twinspan.llm.whitening import SCALE, SHIFT, covariance, identity_error, jacobi, principal_axes, scatter, totals, whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    """Exact sums in whole numbers, eigenvectors by numpy."""
    x = [[int(np.floor(np.float64(c) * SCALE)) + SHIFT for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x, strict=True)]
    dev = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    v = np.array([[sum(r[i] * r[j] for r in dev) / n**3 for j in range(d)] for i in range(d)], np.float64)
    return n, s, [sum(a * a for a in row) for row in dev], v, np.array([[a / n for a in row] for row in dev])


def _random(n, d, seed=3):
    make = np.random.default_rng(seed)
    return (make.normal(size=(n, d)) @ (make.normal(size=(d, d)) * np.geomspace(1, 0.02, d))).astype(np.float32)


def test_jacobi_has_small_eigenvalues_to_full_precision():
    make = np.random.default_rng(1)
    # a well-conditioned matrix scaled from both sides: its eigenvalues span 24 orders of magnitude
    b = make.normal(size=(12, 12))
    scale = np.geomspace(1, 1e-12, 12)
    a = scale[:, None] * (b @ b.T / 12 + np.eye(12)) * scale
    values, vectors = jacobi(a)
    from fractions import Fraction

    # the determinant, exactly, is the product of the eigenvalues
    m = [[Fraction(float(x)) for x in row] for row in a]
    det = Fraction(1)
    for i in range(12):
        det *= m[i][i]
        for r in range(i + 1, 12):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    assert abs(float(det) / float(np.prod(values)) - 1) < 1e-10
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-13
    # each small one, by the inverse's largest
    inverse, _ = jacobi(np.linalg.inv(scale[:, None] * b @ b.T * scale / 12 + np.diag(scale**2)))
    assert np.isclose(1 / inverse.max(), values.min(), rtol=1e-6)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 16, 33])
def test_jacobi_as_numpy(d):
    make = np.random.default_rng(d)
    b = make.normal(size=(d, d + 2))
    values, vectors = jacobi(b @ b.T)
    assert np.allclose(np.sort(values), np.linalg.eigvalsh(b @ b.T), rtol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, b @ b.T)


def test_jacobi_of_odd_matrices():
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert jacobi(np.zeros((0, 0)))[0].shape == (0,)
    one = np.ones((5, 5))
    assert np.allclose(np.sort(jacobi(one)[0]), [0, 0, 0, 0, 5])
    assert np.allclose(jacobi(np.diag([3.0, 3.0, 3.0]))[0], 3)


@pytest.mark.parametrize(("n", "d", "scale"), [(300, 12, 1), (40, 5, 1), (50, 3, 3e7), (60, 3, 1e13)])
def test_whitening_as_a_plain_one(spark, n, d, scale):
    vectors = _random(n, d) * np.float32(scale)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    count, sums, deviations, v, centred = plain(vectors)
    own = df.select(F.col("embedding").alias("v"))
    t = totals(own)
    assert (t.n, t.sums) == (count, sums)
    assert (covariance(scatter(own, t), t) == v).all()  # exact up to one rounding
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    found = whiten(df).collect()
    some = min(8, d)
    assert len(found) == n * some
    values = np.zeros((n, some))
    for r in found:
        values[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]]
        assert np.isclose(r["explained"], e[r["component"] - 1] / np.trace(v), rtol=1e-9)
    expected = centred @ (u[:, :some] / np.sqrt(e[:some]))
    sign = np.sign((values * expected).sum(0))
    assert np.allclose(values, expected * sign, rtol=1e-6, atol=1e-8)
    assert np.abs(np.cov(values.T, bias=True) - np.eye(some)).max() < 1e-9
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_results_do_not_depend_on_partitions(spark):
    vectors = _random(200, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    one, many = (sorted(map(tuple, whiten(df.repartition(k)).drop("identity_error").collect())) for k in (1, 9))
    assert one == many


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 2.0]), (1, [3.0, 1.0]), (None, [0.5, 4.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [-inf, 0.0]), (8, []), (9, [2.0, 2.0]), (9, [2.0, 2.0])]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "_v", "whitened", "deviation", "component", "n", "_at", "explained")})
    found = whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 1), (9, 2), (9, 2)]
    assert {r["n"] for r in found} == {5}


@pytest.mark.parametrize("made", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance(spark, made):
    found = whiten(spark.createDataFrame(made, SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_one_axis_without_variance_is_left_out(spark):
    found = whiten(spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(9)], SCHEMA)).collect()
    assert {r["component"] for r in found} == {1} and np.isclose(found[0]["explained"], 1)


def test_lengths_must_agree(spark):
    for parts in (1, 4):
        with pytest.raises(Exception, match="different lengths"):
            whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 4.0]), (4, [2.0])], SCHEMA).repartition(parts)).collect()


def test_query(spark):
    found = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    count, _, deviations, v, centred = plain([r["embedding"] for r in table])
    e, u = np.linalg.eigh(v)
    expected = centred @ (u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]))
    values, place = np.zeros((count, 8)), {r["vec_id"]: i for i, r in enumerate(table)}
    rows = found.collect()
    assert len(rows) == 8 * count and dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["n"] == "bigint" and dict(found.dtypes)["component"] == "int"
    for r in rows:
        values[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[place[r["vec_id"]]] and r["identity_error"] < 1e-9
    assert np.allclose(np.abs(values), np.abs(expected), atol=1e-8)


def test_identity_error_sees_a_wrong_scale(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([-1.0, 2.0],)], "whitened array<double>")
    assert np.isclose(identity_error(df, 2), 3)


def test_axes_are_by_falling_eigenvalue(spark):
    axes = principal_axes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_random(100, 10))], SCHEMA), "embedding", 10)
    assert (np.diff(axes.values) <= 0).all() and np.isclose(axes.values.sum(), axes.trace)
