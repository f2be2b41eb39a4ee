import math

import numpy as np
import pytest

from sigloom.functions import filters, linalg, matrix, stats


@pytest.fixture
def covs():
    return linalg.oas(np.random.RandomState(1).normal(size=(12, 4, 40)) * np.array([1, 2, 3, 4])[:, None])


def test_distance_is_a_metric_and_invariant(covs):
    a, b = covs[:6], covs[6:]
    d = linalg.riemann_distance(a, b)
    assert np.allclose(linalg.riemann_distance(a, a), 0, atol=1e-7)
    assert np.allclose(d, linalg.riemann_distance(b, a))
    w = np.random.RandomState(2).normal(size=(4, 4))
    assert np.allclose(d, linalg.riemann_distance(w @ a @ w.T, w @ b @ w.T))


def test_distance_of_diagonal_matrices():
    d = linalg.riemann_distance(np.diag([1.0, 2.0])[None], np.diag([3.0, 5.0])[None])
    assert np.isclose(d[0], math.sqrt(math.log(3) ** 2 + math.log(2.5) ** 2))


def test_mean_of_diagonal_matrices_is_geometric():
    c = np.array([np.diag([1.0, 4.0]), np.diag([9.0, 1.0])])
    assert np.allclose(linalg.riemann_mean(c), np.diag([3.0, 2.0]))


def test_transport_sends_mean_to_general(covs):
    e = linalg.transport_matrix(covs[0], covs[1])
    assert np.allclose(e @ covs[0] @ e.T, covs[1])


def test_csp_diagonalises_both_classes(covs):
    w, patterns = linalg.csp(covs[0], covs[1], 4)
    for c in covs[:2]:
        d = w @ c @ w.T
        assert np.allclose(d, np.diag(np.diag(d)), atol=1e-8)
    assert np.allclose(w @ patterns.T, np.eye(4), atol=1e-8)


def test_tangent_norm_is_distance(covs):
    v = linalg.tangent(covs[1:], covs[0])
    assert np.allclose(np.linalg.norm(v, axis=1), linalg.riemann_distance(np.repeat(covs[:1], 11, 0), covs[1:]))


def test_upper_round_trip(covs):
    assert np.allclose(linalg.from_upper(linalg.upper(covs)), covs)


def test_mds_reproduces_plane_points():
    x = np.random.RandomState(3).normal(size=(15, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    y = linalg.metric_mds(d)
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=-1), d, atol=1e-5)


def test_ica_unmixes():
    t = np.linspace(0, 8 * np.pi, 4000)
    s = np.stack([np.sign(np.sin(3 * t)), ((t * 1.7) % 1) - 0.5])
    unmix = linalg.independent_components(np.array([[1, 0.6], [0.4, 1]]) @ s)
    found = unmix @ np.array([[1, 0.6], [0.4, 1]])
    assert np.allclose(np.sort(np.abs(found) / np.abs(found).max(1, keepdims=True), axis=1)[:, 0], 0, atol=0.1)


def test_third_moments_of_symmetric_data_vanish():
    x = np.random.RandomState(4).normal(size=(2, 3, 2000))
    both = np.concatenate([x, -x], 2)
    assert np.allclose(linalg.third_moments(both), 0, atol=1e-10)


def test_filter_in_chunks_is_filter_in_one():
    sections = filters.butter_bandpass(4, 40, 250)
    x = np.random.RandomState(5).normal(size=(3, 400))
    whole, _ = filters.sosfilt(sections, x)
    first, state = filters.sosfilt(sections, x[:, :150])
    second, _ = filters.sosfilt(sections, x[:, 150:], state)
    assert np.allclose(np.concatenate([first, second], 1), whole)


def test_band_pass_gain():
    sections = filters.butter_bandpass(4, 40, 250)
    assert sections.shape == (4, 6)
    for hz, least, most in ((15, 0.99, 1.001), (4, 0.70, 0.715), (40, 0.70, 0.715), (1, 0, 0.02), (110, 0, 0.01)):
        z = np.exp(-2j * np.pi * hz / 250)
        gain = abs(np.prod([(s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2) for s in sections]))
        assert least <= gain <= most, (hz, gain)


def test_decimation_keeps_constants():
    assert np.isclose(filters.decimation_taps(4).sum(), 1) and len(filters.decimation_taps(4)) == 81


@pytest.mark.parametrize(("r", "n", "p"), [(0.5, 20, 0.02476), (0.0, 10, 1.0), (0.9, 5, 0.03739), (-0.3, 50, 0.03430)])
def test_p_values(r, n, p):
    assert abs(stats.p_of_correlation(r, n) - p) < 5e-4


def test_p_value_is_null_where_undefined():
    assert math.isnan(stats.p_of_correlation(float("nan"), 10)) and math.isnan(stats.p_of_correlation(0.3, 2)) and stats.p_of_correlation(1.0, 9) == 0


def test_mid_ranks():
    assert stats.mid_rank(np.array([3, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]


def test_shaped_takes_rows_of_many_sizes_and_nulls(spark):
    df = spark.createDataFrame([(1, [4.0]), (2, [4.0, 0.0, 0.0, 9.0]), (3, None)], "i int, c array<double>")
    out = {r.i: r.s for r in df.select("i", matrix.matrix_function("c", "sqrtm").alias("s")).collect()}
    assert out[1] == [2.0] and np.allclose(out[2], [2, 0, 0, 3]) and out[3] is None


@pytest.mark.parametrize("n", [3, 4, 6])
def test_eigenvalues_of_many_matrices_by_rotations(n):
    """As LAPACK finds them, also where values repeat, where entries are nothing and beside a missing matrix."""
    random = np.random.default_rng(n)
    x = random.normal(size=(300, n, 2 * n))
    c = np.concatenate([x @ x.swapaxes(1, 2), np.eye(n)[None], 3 * np.eye(n)[None], np.diag(np.arange(1.0, n + 1))[None]])
    slow = lambda a, b: np.stack([linalg.riemann_distance(np.repeat(k[None], len(b), 0), b) for k in a])
    assert np.allclose(linalg.riemann_distances(c[-60:], c), slow(c[-60:], c), atol=1e-11)
    entries = {(i, j): c[:, i, j].copy() for i in range(n) for j in range(i, n)}
    assert np.allclose(np.sort(np.stack(linalg.rotated_values(entries, n), -1)), np.linalg.eigvalsh(c), rtol=1e-12)
    found = linalg.riemann_distances(c[:2], np.concatenate([c[:3], np.full((1, n, n), np.nan)]))
    assert np.isnan(found[:, 3]).all() and np.allclose(found[:, :3], slow(c[:2], c[:3]), atol=1e-7)
