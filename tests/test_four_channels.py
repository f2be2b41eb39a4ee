"""The registered four-channel queries against NumPy in one process."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from sigloom.functions import linalg
from sigloom.queries import matrices


@pytest.fixture(scope="module")
def data(sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    v = np.array(t["vec_id"])
    held = {"vec": v, "subject": v % 20, "event": v // 40, "label": np.array(t["label"]) % 2, "background": (v // 20) % 6 == 0, "x": np.array([np.asarray(e, np.float64) for e in t["embedding"]]).reshape(-1, 4, 16)}
    order = np.lexsort((v, held["event"], held["subject"]))
    held = {k: a[order] for k, a in held.items()}
    held["i"] = np.concatenate([np.arange(n) for n in np.bincount(held["subject"])])
    held["cov"] = linalg.oas(held["x"])
    held["means"] = np.stack([linalg.riemann_mean(held["cov"][held["subject"] == s]) for s in range(20)])
    held["general"] = linalg.riemann_mean(held["means"], np.bincount(held["subject"]).astype(float))
    return held


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: matrices.QUERIES[name](spark, sf_dir).collect()


def by_vec(data, rows, column):
    found = {r.vec_id: r[column] for r in rows}
    assert len(found) == len(data["vec"])
    return np.array([found[v] for v in data["vec"]])


def close(a, b, atol=1e-6):
    assert np.allclose(np.asarray(a, float).ravel(), np.asarray(b, float).ravel(), atol=atol), np.abs(np.asarray(a, float).ravel() - np.asarray(b, float).ravel()).max()


def votes(data, values, distance, k):
    """Leave-one-out votes: other events only, or all others where there is none; ties to the smaller candidate and label."""
    out = {}
    for s in range(20):
        own = np.flatnonzero(data["subject"] == s)
        for a in own:
            d = distance(np.repeat(values[a][None], len(own), 0), values[own])
            legal = data["event"][own] != data["event"][a]
            legal = legal if legal.any() else own != a
            near = np.lexsort((data["i"][own], np.where(legal, d, np.inf)))[: min(k, legal.sum())]
            counts = np.bincount(data["label"][own][near], minlength=2)
            out[s, data["i"][a]] = int(counts.argmax())
    return out


def f1(data, found):
    out = {}
    for s in range(20):
        t = np.array([data["label"][k] for k in np.flatnonzero(data["subject"] == s)])
        p = np.array([found[s, i] for i in data["i"][data["subject"] == s]])
        both, either = 2 * ((t == 1) & (p == 1)).sum(), (t == 1).sum() + (p == 1).sum()
        out[s] = both / either if either else 0.0
    return out


def test_means(data, run):
    close([r["mean"] for r in sorted(run("subject_means"), key=lambda r: r.subject_id)], data["means"])
    counts = np.bincount(data["subject"]).astype(float)
    wanted = [linalg.riemann_mean(np.delete(data["means"], s, 0), np.delete(counts, s)) for s in range(20)]
    close([r["mean"] for r in sorted(run("general_mean_excluding"), key=lambda r: r.fold)], wanted)


def moved(data):
    e = np.stack([linalg.transport_matrix(m, data["general"]) for m in data["means"]])[data["subject"]]
    return e @ data["cov"] @ e.swapaxes(1, 2)


def test_transport_and_tangent(data, run):
    close(by_vec(data, run("transport"), "cov"), moved(data))
    close(by_vec(data, run("tangent"), "tangent"), linalg.tangent(moved(data), data["general"]), 1e-5)


def test_whitening_and_steps(data, run):
    pooled = [linalg.oas(np.concatenate(list(data["x"][data["background"] & (data["subject"] == s)]), 1)[None])[0] for s in range(20)]
    found = sorted(run("pooled_covariance"), key=lambda r: r.subject_id)
    close([r["cov"] for r in found], pooled)
    white = np.stack([linalg.invsqrtm(c) for c in pooled])[data["subject"]] @ data["x"]
    close(by_vec(data, run("whitening"), "sample"), white, 1e-5)
    stacked = np.concatenate([white[:, :, 0:12], white[:, :, 2:14]], 1)
    close(by_vec(data, run("pipeline_steps"), "cov"), linalg.oas(stacked), 1e-5)


def test_filters(data, run):
    classes = [linalg.riemann_mean(data["cov"][data["label"] == k]) for k in (0, 1)]
    w = linalg.csp(*classes, 4)[0]
    rows = run("csp_features")
    close(by_vec(data, rows, "features"), linalg.log_variance(data["cov"], w), 1e-4)
    close(np.abs(by_vec(data, rows, "filtered")), np.abs(w @ data["cov"] @ w.T), 1e-4)


def test_votes_and_metrics(data, run):
    wanted = f1(data, votes(data, data["cov"], linalg.riemann_distance, 25))
    found = {r.subject_id: r.f1 for r in run("knn_metrics")}
    assert found == pytest.approx(wanted)
    best = sorted(wanted, key=lambda s: (-round(wanted[s], 12), s))[:10]
    assert [r.subject_id for r in run("calibrated_top_subjects")] == best
    third = votes(data, linalg.third_moments(data["x"]), lambda a, b: np.linalg.norm(a - b, axis=1), 25)
    assert {(r.subject_id, r.test): r.predicted_label for r in run("third_moment_knn")} == third
    pipelines = {(r.pipeline, r.measure): r["mean"] for r in run("compare_pipelines")}
    for k in (5, 15):
        assert pipelines[f"k{k}", "f1"] == pytest.approx(np.mean(list(f1(data, votes(data, data["cov"], linalg.riemann_distance, k)).values())))
    plain = linalg.covariances(data["x"]) + 1e-3 * np.eye(4)
    a, b = (f1(data, votes(data, c, linalg.riemann_distance, 5)) for c in (data["cov"], plain))
    assert {r.subject_id: (r.a, r.b) for r in run("preprocessing_comparison")} == {s: (pytest.approx(a[s]), pytest.approx(b[s])) for s in a}


def test_adapted_means(data, run):
    wanted = []
    for s in range(20):
        mean, n = data["general"], 1.0
        for c in data["cov"][data["subject"] == s][:24]:
            mean, n = linalg.riemann_mean(np.stack([mean, c]), np.array([n, 1.0])), n + 1
        wanted.append(mean)
    close([r["mean"] for r in sorted(run("adapt_means"), key=lambda r: r.subject_id)], wanted, 1e-5)


def test_vector_distances(data, run):
    rows = run("reference_weighted_distances")
    at = {(s, i): k for k, (s, i) in enumerate(zip(data["subject"], data["i"], strict=True))}
    a, b = (np.stack([linalg.upper(data["cov"][at[r.subject_id, r[c]]]) for r in rows]) for c in ("i", "j"))
    close([r.d for r in rows], linalg.weighted_reference_distance(a, b, data["general"]))


def test_sql_functions(data, run):
    rows = run("matrix_sql")
    assert len(rows) == 3 * len(data["vec"])
    close(by_vec(data, [r for r in rows if r.part == 1], "root"), linalg.sqrtm(data["cov"]))
    close(by_vec(data, [r for r in rows if r.part == 1], "sample"), data["x"][:, :, 5:10])


def test_points(data, run):
    found = {(r.subject_id, r.i): (r.x, r.y) for r in run("mds")}
    for s in (0, 7, 19):
        c = data["cov"][data["subject"] == s]
        d = np.stack([linalg.riemann_distance(np.repeat(c[k][None], len(c), 0), c) for k in range(len(c))])
        stress = lambda p: np.square(np.triu(np.linalg.norm(p[:, None] - p[None], axis=-1) - d, 1)).sum()  # noqa: B023, E731
        assert stress(np.array([found[s, i] for i in range(len(c))])) == pytest.approx(stress(linalg.metric_mds((d + d.T) / 2)), rel=1e-3)
