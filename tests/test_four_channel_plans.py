"""Registered four-channel jobs over subjects, against NumPy and SciPy-free plain versions in one process."""

import numpy as np
import pytest
from test_four_channels import close, data, f1, run, votes  # noqa: F401

from sigloom.functions import linalg, stats
from sigloom.plans import evaluate as E


def pair_steps(data):
    """Per subject the distances of rows 2p and 2p + 1, and the second's score."""
    out = {}
    for s in range(20):
        own = np.flatnonzero(data["subject"] == s)
        own = own[: len(own) // 2 * 2]
        d = linalg.riemann_distance(data["cov"][own[::2]], data["cov"][own[1::2]])
        out[s] = d, ((data["vec"][own[1::2]] % 101) / 100)
    return out


def spearman(x, y):
    a, b = stats.mid_rank(np.asarray(x, float)), stats.mid_rank(np.asarray(y, float))
    return np.corrcoef(a, b)[0, 1]


def test_pair_distances_against_order_and_score(data, run):
    steps, quality = pair_steps(data), f1(data, votes(data, data["cov"], linalg.riemann_distance, 5))
    by_index = {r.subject_id: r for r in run("pair_distance_vs_index")}
    by_score = {r.subject_id: r for r in run("pair_distance_vs_score")}
    for s, (d, score) in steps.items():
        assert by_index[s].rho == pytest.approx(spearman(d, np.arange(len(d))), abs=1e-6) and by_index[s].f1 == pytest.approx(quality[s], abs=1e-6)
        assert by_score[s].rho == pytest.approx(spearman(d, score), abs=1e-6)
        random = np.random.default_rng(s)
        b = stats.mid_rank(score)
        found = stats.correlations(stats.mid_rank(d), np.stack([random.permutation(b) for _ in range(4000)]))
        p = min(1.0, 2 * min((found >= by_score[s].rho - 1e-12).mean(), (found <= by_score[s].rho + 1e-12).mean()))
        assert by_score[s].p_permutation == pytest.approx(p, abs=0.06)
        stars = by_score[s].p_permutation
        assert by_score[s].stars == ("***" if stars < 0.001 else "**" if stars < 0.01 else "*" if stars < 0.05 else "")


def test_tangent_votes_of_other_subjects(data, run):
    vectors = linalg.tangent(data["cov"], data["general"])
    found = {(r.subject_id, r.test): r.predicted_label for r in run("tangent_knn_loso")}
    wrong = 0
    for a in range(len(vectors)):
        others = np.flatnonzero(data["subject"] != data["subject"][a])
        d = np.linalg.norm(vectors[others] - vectors[a], axis=1)
        near = others[np.argsort(d, kind="stable")[:25]]
        weight = np.bincount(data["label"][near], 1 / np.sort(d, kind="stable")[:25], minlength=2)
        wrong += found[data["subject"][a], data["i"][a]] != weight.argmax() and abs(weight[0] - weight[1]) > 1e-6
    assert len(found) == len(vectors) and wrong == 0


def test_channels_shares_against_precision(data, run):
    found = {(r.channel, r["filter"]): r for r in run("channel_contribution")}
    guessed = votes(data, data["cov"], linalg.riemann_distance, 5)
    power, precision = {}, {}
    for s in range(20):
        own = data["subject"] == s
        t, p = data["label"][own], np.array([guessed[s, i] for i in data["i"][own]])
        precision[s] = ((t == 1) & (p == 1)).sum() / max(1, (p == 1).sum())
        if len({*t.tolist()}) == 2:
            means = [linalg.riemann_mean(data["cov"][own][t == k]) for k in (0, 1)]
            power[s] = np.abs(linalg.csp(*means, 4)[1])
    for (channel, k), r in found.items():
        x = np.array([(p[k, channel] - p[k].min()) / (np.ptp(p[k]) or 1) for p in power.values()])
        wanted = np.corrcoef(x, [precision[s] for s in power])[0, 1]
        assert r.n == len(power) and r.r == pytest.approx(wanted, abs=1e-4)


@pytest.mark.parametrize("name", ["losocv_summary", "adaptation_eval", "rf_classify_loso", "score_regression", "mds_two_stage", "eye_removal"])
def test_job_runs_over_all_its_rows(data, run, name):
    rows = run(name)
    wanted = {"losocv_summary": 1, "adaptation_eval": 20, "score_regression": 20}.get(name, len(data["vec"]))
    assert len(rows) == wanted
    if name == "adaptation_eval":
        assert {r.subject_id: r.num_samples for r in rows} == {s: 3 * int(((data["subject"] == s) & ~data["background"]).sum()) for s in range(20)}
    if name == "losocv_summary":
        assert 0 <= rows[0]["min"] <= rows[0]["q1"] <= rows[0]["median"] <= rows[0]["q3"] <= rows[0]["max"] <= 1
    if name == "eye_removal":
        assert all(np.isfinite(r["sample"]).all() for r in rows)


def test_rows_are_predicted_from_what_came_before(data, run):
    """The registered job on four channels: its first rows by a plain loop."""
    found = {(r.subject_id, r.i): r.predicted_proba for r in run("csp_losocv")}
    assert len(found) == len(data["vec"])
    counts = np.bincount(data["subject"])
    s = 3
    others = [o for o in range(20) if o != s]
    general = linalg.riemann_mean(data["means"][others], counts[others].astype(float))
    e = {o: linalg.transport_matrix(data["means"][o], general) for o in others}
    classes = []
    for y in (0, 1):
        own = {o: data["cov"][(data["subject"] == o) & (data["label"] == y)] for o in others}
        own = {o: c for o, c in own.items() if len(c)}
        classes.append(linalg.riemann_mean(np.stack([e[o] @ linalg.riemann_mean(c) @ e[o].T for o, c in own.items()]), np.array([len(c) for c in own.values()], float)))
    w, lift = linalg.csp(*classes, 4)[0], E.rbf_lift(4)
    design = lambda c: np.concatenate([lift(linalg.log_variance(c, w)), np.ones((len(c), 1))], 1)
    train = [k for k in range(len(data["vec"])) if data["subject"][k] != s]
    x, y, beta = design(np.stack([e[data["subject"][k]] @ data["cov"][k] @ e[data["subject"][k]].T for k in train])), data["label"][train], np.zeros(65)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * len(y) * np.eye(65), x.T @ (y - p) - 1e-3 * len(y) * beta)
    mean, total, cap = None, float(counts[others].sum()), np.floor(counts[others].mean())
    for n, k in enumerate(np.flatnonzero(data["subject"] == s)):
        c = data["cov"][k]
        if n + 1 <= cap:
            mean = c if mean is None else linalg.geodesic(mean, c, 1 / (n + 1))
            general, total = linalg.geodesic(general, c, 1 / (total + 1)), total + 1
        t = linalg.transport_matrix(mean, general)
        close(found[s, n], 1 / (1 + np.exp(-(design((t @ c @ t.T)[None])[0] @ beta))), 1e-4)
