import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import linalg, matrix, stats
from sigloom.operators import windows as W
from sigloom.plans import evaluate as E
from sigloom.plans.pipeline import Step, fit_next, partial_fit, run_pipeline, transform
from sigloom.sources.staging import stage


@pytest.fixture(scope="module")
def epochs(spark):
    """Three subjects, two classes that differ in the power of two channels."""
    random = np.random.RandomState(0)
    rows = []
    for subject in range(3):
        mix = np.eye(3) + 0.2 * random.normal(size=(3, 3))
        for i in range(24):
            label = i % 2
            x = mix @ (random.normal(size=(3, 60)) * np.array([3.0 if label else 1.0, 1.0, 1.0 if label else 3.0])[:, None])
            rows.append((subject, i // 2, i, label, 1.0, i % 8 == 0, 3, 60, x.ravel().tolist()))
    return spark.createDataFrame(rows, "subject_id long, event_id long, vec_id long, label long, sample_weight double, is_background boolean, n_channels int, n_times int, sample array<double>")


@pytest.fixture(scope="module")
def rows(epochs):
    return stage(E.with_covariance(epochs, 3), "rows")


def test_means_transport_and_whitening(spark, epochs, rows):
    held = rows.collect()
    by = {s: np.array([r.cov for r in held if r.subject_id == s]).reshape(-1, 3, 3) for s in range(3)}
    means = {r.subject_id: r for r in matrix.subject_means(rows).collect()}
    for s, c in by.items():
        assert np.allclose(np.reshape(means[s]["mean"], (3, 3)), linalg.riemann_mean(c), atol=1e-6) and means[s].n == 24
    table = stage(matrix.subject_means(rows), "m")
    general = matrix.general_mean(table)
    g = np.reshape(general.first()["mean"], (3, 3))
    moved = matrix.subject_means(matrix.parallel_transport(rows, table, general)).collect()
    assert all(np.allclose(np.reshape(r["mean"], (3, 3)), g, atol=1e-5) for r in moved)
    others = {r.fold: np.reshape(r["mean"], (3, 3)) for r in matrix.general_mean_excluding(table).collect()}
    assert np.allclose(others[0], linalg.riemann_mean(np.stack([np.reshape(means[s]["mean"], (3, 3)) for s in (1, 2)])), atol=1e-6)
    w = {r.subject_id: r for r in matrix.pooled_covariance(epochs, ["subject_id"], 3).collect()}
    for s in range(3):
        x = np.concatenate([np.reshape(r.sample, (3, 60)) for r in held if r.subject_id == s], 1)
        assert np.allclose(np.reshape(w[s]["cov"], (3, 3)), linalg.oas(x[None])[0])
        v = np.reshape(w[s].whitening, (3, 3))
        assert np.allclose(v @ np.reshape(w[s]["cov"], (3, 3)) @ v.T, np.eye(3))


def test_neighbours_within_and_across(rows):
    for votes in (E.riemannian_knn_loo(rows, 3), E.riemannian_knn_loso(rows, 3), E.tangent_knn_loso(rows, matrix.general_mean(matrix.subject_means(rows)), 3)):
        held = votes.collect()
        assert len(held) == 72 and np.mean([v.true_label == v.predicted_label for v in held]) > 0.9


def test_filters_and_classifiers(rows):
    judged = E.csp_losocv(rows, 2).collect()
    assert len(judged) == 72 and np.mean([r.label == r.predicted_label for r in judged]) > 0.9
    forest = E.rf_classify_loso(rows, matrix.general_mean(matrix.subject_means(rows)), trees=10).collect()
    assert len(forest) == 72 and np.mean([r.label == r.predicted_label for r in forest]) > 0.7


def test_logistic_fit_of_groups(spark):
    random = np.random.RandomState(1)
    data = []
    for g, w in ((1, [2.0, -1.0]), (2, [-1.0, 0.5])):
        for x in random.normal(size=(400, 2)):
            data.append((g, x.tolist(), int(random.rand() < 1 / (1 + np.exp(-(x @ w + 0.3))))))
    df = spark.createDataFrame(data, "g int, x array<double>, y int")
    beta = {r.g: np.array(r.beta) for r in E.logistic_fit(df, "g", "x", "y", 2, ridge=1e-6).collect()}
    assert np.allclose(beta[1], [2, -1, 0.3], atol=0.5) and np.allclose(beta[2], [-1, 0.5, 0.3], atol=0.5)


def test_adaptation(spark, epochs, rows):
    metrics = E.adaptation_eval(epochs, 3, True, parts=2, filters=2).collect()
    assert len(metrics) == 3 and all(m.f1 > 0.7 for m in metrics)
    start = rows.select("subject_id").distinct().withColumns({"mean": F.lit(np.eye(3).ravel().tolist()), "n": F.lit(1.0), "cap": F.lit(4.0)})
    adapted = {r.subject_id: r for r in E.adapt_means_batch(rows, start).collect()}
    mean, n = np.eye(3), 1.0
    for c in [np.reshape(r.cov, (3, 3)) for r in rows.filter("subject_id = 0").orderBy("i").collect()][:3]:
        mean, n = linalg.riemann_mean(np.stack([mean, c]), np.array([n, 1.0])), n + 1
    assert adapted[0].n == 4 and np.allclose(np.reshape(adapted[0]["mean"], (3, 3)), mean)


def test_elimination_drops_the_worst(spark):
    bad = [(s, t, o, c, 1.0 + c, t % 2, (t % 2) if s != 2 else 1 - t % 2) for s in range(4) for t in range(6) for o in range(4) if o != s for c in range(3)]
    df = spark.createDataFrame(bad, "subject_id long, test long, other long, candidate long, d double, true_label int, label int")
    out = E.sequential_elimination(df, 2, 3).collect()
    assert out[0].removed == 2 and out[0].f1 == 1.0 and len(out) == 2


def test_permutation_p(spark):
    random = np.random.RandomState(2)
    data = [(1, float(i), float(i) + 0.1 * random.rand()) for i in range(30)] + [(2, random.rand(), random.rand()) for _ in range(30)] + [(3, float(i), 1.0) for i in range(5)] + [(4, 1.0, 2.0)] + [(5, float(i), float(i)) for i in range(5)]
    out = {r.g: r for r in E.permutation_test(spark.createDataFrame(data, "g int, x double, y double"), "g", "x", "y", 499, block=100).collect()}
    assert out[1].p == pytest.approx(2 / 500) and out[2].p > 0.05 and out[3].p is None and out[4].rho is None
    assert out[5].rho == pytest.approx(1) and out[5].p == pytest.approx(2 * 1 / 120)
    assert {r.g: r.p for r in E.permutation_test(spark.createDataFrame(data, "g int, x double, y double"), "g", "x", "y", 499, block=100).collect()} == {g: r.p for g, r in out.items()}


def test_exact_permutation_p_is_that_of_all_pairings(spark):
    from itertools import permutations

    random = np.random.RandomState(7)
    data = [(g, float(a), float(b)) for g, n in ((1, 5), (2, 6), (3, 7)) for a, b in zip(random.randint(0, 6, n), random.randint(0, 6, n), strict=True)]
    out = {r.g: r for r in E.permutation_test(spark.createDataFrame(data, "g int, x double, y double"), "g", "x", "y", block=300).collect()}
    for g in (1, 2, 3):
        x, y = (stats.mid_rank(np.array([r[c] for r in data if r[0] == g])) for c in (1, 2))
        rho = np.corrcoef(x, y)[0, 1]
        every = np.array([np.corrcoef(x, y[list(p)])[0, 1] for p in permutations(range(len(x)))])
        wanted = min(1.0, 2 * min((every >= rho - 1e-12).mean(), (every <= rho + 1e-12).mean()))
        assert out[g].rho == pytest.approx(rho) and out[g].p == pytest.approx(wanted)


def test_scores_are_predicted_from_other_folds(spark):
    random = np.random.RandomState(8)
    data = [(i, x.tolist(), float(x[0] > 0.5) + 0.5 * float(x[1] > 0.5)) for i, x in enumerate(random.rand(200, 3))]
    out = E.score_regression_cv(spark.createDataFrame(data, "i long, x array<double>, y double"), "x", "y", trees=20).collect()
    y, p = np.array([r.y for r in out]), np.array([r.predicted_score for r in out])
    assert len(out) == 200 and 1 - np.square(y - p).sum() / np.square(y - y.mean()).sum() > 0.8


def test_eyes_are_removed(spark):
    random = np.random.RandomState(3)
    blink = np.repeat(random.rand(1, 40) < 0.2, 25, 1) * 8.0
    brain = random.uniform(-1, 1, size=(3, 1000))
    x = np.concatenate([brain, np.zeros((1, 1000))]) + np.array([[1.0], [0.9], [0.1], [0.0]]) * blink + np.array([[0], [0], [0.5], [-0.5]]) * random.laplace(size=(1, 1000))
    df = spark.createDataFrame([(1, x.ravel().tolist())], "subject_id long, sample array<double>")
    clean = np.reshape(matrix.eye_removal_apply(df, matrix.eye_removal_fit(df, 4, (0, 1), (2, 3))).first().sample, (4, 1000))
    assert abs(np.corrcoef(clean[0], blink[0])[0, 1]) < 0.5 < abs(np.corrcoef(x[0], blink[0])[0, 1])


def test_components_by_rounds_equal_those_of_one_task(spark):
    random = np.random.RandomState(5)
    rows = [(g, (np.array([[1, 0.5, 0.2], [0.3, 1, 0.4], [0.1, 0.2, 1]]) @ random.laplace(size=(3, 400))).ravel().tolist()) for g in (1, 1, 2)]
    rows.append((2, [float("nan")] * 1200))
    df = spark.createDataFrame(rows, "subject_id long, sample array<double>")
    one = {r.subject_id: r for r in matrix.eye_removal_fit(df, 3, (0, 1), (1, 2)).collect()}
    many = {r.subject_id: r for r in matrix.eye_removal_fit(df, 3, (0, 1), (1, 2), largest=0).collect()}
    assert one[1].n == 800 and one[2].n == 400 and set(one) == set(many) == {1, 2}
    assert all(np.allclose(one[g].cleaning, many[g].cleaning, atol=1e-6) for g in one)
    x = np.concatenate([np.reshape(r[1], (3, -1)) for r in rows[:2]], 1)
    unmix = linalg.independent_components(x)
    found = np.reshape(one[1].cleaning, (3, 3))
    keeps = [np.linalg.inv(unmix) @ np.diag([0.0 if k in drop else 1.0 for k in range(3)]) @ unmix for drop in ((0, 1), (0, 2), (1, 2), (0,), (1,), (2,))]
    assert min(np.abs(found - k).max() for k in keeps) < 1e-4


def test_points_by_rounds_fit_as_those_of_one_task(spark):
    random = np.random.RandomState(6)
    points = {g: random.normal(size=(40, 2)) * (2, 1) for g in (1, 2)}
    noise = {g: np.abs(random.normal(size=(40, 40))) * 0.05 for g in points}
    d = {g: np.linalg.norm(p[:, None] - p[None], axis=-1) + np.triu(noise[g], 1) for g, p in points.items()}
    pairs = spark.createDataFrame([(g, i, j, float(d[g][i, j])) for g in points for i in range(40) for j in range(i + 1, 40)], "subject_id long, i long, j long, d double")

    def stress(out):
        total = {}
        for g in points:
            x = np.array([[r.x, r.y] for r in sorted((r for r in out if r.subject_id == g), key=lambda r: r.i)])
            now = np.linalg.norm(x[:, None] - x[None], axis=-1)
            total[g] = np.square(np.triu(now - d[g], 1)).sum()
        return total

    one, many = matrix.mds_embed(pairs, tolerance=1e-4).collect(), matrix.mds_embed(pairs, largest=0, tolerance=1e-4).collect()
    assert len(one) == len(many) == 80
    a, b = stress(one), stress(many)
    assert all(b[g] == pytest.approx(a[g], rel=1e-6) for g in a) and max(a.values()) < 10
    assert np.allclose([[r.x, r.y] for r in sorted(one)], [[r.x, r.y] for r in sorted(many)], atol=1e-6)


def test_points_of_several_blocks_in_one_task_and_by_rounds(spark):
    """Points from blocks of distances, and from pairs with other indexes, are those of one matrix, and groups of one point have none."""
    random = np.random.RandomState(7)
    x = {1: random.normal(size=(259, 4, 9)), 2: random.normal(size=(3, 4, 9)), 3: random.normal(size=(1, 4, 9))}
    c = {g: v @ v.swapaxes(1, 2) for g, v in x.items()}
    rows = spark.createDataFrame([(g, i, m.ravel().tolist()) for g in c for i, m in enumerate(c[g])], "subject_id long, i long, cov array<double>")
    blocks = stage(E.riemann_blocks(rows), "blocks")
    assert {(r.g, r.p, r.q): len(r.block) for r in blocks.collect()} == {(1, 0, 0): 8 * 256**2, (1, 0, 1): 8 * 256 * 3, (1, 1, 1): 8 * 9, (2, 0, 0): 8 * 9}
    pairs = stage(E.riemann_pairs(rows).withColumns({c: F.when(F.col("subject_id") == 2, 10 * F.col(c) - 7).otherwise(F.col(c)) for c in "ij"}), "pairs")
    one = matrix.mds_embed(blocks, rounds=3).collect()
    assert sorted((r.subject_id, r.i) for r in one) == [(1, i) for i in range(259)] + [(2, i) for i in range(3)]
    for more in (matrix.mds_embed(blocks, rounds=3, largest=100), matrix.mds_embed(pairs, rounds=3).withColumn("i", F.when(F.col("subject_id") == 2, (F.col("i") + 7) / 10).otherwise(F.col("i")))):
        assert np.allclose([[r.i, r.x, r.y] for r in sorted(one)], [[r.i, r.x, r.y] for r in sorted(more.collect())], atol=1e-9)
    fused = W.temporal_distance_fused(E.riemann_pairs(rows.filter("subject_id = 1")))
    gaps, wanted = np.zeros((259, 259)), {(r.i, r.j): r.fused for r in fused.collect()}
    for r in matrix.fused_blocks(blocks.filter("g = 1")).collect():
        d = np.frombuffer(r.block).reshape(min(256, 259 - 256 * r.p), -1)
        gaps[256 * r.p : 256 * r.p + d.shape[0], 256 * r.q : 256 * r.q + d.shape[1]] = d
    assert np.allclose([gaps[k] for k in wanted], list(wanted.values()), atol=1e-12) and len(wanted) == 259 * 258 // 2


def test_an_embedding_makes_no_row_of_a_pair(spark, sf_dir, monkeypatch):
    rows, kept = [], stage

    def counted(df, label):
        out = kept(df, label)
        rows.append((out.count(), label))
        return out

    monkeypatch.setattr("sigloom.sources.staging.stage", counted)
    assert matrix.mds_embed(E.riemann_blocks(spark.createDataFrame([(1, i, [2.0 + i, 0.5, 0.5, 3.0]) for i in range(60)], "subject_id long, i long, cov array<double>"))).count() == 60
    assert max(rows)[0] <= 60


def test_subjects_without_a_matrix_are_errors(spark, epochs, rows):
    some = rows.filter("subject_id <> 2")
    means = stage(matrix.subject_means(some), "some")
    with pytest.raises(Exception, match="no fitted matrix for 2"):
        matrix.parallel_transport(rows, means, matrix.general_mean(means)).collect()
    with pytest.raises(Exception, match="no fitted matrix for 2"):
        matrix.apply_whitening(epochs, matrix.pooled_covariance(epochs.filter("subject_id <> 2"), ["subject_id"], 3)).collect()
    with pytest.raises(Exception, match="no fitted matrix for 2"):
        matrix.eye_removal_apply(epochs, matrix.eye_removal_fit(epochs.filter("subject_id <> 2"), 3, (0, 1), (1, 2))).collect()


def test_unconverged_fits_warn(rows, spark):
    with pytest.warns(UserWarning, match="means moved by"):
        matrix.riemann_means(rows, ["subject_id"], most=1)
    df = spark.createDataFrame([(1, [0.1], 0), (1, [0.4], 1), (1, [0.2], 1)], "g int, x array<double>, y int")
    with pytest.warns(UserWarning, match="coefficients moved"):
        E.logistic_fit(df, "g", "x", "y", 1, steps=1)


def moved_to(c, mean, general):
    e = linalg.transport_matrix(mean, general)
    return e @ c @ e.T


def plain_losocv(held, filters, classifier="kernel", weight=1.0, judged=lambda r: True, order=lambda r: r.i, pooled=True):
    """Row by row with NumPy alone: models of the other subjects; each row of the held-out one moves both means and is then predicted.

    Without ``pooled`` a fold's class means are those of all rows of the other subjects, not of subjects' class means.
    """
    mat = lambda r: np.reshape(r.cov, (3, 3))
    subjects = sorted({r.subject_id for r in held})
    rows = {s: sorted((r for r in held if r.subject_id == s), key=order) for s in subjects}
    means = {s: linalg.riemann_mean(np.stack([mat(r) for r in rows[s]])) for s in subjects}
    random = np.random.RandomState(42)
    w, b = random.normal(scale=np.sqrt(2 * E.RBF_GAMMA), size=(filters, 64)), random.uniform(0, 2 * np.pi, 64)
    out = {}
    for s in subjects:
        others = [o for o in subjects if o != s]
        counts = np.array([len(rows[o]) for o in others], float)
        general = linalg.riemann_mean(np.stack([means[o] for o in others]), counts)
        train = [(moved_to(mat(r), means[o], general), r.label, o) for o in others for r in rows[o] if judged(r)]
        classes = []
        for y in (0, 1):
            if pooled:
                own = {o: np.stack([mat(r) for r in rows[o] if judged(r) and r.label == y]) for o in others if any(judged(r) and r.label == y for r in rows[o])}
                classes.append(linalg.riemann_mean(np.stack([moved_to(linalg.riemann_mean(c), means[o], general) for o, c in own.items()]), np.array([len(c) for c in own.values()], float)))
            else:
                classes.append(linalg.riemann_mean(np.stack([c for c, label, _ in train if label == y])))
        lift = lambda c: np.concatenate([np.sqrt(2 / 64) * np.cos(linalg.log_variance(c, linalg.csp(*classes, filters)[0]) @ w + b), np.ones((len(c), 1))], 1)  # noqa: B023, E731
        beta = np.zeros(65)
        if classifier == "kernel":
            x, y = lift(np.stack([c for c, _, _ in train])), np.array([label for _, label, _ in train])
            for _ in range(30):
                p = 1 / (1 + np.exp(-(x @ beta)))
                beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * len(y) * np.eye(65), x.T @ (y - p) - 1e-3 * len(y) * beta)
        mean, n, total, cap = None, 0.0, counts.sum(), np.floor(counts.mean())
        for r in rows[s]:
            if n + weight <= cap:
                mean = mat(r) if mean is None else linalg.riemann_mean(np.stack([mean, mat(r)]), np.array([n, weight]))
                general = linalg.riemann_mean(np.stack([general, mat(r)]), np.array([total, weight]))
                n, total = n + weight, total + weight
            if judged(r):
                c = moved_to(mat(r), mean, general)
                d = [linalg.riemann_distance(c, k) for k in classes]
                out[s, order(r)] = 1 / (1 + np.exp(-(lift(c[None]) @ beta)[0])) if classifier == "kernel" else d[0] / (d[0] + d[1])
    return out


@pytest.mark.parametrize("classifier", ["kernel", "nearest"])
def test_folds_equal_plain_ones(rows, classifier):
    wanted = plain_losocv(rows.collect(), 2, classifier)
    found = {(r.subject_id, r.i): r.predicted_proba for r in E.adapt_then_predict(rows, classifier, 2).collect()}
    assert set(found) == set(wanted) and max(abs(found[k] - wanted[k]) for k in wanted) < 1e-4
    if classifier == "kernel":
        metrics, summary = E.losocv(rows, 2)
        f1 = {r.subject_id: r.f1 for r in metrics.collect()}
        assert summary.first()["mean"] == pytest.approx(np.mean(list(f1.values())))


def test_later_rows_change_no_earlier_prediction(spark, rows):
    """The last row of a subject becomes another matrix: all that was predicted for it before stays to the last bit that its models give."""
    held = [r.asDict() for r in rows.collect()]
    last = max(r["i"] for r in held if r["subject_id"] == 0)
    changed = [r | {"cov": [50.0, 3.0, 1.0, 3.0, 0.2, 0.1, 1.0, 0.1, 9.0]} if (r["subject_id"], r["i"]) == (0, last) else r for r in held]
    for classifier in ("kernel", "nearest"):
        one, two = ({r.i: r.predicted_proba for r in E.adapt_then_predict(spark.createDataFrame(x, rows.schema), classifier, 2).filter("subject_id = 0").collect()} for x in (held, changed))
        assert max(abs(one[i] - two[i]) for i in one if i < last) < 1e-6 and abs(one[last] - two[last]) > 1e-3


def test_subjects_class_means_stand_for_their_rows(rows):
    """What pooling costs: predictions from subjects' class means against those from all rows of the fold."""
    held = rows.collect()
    pooled, whole = (plain_losocv(held, 2, "nearest", pooled=x) for x in (True, False))
    assert np.mean([(pooled[k] > 0.5) == (whole[k] > 0.5) for k in pooled]) > 0.97 and max(abs(pooled[k] - whole[k]) for k in pooled) < 0.02


def test_background_moves_means_and_is_not_predicted(spark, rows):
    held = rows.withColumn("judged", F.col("i") % 4 != 3).withColumn("at", F.struct(F.col("judged").alias("late"), "i"))
    found = {(r.subject_id, r["at"].late, r["at"].i): r.predicted_proba for r in E.adapt_then_predict(held, "nearest", 2, 1 / 3, "judged", "at").collect()}
    wanted = plain_losocv(held.collect(), 2, "nearest", 1 / 3, lambda r: r.judged, lambda r: (r.judged, r.i))
    assert {(s, *at) for s, at in wanted} == set(found) and max(abs(found[s, *at] - v) for (s, at), v in wanted.items()) < 1e-4


def test_trajectory_keeps_its_cap_and_start(spark, rows):
    start = spark.createDataFrame([(0, np.eye(3).ravel().tolist(), 10.0, 3.0, (2 * np.eye(3)).ravel().tolist(), 1.0), (1, np.eye(3).ravel().tolist(), 10.0, 0.0, None, None)], "subject_id long, general array<double>, total double, cap double, mean array<double>, n double")
    out = {(r.subject_id, r.i): r for r in E.adapt_trajectory(rows, start).collect()}
    assert {s for s, _ in out} == {0, 1} and all(r["mean"] is None and r["total"] == 10 for (s, _), r in out.items() if s == 1)
    first = [np.reshape(r.cov, (3, 3)) for r in rows.filter("subject_id = 0").orderBy("i").collect()]
    mean, general = 2 * np.eye(3), np.eye(3)
    for k in range(2):
        mean = linalg.riemann_mean(np.stack([mean, first[k]]), np.array([1.0 + k, 1.0]))
        general = linalg.riemann_mean(np.stack([general, first[k]]), np.array([10.0 + k, 1.0]))
    last = out[0, max(i for s, i in out if s == 0)]
    assert last["n"] == 3 and last["total"] == 12 and np.allclose(np.reshape(last["mean"], (3, 3)), mean) and np.allclose(np.reshape(last["general"], (3, 3)), general)


def test_pipeline_of_steps(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    centre = Step("centre", lambda d, t: d.crossJoin(t["mean"]).selectExpr("v - m AS v"), fit=lambda d: {"mean": d.agg(F.avg("v").alias("m"))}, update=lambda d, t: {"mean": d.agg((F.avg("v") + 1).alias("m"))})
    double = Step("double", lambda d, _: d.selectExpr("v * 2 AS v"), calibration=True)
    with pytest.raises(ValueError, match="centre"):
        transform(df, [double, centre])
    assert fit_next(df, [double, centre]) == "centre" and fit_next(df, [double, centre]) is None
    assert sorted(r.v for r in transform(df, [double, centre]).collect()) == [-2.0, 2.0]
    partial_fit(df, [double, centre])
    assert sorted(r.v for r in transform(df, [double, centre]).collect()) == [-3.0, 1.0]
    fresh = Step("centre", centre.apply, fit=centre.fit)
    assert sorted(r.v for r in run_pipeline(df, [fresh, double]).collect()) == [-2.0, 2.0]


def test_votes_by_distance(spark):
    near = spark.createDataFrame([(1, 0, 0, 1, 5.0), (1, 0, 0, 1, 4.0), (1, 0, 0, 0, 0.5)], "subject_id int, test int, true_label int, label int, d double")
    assert W.knn_vote(near).first().predicted_label == 1 and W.knn_vote(near, weighted=True).first().predicted_label == 0


def test_sql_functions(spark):
    matrix.register_sql(spark)
    out = spark.sql("SELECT matrix_sqrtm(array(4.0D, 0.0D, 0.0D, 9.0D)) AS r, p.part, p.sample FROM (SELECT 1), LATERAL split_windows(array(1.0D, 2.0D, 3.0D, 4.0D, 5.0D, 6.0D), 1, 3) p").collect()
    assert np.allclose(out[0].r, [2, 0, 0, 3]) and sorted((r.part, tuple(r["sample"])) for r in out) == [(0, (1.0, 2.0)), (1, (3.0, 4.0)), (2, (5.0, 6.0))]
