import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import linalg
from sigloom.plans.evaluate import RBF_GAMMA  # noqa: F401
from sigloom.streaming import adapt

WINDOW = "session_id string, kind string, action string, state_visit_id int, label int, segment long, window long, start_timestamp double, end_timestamp double, emitted double, n_channels int, n_times int, sample array<double>, message string"


def walks(rows, start, cap, general, total):
    """Sessions' means, and the general mean over the rows that they accept, one after another."""
    means, n, trail = {}, {}, []
    for s, ts, c in sorted(rows, key=lambda r: (r[1], r[0])):
        c = np.reshape(c, (2, 2))
        if n.get(s, 1.0) + 1 > cap:
            continue
        means[s] = linalg.riemann_mean(np.stack([means.get(s, start), c]), np.array([n.get(s, 1.0), 1.0]))
        n[s] = n.get(s, 1.0) + 1
        general = linalg.riemann_mean(np.stack([general, c]), np.array([total, 1.0]))
        total += 1
        trail.append((s, ts, means[s], general, total))
    return trail


@pytest.fixture(scope="module")
def covariances():
    random = np.random.RandomState(5)
    x = random.normal(size=(3, 12, 2, 20)) * np.array([1.0, 2.0])[:, None]
    return [(s, float(k + 1), linalg.oas(x[s, k][None])[0].ravel().tolist()) for s in range(3) for k in range(12)]


def test_means_of_a_stream_equal_a_loop_and_restart(spark, covariances, tmp_path):
    """Files out of order; the stream stops in the middle, and a batch is tried twice."""
    kind, start = "session_id long, ts double, cov array<double>", np.eye(2)
    df = spark.createDataFrame([*covariances, (-1, 9e5, covariances[0][2])], kind)
    sink = adapt.GeneralMean(str(tmp_path / "general"), 2 * np.eye(2), 7.0)
    seen = []

    def twice(batch, number):
        seen.append(number)
        sink.take(batch, number)
        sink.take(batch, number)

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = adapt.adapt_means_stream(stream, start, 1.0, 9.0, delay="100 seconds", idle=1e9).filter("session_id >= 0")
        out.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(240)

    df.filter("ts % 2 = 1 AND ts < 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    df.filter("ts % 2 = 0 AND ts < 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    df.filter("ts > 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    wanted = walks(covariances, start, 9.0, 2 * np.eye(2), 7.0)
    found = sink.rows(spark).orderBy("total").collect()
    assert len(seen) > 3 and [(r.session_id, r.ts, r.total) for r in found] == [(s, ts, total) for s, ts, _, _, total in wanted]
    assert all(np.allclose(r.general, g.ravel(), atol=1e-7) for r, (*_, g, _) in zip(found, wanted, strict=True))


def made_windows():
    """Two sessions: windows to train on, fits, windows that only move the mean, and predictions in between."""
    random, rows = np.random.RandomState(6), []
    for s in ("a", "b"):
        mix = np.eye(2) + 0.3 * random.normal(size=(2, 2))
        for k in range(60):
            label = int(random.rand() < 0.5)
            x = mix @ (random.normal(size=(2, 25)) * np.array([3.0 if label else 1.0, 1.0 if label else 2.5])[:, None])
            action = "COLLECT_FOR_TRAIN" if k % 3 == 0 else "PARTIAL_FIT" if k % 3 == 1 else "PREDICT"
            rows.append((s, "window", action, 1, label, 1, k, float(k), float(k), float(k), 2, 25, x.ravel().tolist(), None))
            if k in (25, 44):
                rows.append((s, "window", "FIT", 1, label, 1, k, float(k), float(k), float(k), 2, 25, x.ravel().tolist(), None))
    return rows


def plain_learner(rows, filters, general, total, cap):
    """Window by window, in order of time; what teaches comes before what is predicted at the same time."""
    out, states = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[9], ["COLLECT_FOR_TRAIN", "PARTIAL_FIT", "FIT", "PREDICT"].index(r[2]))):
        now = states.setdefault(r[0], {"kept": [], "model": None, "mean": None, "n": 0.0, "general": general, "total": total})
        c = linalg.oas(np.reshape(r[12], (1, 2, 25)))[0]
        move = lambda c, e: c if e is None else e @ c @ e.T
        e = None if now["mean"] is None else linalg.transport_matrix(now["mean"], now["general"])
        if r[2] == "COLLECT_FOR_TRAIN":
            now["kept"].append((c, r[4]))
        elif r[2] == "PARTIAL_FIT" and now["n"] + 1 <= cap:
            now["mean"] = c if now["mean"] is None else linalg.geodesic(now["mean"], c, 1 / (now["n"] + 1))
            now["general"] = linalg.geodesic(now["general"], c, 1 / (now["total"] + 1))
            now["n"], now["total"] = now["n"] + 1, now["total"] + 1
        elif r[2] == "FIT":
            covs, y = np.stack([move(c, e) for c, _ in now["kept"]]), np.array([label for _, label in now["kept"]])
            w = linalg.csp(*(linalg.riemann_mean(covs[y == k]) for k in (0, 1)), filters)[0]
            x, beta = np.concatenate([linalg.log_variance(covs, w), np.ones((len(y), 1))], 1), np.zeros(filters + 1)
            for _ in range(30):
                p = 1 / (1 + np.exp(-(x @ beta)))
                beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * len(y) * np.eye(filters + 1), x.T @ (y - p) - 1e-3 * len(y) * beta)
            now["model"] = (w, beta, r[9])
        elif r[2] == "PREDICT":
            p = None
            if now["model"]:
                w, beta, _ = now["model"]
                p = 1 / (1 + np.exp(-(linalg.log_variance(move(c, e)[None], w)[0] @ beta[:-1] + beta[-1])))
            out[r[0], r[6]] = (p, now["model"] and now["model"][2])
    return out


def test_learner_equals_a_loop_in_any_batches(spark, tmp_path):
    rows = made_windows()
    df = spark.createDataFrame([*rows, ("a", "problem", *[None] * 11, "odd")], WINDOW)
    wanted = plain_learner(rows, 2, np.eye(2), 5.0, 14.0)
    for name, cuts in (("one", [60.0]), ("three", [20.0, 44.0, 60.0])):
        learner = adapt.Learner(str(tmp_path / name), 2, np.eye(2), 5.0, 14.0)
        before = -1.0
        for k, end in enumerate(cuts):
            part = df.filter((F.col("emitted") > before) & (F.col("emitted") <= end) | F.col("kind").eqNullSafe("problem"))
            learner.take(part, k)
            if k:
                learner.take(part, k)
            before = end
        found = {(r.session_id, r.window): r for r in learner.predictions(spark).collect()}
        assert set(found) == set(wanted) and learner.versions(spark).count() == 4
        for key, (p, since) in wanted.items():
            r = found[key]
            assert r.valid_from == since and (p is None) == (r.prediction is None)
            assert p is None or (abs(r.probability - max(p, 1 - p)) < 1e-4 and r.prediction == int(p >= 0.5))


def test_no_windows(spark, tmp_path):
    learner = adapt.Learner(str(tmp_path / "none"), 2, np.eye(2))
    for k in range(2):
        learner.take(spark.createDataFrame([], WINDOW), k)
    assert learner.predictions(spark).count() == 0 and learner.versions(spark).count() == 0
