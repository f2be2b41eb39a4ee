import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import linalg, matrix
from sigloom.functions.nearest import nearest_across, nearest_within
from sigloom.operators import joins as J
from sigloom.operators import projections as P
from sigloom.operators import windows as W


def cells(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors with many exact copies, matrices, a subject of one event, events of several rows."""
    random, out = np.random.default_rng(3), []
    for s, n in (("a", 70), ("b", 41), ("c", 9), ("d", 1)):
        for i in range(n):
            v = np.round(random.normal(size=3), 1) if i % 3 else np.zeros(3)
            x = random.normal(size=(2, 12)) * (1 if i % 5 else 40)
            c = x @ x.T / 12 if i % 4 else np.eye(2)
            out.append((s, i, 0 if s == "c" else i // 4, i % 2, [float(y) for y in v], [float(y) for y in c.ravel()]))
    return spark.createDataFrame(out, "subject_id string, i int, event_id long, label int, v array<double>, cov array<double>").cache()


@pytest.mark.parametrize(("value", "distance"), [("v", P.vector_distance), ("cov", matrix.riemann_distance)])
def test_nearest_within_equals_all_pairs(rows, value, distance):
    pairs = J.pairs_within(rows, value).withColumn("d", distance(F.col("a"), F.col("b"))).drop("a", "b")
    whole = W.nearest_k(J.neighbor_candidates(pairs, rows), 4)
    names = ("subject_id", "test", "candidate", "true_label", "label", "d")
    assert cells(nearest_within(rows, value, distance, 4), *names) == cells(whole, *names)


@pytest.mark.parametrize("each", [False, True])
def test_nearest_across_equals_all_pairs(rows, each):
    found = nearest_across(rows, "cov", matrix.riemann_distance, 3, blocks=2, each=each).collect()
    given = rows.collect()
    have = {}
    for r in found:
        have.setdefault((r.subject_id, r.test), []).append((r.d, r.candidate.subject_id, r.candidate.i))
    for t in given:
        m = np.array([t.cov]).reshape(1, 2, 2)
        all_ = sorted((float(linalg.riemann_distance(m, np.array([o.cov]).reshape(1, 2, 2))[0]), o.subject_id, o.i) for o in given if o.subject_id != t.subject_id)
        if each:
            true = sorted(x for s in {x[1] for x in all_} for x in [y for y in all_ if y[1] == s][:3])
        else:
            true = all_[:3]
        assert sorted(have[t.subject_id, t.i]) == true


def test_no_pair_is_shuffled(spark, rows):
    """Rows grow by 8, what shuffles by not much more: pairs would by 64."""
    sizes = []
    for copies in (1, 8):
        many = spark.range(copies).crossJoin(rows).withColumn("i", (F.col("i") + 100 * F.col("id")).cast("int"))
        plan = nearest_within(many, "v", P.vector_distance, 4)
        assert plan.count() == sum(4 * n * copies for n in (70, 41)) + 4 * 9 * copies + (4 if copies > 4 else copies - 1) * copies
        sizes.append(plan._jdf.queryExecution().executedPlan().toString().count("Window"))
    assert sizes == [0, 0]
