import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import linalg, pairs
from sigloom.operators import aggregates as A
from sigloom.operators import joins as J
from sigloom.operators import projections as P
from sigloom.operators import windows as W


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture(scope="module")
def rows(spark):
    random, out = np.random.default_rng(8), []
    for s, n in (("a", 90), ("b", 33), ("c", 1), (None, 5)):
        for i in range(n):
            x = random.normal(size=(3, 9))
            out.append((s, i, [float(v) for v in x.ravel()[:5]], [float(v) for v in (x @ x.T).ravel()]))
    # Without a list, with a missing entry, of another length, without an index.
    out += [("b", 33, None, out[0][3]), ("b", 34, [1.0, None, 2.0, 3.0, 4.0], out[1][3]), ("b", 35, [1.0, 2.0], out[2][3]), ("b", None, [1.0] * 5, out[3][3])]
    return spark.createDataFrame(out, "subject_id string, i int, v array<double>, cov array<double>").repartition(5).cache()


@pytest.mark.parametrize("block", [16, 1024])
def test_measured_pairs_equal_the_column_forms(rows, block):
    found = pairs.measured_pairs(rows, {"euclidean": ("v", pairs.euclidean), "cityblock": ("v", pairs.cityblock), "cosine": ("v", pairs.cosine), "d": ("cov", pairs.riemann)}, block=block)
    whole = J.pairs_within(rows, "v").select("subject_id", "i", "j", *[P.vector_distance(F.col("a"), F.col("b"), m).alias(m) for m in ("euclidean", "cityblock", "cosine")])
    assert [f.dataType for f in found.schema][:3] == [f.dataType for f in whole.schema][:3]
    key = lambda r: (r.subject_id, r.i, r.j)
    one, two = sorted(found.collect(), key=key), sorted(whole.collect(), key=key)
    # To the last bit, as a digit at the border of rounding would differ.
    assert [(*key(r), r.euclidean, r.cityblock, r.cosine) for r in one] == [(*key(r), r.euclidean, r.cityblock, r.cosine) for r in two]
    at = {(r.subject_id, r.i): np.array(r.cov).reshape(1, 3, 3) for r in rows.collect()}
    assert np.allclose([r.d for r in one], [linalg.riemann_distance(at[r.subject_id, r.i], at[r.subject_id, r.j])[0] for r in one], atol=1e-9)


def test_reference_weighted_distances_and_two_channels():
    x = np.random.default_rng(1).normal(size=(20, 2, 9))
    c = x @ x.swapaxes(1, 2)
    u, again = linalg.upper(c), lambda k: np.repeat(k[None], 20, 0)
    assert np.allclose(linalg.riemann_distances(c, c), np.stack([linalg.riemann_distance(again(k), c) for k in c]), atol=1e-12)
    assert np.allclose(linalg.weighted_reference_distances(u, u, c[0]), np.stack([linalg.weighted_reference_distance(again(k), u, c[0]) for k in u]), atol=1e-12)


def test_no_pair_moves(spark, rows):
    """Rows grow by 8 and pairs by 64; what shuffles grows with rows and blocks."""
    sizes = []
    for copies in (1, 8):
        many = spark.range(copies).crossJoin(rows.filter("subject_id = 'a'")).withColumn("i", (F.col("i") + 90 * F.col("id")).cast("int"))
        before, n = written(spark), 90 * copies
        both = pairs.measured_pairs(many, {"d": ("cov", pairs.riemann), "e": ("v", pairs.euclidean)})
        assert A.distance_agreement(both, ["subject_id"], "d", ["e"]).first().n == n * (n - 1) // 2
        assert W.temporal_distance_fused(both).count() == n * (n - 1) // 2
        sizes.append(written(spark) - before)
    assert sizes[1] < 16 * sizes[0]


def test_a_row_shuffles_as_often_as_there_are_tiles(spark, rows):
    """Eight times the rows of a key shuffle about eight times as much, however many blocks of the least size they have."""
    sizes = []
    for copies in (4, 32):
        many = spark.range(copies).crossJoin(rows.filter("subject_id = 'a'")).withColumn("i", (F.col("i") + 90 * F.col("id")).cast("int"))
        before, n = written(spark), 90 * copies
        assert pairs.measured_pairs(many, {"e": ("v", pairs.euclidean)}, block=32).count() == n * (n - 1) // 2
        sizes.append(written(spark) - before)
    assert sizes[1] < 12 * sizes[0]
