import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigloom.operators import aggregates as A
from sigloom.operators import joins as J
from sigloom.operators import projections as P
from sigloom.operators import windows as W


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fold_metrics_of_known_cells(spark):
    cells = spark.createDataFrame([(20, 48, 17, 37, 6)], "subject_id int, tp int, fp int, tn int, fn int")
    m = A.rates(cells).first()
    assert [round(m[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == [0.7870, 0.7385, 0.8889, 0.8067]


def test_metrics_of_nothing_and_of_one_class(spark):
    empty = spark.createDataFrame([], "subject_id int, true_label int, predicted_label int")
    assert A.binary_metrics(empty, ["subject_id"]).count() == 0
    one = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "subject_id int, true_label int, predicted_label int")
    assert A.binary_metrics(one, ["subject_id"]).first().f1 == 0
    scored = one.withColumn("proba", F.lit(0.5))
    assert A.auc(scored, ["subject_id"]).first().auc is None


def test_auc_ties_and_missing(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5), (2, 1, 0.9), (2, 0, 0.1), (3, 1, float("nan")), (3, 0, 0.2)], "subject_id int, true_label int, proba double")
    assert rows(A.auc(df, ["subject_id"]).select("subject_id", "auc"), "subject_id") == [(1, 0.5), (2, 1.0), (3, None)]


def test_constant_scores_have_no_correlation(spark):
    df = spark.createDataFrame([(1, float(i), 3.0) for i in range(8)], "g int, x double, y double")
    assert A.spearman_by(df, ["g"], "x", "y").first().rho is None
    assert A.pearson_by(df, ["g"], "x", "y").first().r is None


def test_window_truth_rounds_half_to_even(spark):
    df = spark.createDataFrame([([0, 1],), ([1, 1, 0],), ([],), ([1, 2],)], "v array<int>")
    assert [r[0] for r in df.select(A.window_truth(F.col("v"))).collect()] == [0, 1, None, 2]


def test_vote_of_equal_halves_is_one(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 0)], "subject_id int, event_id int, true_label int, predicted_label int")
    assert A.event_vote(df, ["subject_id", "event_id"]).first()[2:] == (2, 1, 1)


def test_strict_as_of_and_long_gaps(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.5), ("a", 99999.0), ("b", 1.0)], "session_id string, ts double")
    m = spark.createDataFrame([("a", 2.0, "x"), ("a", 2.4, "y")], "session_id string, ts double, state string")
    assert rows(J.asof_state(s, m, bucket=10.0), "session_id", "ts") == [("a", 1.0, None), ("a", 2.0, None), ("a", 2.5, "y"), ("a", 99999.0, "y"), ("b", 1.0, None)]


def test_interval_join_over_buckets(spark):
    s = spark.createDataFrame([(1, i) for i in range(20)], "k int, at long")
    spans = spark.createDataFrame([(1, 3, 12, "u"), (1, 5, 5, "v")], "k int, start long, end long, name string")
    assert [r[1] for r in rows(J.interval_join(s, spans, "k", "at", "start", "end", bucket=4), "at")] == list(range(3, 12))


def test_neighbours_fall_back_to_all_but_self(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, 0.1), (1, 1, 2, 0.4)], "subject_id int, i int, j int, d double")
    same = spark.createDataFrame([(1, i, 7, i % 2) for i in range(3)], "subject_id int, i int, event_id int, label int")
    assert J.neighbor_candidates(pairs, same).count() == 6
    other = same.withColumn("event_id", F.when(F.col("i") == 2, 8).otherwise(7))
    assert J.neighbor_candidates(pairs, other).count() == 4
    near = W.nearest_k(J.neighbor_candidates(pairs, same), 99)
    assert near.count() == 6 and {r.predicted_label for r in W.knn_vote(near).collect() if r.test == 1} == {0}


def test_pairs_over_blocks(spark):
    df = spark.range(600).select(F.lit(1).alias("subject_id"), F.col("id").alias("i"), F.col("id").alias("v"))
    assert J.pairs_within(df, "v").select("i", "j").distinct().count() == 600 * 599 // 2


def test_missing_matrix_fails(spark):
    df = spark.createDataFrame([(1,), (2,)], "subject_id int")
    m = spark.createDataFrame([(1, 5.0)], "subject_id int, n double")
    assert J.lookup_subject_matrix(df.filter("subject_id = 1"), m).count() == 1
    with pytest.raises(PySparkException):
        J.lookup_subject_matrix(df, m).collect()


@pytest.mark.parametrize(("length", "size", "step"), [(10, 3, 2), (3, 3, 1), (2, 3, 1), (12, 4, 5), (9, 2, 4)])
def test_window_counts(spark, length, size, step):
    df = spark.range(length).select(F.lit("s").alias("session_id"), F.lit(1).alias("segment"), F.col("id").alias("idx"), F.col("id").cast("double").alias("ts"))
    out = rows(W.sliding_windows(df, size, step, collect={"at": "idx"}), "window")
    assert len(out) == max(0, (length - size) // step + 1)
    assert [r[-1] for r in out] == [list(range(k * step, k * step + size)) for k in range(len(out))]


def test_null_group_breaks_a_segment(spark):
    df = spark.createDataFrame([("s", i, g) for i, g in enumerate(["a", "a", None, "a", "b"])], "session_id string, idx long, grp string")
    assert [r[-1] for r in rows(W.segments(df), "idx")] == [1, 1, 2, 3]


def test_channels_all_missing_and_longest_run(spark):
    nan = float("nan")
    df = spark.createDataFrame([("s", i, [v]) for i, v in enumerate([nan, 1.0, 1.0, nan, 2.0, 2.0])] + [("t", 0, [nan])], "session_id string, idx long, x array<double>")
    assert [r[1] for r in rows(W.crop_to_longest_run(df), "idx")] == [1, 2]


def test_lag_embedding_is_identity_for_one(spark):
    df = spark.createDataFrame([(2, 6, [float(i) for i in range(12)])], "n_channels int, n_times int, sample array<double>")
    assert P.lag_embed(df, 1, 4).first().sample == df.first().sample
    two = P.lag_embed(df, 2, 1).first()
    assert (two.n_channels, two.n_times) == (4, 4) and two.sample[:8] == [0, 1, 2, 3, 6, 7, 8, 9] and two.sample[8:] == [1, 2, 3, 4, 7, 8, 9, 10]


def test_reference_must_exist(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    with pytest.raises(ValueError, match="Fz"):
        P.rereference(df, ["Cz", "C3"], "Fz")


def test_scores_without_a_number(spark):
    df = spark.createDataFrame([("Image#VAS=40",), ("Image",), ("Image#VAS=",)], "d string")
    assert [r[0] for r in df.select(P.parse_score(F.col("d"))).collect()] == [0.4, 1.0, None]


def test_threshold_default_and_lowest_of_equals(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.6), (1, 1, 0.4)], "subject_id int, true_label int, proba double")
    assert W.calibrate_threshold(df, ["subject_id"], target=0.5).first().threshold == 0.4
    assert math.isclose(W.calibrate_threshold(df, ["subject_id"], target=0.25).first().threshold, 0.2)


def test_top_ten_of_known_scores(spark):
    f1 = {15: 0.9385, 16: 0.93, 8: 0.92, 17: 0.91, 20: 0.90, 19: 0.89, 12: 0.88, 13: 0.87, 5: 0.86, 11: 0.85, 1: 0.8, 14: 0.4979}
    df = spark.createDataFrame(list(f1.items()), "subject_id int, f1 double")
    assert [r[0] for r in W.top_subjects(df).collect()] == [15, 16, 8, 17, 20, 19, 12, 13, 5, 11]


def test_sequences_of_unequal_length(spark):
    a = spark.createDataFrame([("s", 0, "Rest"), ("s", 1, "Image")], "session_id string, pos int, state string")
    b = spark.createDataFrame([("s", 0, "REST")], "session_id string, pos int, state string")
    assert [(r.actual, r.same) for r in J.compare_sequences(a, b).orderBy("pos").collect()] == [("REST", True), ("<no state>", False)]
