"""Matrix features, neighbours, folds and signal filters on epochs made of embedding vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import matrix, pairs
from sigloom.operators import aggregates as A
from sigloom.operators import projections as P
from sigloom.operators import windows as W
from sigloom.plans import evaluate as E
from sigloom.plans.pipeline import Step, run_pipeline
from sigloom.queries import relational as R
from sigloom.queries import standins as S
from sigloom.sources.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# Two channels of 32 times: covariance and distance have closed forms. Centred moments, then the shrinkage of OAS.
COV2 = f"""WITH {S.EPOCHS_SQL},
    halves AS (SELECT vec_id, subject_id, event_id, label, sample[1:32] AS a, sample[33:64] AS b FROM epochs),
    centred AS (SELECT vec_id, subject_id, event_id, label, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM halves),
    plain AS (SELECT vec_id, subject_id, event_id, label, list_sum(list_transform(a, lambda v: v * v)) / 32 AS c00, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) / 32 AS c01, list_sum(list_transform(b, lambda v: v * v)) / 32 AS c11 FROM centred),
    shrunk AS (SELECT *, (c00 + c11) / 2 AS mu, (c00 * c00 + 2 * c01 * c01 + c11 * c11) / 4 AS alpha FROM plain),
    rho AS (SELECT *, CASE WHEN 33 * (alpha - mu * mu / 2) = 0 THEN 1 ELSE least(1, (alpha + mu * mu) / (33 * (alpha - mu * mu / 2))) END AS r FROM shrunk),
    cov AS (SELECT vec_id, subject_id, event_id, label, (1 - r) * c00 + r * mu AS s00, (1 - r) * c01 + 0.0 AS s01, (1 - r) * c11 + r * mu AS s11,
                   row_number() OVER (PARTITION BY subject_id ORDER BY event_id, vec_id) - 1 AS i FROM rho)"""


def rows2(spark, sf_dir):
    return E.with_covariance(S.epochs(spark, sf_dir, 2), 2)


def rows4(spark, sf_dir):
    return stage(E.with_covariance(S.epochs(spark, sf_dir), 4), "rows")


@register(f"{COV2} SELECT vec_id, [round(s00, 9), round(s01, 9), round(s01, 9), round(s11, 9)] AS cov FROM cov")
def oas_cov_2ch(spark, sf_dir):
    return rows2(spark, sf_dir).select("vec_id", F.transform("cov", lambda v: F.round(v, 9)).alias("cov"))


DIST2 = f"""{COV2}, pair AS (SELECT a.subject_id, a.i AS i, b.i AS j, a.event_id AS e1, b.event_id AS e2, a.label AS l1, b.label AS l2,
        (a.s11 * b.s00 - 2 * a.s01 * b.s01 + a.s00 * b.s11) / (a.s00 * a.s11 - a.s01 * a.s01) AS t, (b.s00 * b.s11 - b.s01 * b.s01) / (a.s00 * a.s11 - a.s01 * a.s01) AS d
        FROM cov a JOIN cov b ON a.subject_id {{op}} b.subject_id {{cond}}),
    dist AS (SELECT subject_id, i, j, e1, e2, l1, l2, sqrt(ln((t + sqrt(greatest(0, t * t - 4 * d))) / 2) ** 2 + ln(d * 2 / (t + sqrt(greatest(0, t * t - 4 * d)))) ** 2) AS d FROM pair)"""


@register(DIST2.format(op="=", cond="AND a.i < b.i") + " SELECT subject_id, i, j, round(d, 5) AS d FROM dist")
def riemann_dist_2ch(spark, sf_dir):
    return E.riemann_pairs(rows2(spark, sf_dir)).select("subject_id", "i", "j", P.round_half_away(F.col("d"), 5).alias("d"))


_LOO = DIST2.format(op="=", cond="AND a.i <> b.i") + """, open AS (SELECT *, max(CAST(e1 <> e2 AS INTEGER)) OVER (PARTITION BY subject_id, i) AS other FROM dist),
    near AS (SELECT *, row_number() OVER (PARTITION BY subject_id, i ORDER BY d, j) AS r FROM open WHERE e1 <> e2 OR other = 0),
    votes AS (SELECT subject_id, i, l1, l2, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY subject_id, i ORDER BY n DESC, l2) AS r FROM votes)"""


@register(f"{_LOO} SELECT subject_id, i AS test, l1 AS true_label, l2 AS predicted_label FROM best WHERE r = 1")
def riemann_knn_loo(spark, sf_dir):
    return E.riemannian_knn_loo(stage(rows2(spark, sf_dir), "rows"), 5)


_LOSO = DIST2.format(op="<>", cond="") + """, near AS (SELECT *, row_number() OVER (PARTITION BY subject_id, i ORDER BY d) AS r FROM (SELECT subject_id, i, l1, l2, d FROM dist)),
    votes AS (SELECT subject_id, i, l1, l2, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY subject_id, i ORDER BY n DESC, l2) AS r FROM votes)"""


@register(f"{_LOSO} SELECT subject_id, i AS test, l1 AS true_label, l2 AS predicted_label FROM best WHERE r = 1")
def riemann_knn_loso(spark, sf_dir):
    return E.riemannian_knn_loso(stage(rows2(spark, sf_dir), "rows"), 5)


@register(
    f"""{DIST2.format(op="=", cond="AND a.i < b.i")}, raw AS (SELECT vec_id, subject_id, sample, row_number() OVER (PARTITION BY subject_id ORDER BY event_id, vec_id) - 1 AS i FROM epochs),
    e AS (SELECT dist.subject_id, dist.d AS d, sqrt(list_sum(list_transform(list_zip(x.sample, y.sample), lambda p: (p[1] - p[2]) ** 2))) AS euclidean, list_sum(list_transform(list_zip(x.sample, y.sample), lambda p: abs(p[1] - p[2]))) AS manhattan
          FROM dist JOIN raw x ON x.subject_id = dist.subject_id AND x.i = dist.i JOIN raw y ON y.subject_id = dist.subject_id AND y.i = dist.j),
    long AS (SELECT subject_id, 'euclidean' AS metric, d, euclidean AS v FROM e UNION ALL SELECT subject_id, 'manhattan', d, manhattan FROM e),
    s AS (SELECT subject_id, metric, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS t, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS p FROM long WINDOW w AS (PARTITION BY subject_id, metric))
    SELECT subject_id, metric, count(*) AS n, round(avg(abs(t - p)), 5) AS mae, round(1 - sum((t - p) ** 2) / (var_pop(t) * count(*)), 4) AS r2 FROM s GROUP BY subject_id, metric"""
)
def distance_agreement(spark, sf_dir):
    both = pairs.measured_pairs(rows2(spark, sf_dir), {"d": ("cov", pairs.riemann), "euclidean": ("sample", pairs.euclidean), "manhattan": ("sample", pairs.cityblock)})
    out = A.distance_agreement(both, ["subject_id"], "d", ["euclidean", "manhattan"])
    return out.select("subject_id", "metric", "n", F.round("mae", 5).alias("mae"), F.round("r2", 4).alias("r2"))


@register()
def knn_metrics(spark, sf_dir):
    """Leave-one-out votes on Riemannian distances of four channels, metrics per subject."""
    return E.knn_metrics(E.riemannian_knn_loo(rows4(spark, sf_dir), 25))


@register()
def subject_means(spark, sf_dir):
    return matrix.subject_means(rows4(spark, sf_dir))


@register()
def general_mean_excluding(spark, sf_dir):
    return matrix.general_mean_excluding(stage(matrix.subject_means(rows4(spark, sf_dir)), "means"))


@register()
def transport(spark, sf_dir):
    return E.transport_dataset(S.epochs(spark, sf_dir), 4)[0].select("vec_id", "subject_id", "cov")


@register()
def tangent(spark, sf_dir):
    return E.transport_dataset(S.epochs(spark, sf_dir), 4)[1].select("vec_id", "subject_id", "tangent")


@register()
def tangent_knn_loso(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    return E.tangent_knn_loso(rows, matrix.general_mean(stage(matrix.subject_means(rows), "means")), 25)


@register()
def csp_features(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    model = matrix.csp_fit(rows.withColumn("all", F.lit(0)), ["all"], 4).select(F.col("filters").alias("w"))
    return rows.crossJoin(F.broadcast(model)).select("vec_id", matrix.filtered("w", "cov").alias("features"), matrix.filtered("w", "cov", log=False).alias("filtered"))


@register()
def csp_losocv(spark, sf_dir):
    return E.csp_losocv(rows4(spark, sf_dir)).select("subject_id", "i", "label", "predicted_label", "predicted_proba")


@register()
def losocv_summary(spark, sf_dir):
    return E.losocv(rows4(spark, sf_dir))[1]


@register()
def rf_classify_loso(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    return E.rf_classify_loso(rows, matrix.general_mean(stage(matrix.subject_means(rows), "means"))).select("subject_id", "i", "label", "predicted_label", "predicted_proba")


@register()
def whitening(spark, sf_dir):
    epochs = S.epochs(spark, sf_dir)
    w = stage(matrix.pooled_covariance(epochs.filter("is_background"), ["subject_id"], 4), "whitening")
    return matrix.apply_whitening(epochs, w).select("vec_id", "subject_id", "sample")


@register()
def pooled_covariance(spark, sf_dir):
    return matrix.pooled_covariance(S.epochs(spark, sf_dir).filter("is_background"), ["subject_id"], 4)


@register()
def adapt_means(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    general = stage(matrix.general_mean(stage(matrix.subject_means(rows), "means")), "general")
    start = rows.select("subject_id").distinct().crossJoin(F.broadcast(general.select("mean", F.lit(1.0).alias("n"), F.col("cap").cast("double").alias("cap"))))
    return E.adapt_means_batch(rows, start)


@register()
def adaptation_eval(spark, sf_dir):
    return E.adaptation_eval(S.epochs(spark, sf_dir), 4, True)


@register()
def third_moment_knn(spark, sf_dir):
    return E.third_moment_knn(S.epochs(spark, sf_dir), 4, 25)


@register()
def mds(spark, sf_dir):
    return matrix.mds_embed(E.riemann_blocks(rows4(spark, sf_dir)))


@register()
def mds_two_stage(spark, sf_dir):
    return matrix.mds_two_stage(stage(E.riemann_blocks(rows4(spark, sf_dir)), "blocks"))


@register()
def eye_removal(spark, sf_dir):
    epochs = S.epochs(spark, sf_dir)
    return matrix.eye_removal_apply(epochs, matrix.eye_removal_fit(epochs.filter("is_background"), 4, (0, 1), (2, 3))).select("vec_id", "sample")


@register()
def reference_weighted_distances(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    vectors = rows.withColumn("tangent", P.flatten_upper(F.col("cov"), 4))
    return E.reference_pairs(vectors, "tangent", matrix.general_mean(stage(matrix.subject_means(rows), "means")))


@register()
def pair_distance_vs_score(spark, sf_dir):
    return E.pair_distance_vs_score(rows4(spark, sf_dir), "sample_weight")


@register()
def pair_distance_vs_index(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    return E.pair_distance_vs_index(rows, "sample_weight", E.knn_metrics(E.riemannian_knn_loo(rows, 5)))


@register()
def permutation_by_user(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events").select("user_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return E.permutation_test(rows, "user_id", "x", "y")


_RANK = "rank() OVER (PARTITION BY subject_id ORDER BY {c}) + (count(*) OVER (PARTITION BY subject_id, {c}) - 1) / 2"


@register(
    f"""{R.METRICS}, r AS (SELECT subject_id, true_label, {_RANK.format(c='proba')} AS r FROM pred),
    s AS (SELECT subject_id, count(*) FILTER (true_label = 1) AS p, count(*) FILTER (true_label = 0) AS q, sum(r) FILTER (true_label = 1) AS s FROM r GROUP BY subject_id),
    one AS (SELECT subject_id, {_RANK.format(c='proba')} AS a, {_RANK.format(c='sample_weight')} AS b FROM pred WHERE true_label = 1),
    c AS (SELECT subject_id, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS rho FROM one GROUP BY subject_id)
    SELECT metrics.*, CASE WHEN s.p > 0 AND q > 0 THEN round((s - s.p * (s.p + 1) / 2) / (s.p * q), 6) END AS auc, round(rho, 6) AS rho, round({R.p_sql('rho', 'n')}, 6) AS p
    FROM metrics JOIN s USING (subject_id) LEFT JOIN c USING (subject_id)"""
)
def proba_vs_score(spark, sf_dir):
    return R.rounded(E.proba_vs_score(S.predictions(spark, sf_dir), "sample_weight"), *R.RATE_NAMES, "auc", "rho", "p")


@register(
    f"""{R.PRED}, cells0 AS (SELECT subject_id, {R.CELLS} FROM pred GROUP BY subject_id),
    top AS (SELECT subject_id FROM cells0 ORDER BY coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) DESC, subject_id LIMIT 10),
    split AS (SELECT *, row_number() OVER w <= greatest(1, floor(count(*) OVER (PARTITION BY subject_id, true_label) * 0.1::DOUBLE)) AS calibration
              FROM pred JOIN top USING (subject_id) WINDOW w AS (PARTITION BY subject_id, true_label ORDER BY sample_index)),
    t AS (SELECT subject_id, proba, count(*) FILTER (true_label = 0) AS n FROM split WHERE calibration GROUP BY ALL),
    v AS (SELECT subject_id, proba, coalesce(coalesce(sum(n) OVER w, 0) / nullif(sum(n) OVER (PARTITION BY subject_id), 0), 0) AS spec FROM t WINDOW w AS (PARTITION BY subject_id ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    th AS (SELECT subject_id, proba AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(spec - 0.9::DOUBLE), proba) AS r FROM v) WHERE r = 1),
    rest AS (SELECT split.subject_id, event_id, true_label, CAST(proba >= coalesce(threshold, 0.5) AS INTEGER) AS predicted_label FROM split LEFT JOIN th USING (subject_id) WHERE NOT calibration),
    vote AS (SELECT subject_id, event_id, CAST(avg(true_label) >= 0.5 AS INTEGER) AS true_label, CAST(avg(predicted_label) >= 0.5 AS INTEGER) AS predicted_label FROM rest GROUP BY subject_id, event_id),
    cells AS (SELECT subject_id, {R.CELLS} FROM vote GROUP BY subject_id)
    SELECT cells.*, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, {R.RATES}, (SELECT count(*) FROM rest WHERE rest.subject_id = cells.subject_id) AS num_raw_samples, threshold FROM cells LEFT JOIN th USING (subject_id)"""
)
def calibrated_vote_eval(spark, sf_dir):
    p = S.predictions(spark, sf_dir)
    return R.rounded(E.calibrated_vote_eval(p, A.binary_metrics(p, ["subject_id"])), *R.RATE_NAMES, "specificity")


@register()
def sequential_elimination(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    near = E.cross_subject_candidates(rows, "cov", matrix.riemann_distance, 25, each=True)
    return E.sequential_elimination(near.withColumn("other", F.col("candidate.subject_id")), 10, 25)


@register()
def score_regression(spark, sf_dir):
    rows = rows4(spark, sf_dir).withColumn("features", P.flatten_upper(F.col("cov"), 4))
    out = E.score_regression_cv(rows, "features", "sample_weight")
    return A.regression_metrics(out, ["subject_id"], "sample_weight", "predicted_score")


@register()
def channel_contribution(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    metrics = E.knn_metrics(E.riemannian_knn_loo(rows, 5)).withColumn("k", F.lit(5).cast("long"))
    return E.channel_contribution(rows, metrics, 4, 4, 5)


@register()
def compare_pipelines(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    return E.compare_pipelines({"k5": lambda: E.knn_metrics(E.riemannian_knn_loo(rows, 5)), "k15": lambda: E.knn_metrics(E.riemannian_knn_loo(rows, 15))})[1]


@register()
def preprocessing_comparison(spark, sf_dir):
    one, other = rows4(spark, sf_dir), stage(E.with_covariance(S.epochs(spark, sf_dir), 4, shrink=False), "plain")
    shrunk = lambda rows: E.knn_metrics(E.riemannian_knn_loo(rows, 5))
    regular = other.withColumn("cov", matrix.shaped(lambda x: x + 1e-3 * _unit(x.shape[1]), "cov"))
    return E.preprocessing_comparison(shrunk(one), shrunk(stage(regular, "regular")))


def _unit(n: int):
    import numpy as np

    return np.eye(round(n**0.5)).ravel()


@register()
def pipeline_steps(spark, sf_dir):
    """Whitening as a fitted calibration step, then lag embedding and covariance."""
    steps = [
        Step("whiten", lambda df, t: matrix.apply_whitening(df, t["whitening"]), fit=lambda df: {"whitening": stage(matrix.pooled_covariance(df.filter("is_background"), ["subject_id"], 4), "whitening")}, calibration=True),
        Step("embed", lambda df, _: P.lag_embed(df, 2, 2), calibration=True),
        Step("covariance", lambda df, _: df.withColumn("cov", matrix.covariance("sample", 8))),
    ]
    return run_pipeline(S.epochs(spark, sf_dir), steps).select("vec_id", "cov")


@register()
def matrix_sql(spark, sf_dir):
    """Matrix functions and the window splitter as SQL functions."""
    matrix.register_sql(spark)
    rows4(spark, sf_dir).createOrReplaceTempView("sigloom_epochs")
    return spark.sql("SELECT vec_id, part, matrix_sqrtm(cov) AS root, s.sample AS sample FROM sigloom_epochs, LATERAL split_windows(sigloom_epochs.sample, 4, 3) s")


@register()
def calibrated_top_subjects(spark, sf_dir):
    rows = rows4(spark, sf_dir)
    return W.top_subjects(E.knn_metrics(E.riemannian_knn_loo(rows, 25)))
