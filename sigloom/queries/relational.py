"""Metrics, votes, thresholds, ranks and set operations on prediction-like rows, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import aggregates as A
from sigloom.operators import joins as J
from sigloom.operators import projections as P
from sigloom.operators import windows as W
from sigloom.queries import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def narrow(c: Column) -> Column:
    return c.cast("int")


def p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: for whole degrees of freedom Student's distribution is a finite sum."""
    even = f"list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow(1 - {r} * {r}, k)))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(1 - {r} * {r}, k + 0.5))), 0)"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0 WHEN {n} % 2 = 0 THEN 1 - abs({r}) * {even} ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * {odd}) END"


PRED = f"WITH {S.PREDICTIONS_SQL}"
CELLS = "count(*) FILTER (true_label = 0 AND predicted_label = 0) AS tn, count(*) FILTER (true_label = 0 AND predicted_label = 1) AS fp, count(*) FILTER (true_label = 1 AND predicted_label = 0) AS fn, count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp"
RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
METRICS = f"{PRED}, cells AS (SELECT subject_id, {CELLS} FROM pred GROUP BY subject_id), metrics AS (SELECT subject_id, tp + tn + fp + fn AS num_samples, {RATES} FROM cells)"
RATE_NAMES = ("accuracy", "precision", "recall", "f1")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.binary_metrics(S.predictions(spark, sf_dir), ["subject_id"]), *RATE_NAMES)


@register(f"{METRICS} SELECT * FROM metrics")
def subject_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@register(f"{PRED}, cells AS (SELECT subject_id, {CELLS} FROM pred GROUP BY subject_id) SELECT *, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity FROM cells")
def confusion(spark, sf_dir):
    return rounded(A.confusion(S.predictions(spark, sf_dir), ["subject_id"]), "specificity")


_CLASSES = """, k AS (SELECT DISTINCT subject_id, true_label AS c FROM pred UNION SELECT DISTINCT subject_id, predicted_label FROM pred),
    cls AS (SELECT k.subject_id, c, count(*) FILTER (true_label = c) AS s, count(*) FILTER ({p} = c) AS d, count(*) FILTER (true_label = c AND {p} = c) AS h
            FROM k JOIN pred ON k.subject_id = pred.subject_id GROUP BY k.subject_id, c),
    wcm AS (SELECT subject_id, CAST(sum(s) AS BIGINT) AS num_samples, sum(h) / sum(s) AS accuracy, sum(s * coalesce(h / nullif(d, 0), 0)) / sum(s) AS "precision",
            sum(s * coalesce(h / nullif(s, 0), 0)) / sum(s) AS recall, sum(s * coalesce(2 * h / nullif(s + d, 0), 0)) / sum(s) AS f1 FROM cls GROUP BY subject_id)"""
_WCM_ROUND = 'round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1'


@register(PRED + _CLASSES.format(p="predicted_label") + f" SELECT subject_id, num_samples, {_WCM_ROUND} FROM wcm")
def weighted_metrics(spark, sf_dir):
    return rounded(A.weighted_class_metrics(S.predictions(spark, sf_dir), ["subject_id"]), *RATE_NAMES)


@register(f"{PRED}, cells AS (SELECT subject_id, CAST(grouping(subject_id) AS INTEGER) AS total, {CELLS} FROM pred GROUP BY ROLLUP (subject_id)) SELECT subject_id, total, tp, fp, fn, tn, {RATES} FROM cells")
def session_rollup(spark, sf_dir):
    return rounded(A.session_rollup(S.predictions(spark, sf_dir)), *RATE_NAMES)


@register(
    f"""{PRED}, r AS (SELECT subject_id, true_label, rank() OVER w + (count(*) OVER (PARTITION BY subject_id, proba) - 1) / 2 AS r FROM pred WINDOW w AS (PARTITION BY subject_id ORDER BY proba)),
    s AS (SELECT subject_id, count(*) FILTER (true_label = 1) AS n_pos, count(*) FILTER (true_label = 0) AS n_neg, sum(r) FILTER (true_label = 1) AS s FROM r GROUP BY subject_id)
    SELECT subject_id, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc FROM s"""
)
def auc_by_subject(spark, sf_dir):
    return rounded(A.auc(S.predictions(spark, sf_dir), ["subject_id"]), "auc")


EVENTS = "WITH ev AS (SELECT user_id, event_type, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"


def _scores(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


@register(
    f"""{EVENTS}, r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2 AS a,
        rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2 AS b FROM ev)
    SELECT user_id, count(*) AS n, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 AND count(*) > 1 THEN round(corr(a, b), 6) END AS rho FROM r GROUP BY user_id"""
)
def spearman_by_user(spark, sf_dir):
    return rounded(A.spearman_by(_scores(spark, sf_dir), ["user_id"], "x", "y"), "rho").drop("p")


@register(f"{EVENTS} SELECT user_id, count(*) AS n, round(corr(x, y), 6) AS r FROM ev GROUP BY user_id HAVING count(*) > 5")
def pearson_by_user(spark, sf_dir):
    return rounded(A.pearson_by(_scores(spark, sf_dir), ["user_id"], "x", "y"), "r").drop("p")


@register(
    f"""{EVENTS}, c AS (SELECT user_id, count(*) AS n, corr(x, y) AS r FROM ev GROUP BY user_id HAVING count(*) > 5), p AS (SELECT user_id, n, round(r, 6) AS r, round({p_sql('r', 'n')}, 6) AS p FROM c)
    SELECT *, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p"""
)
def correlation_p_values(spark, sf_dir):
    found = rounded(A.pearson_by(_scores(spark, sf_dir), ["user_id"], "x", "y"), "r", "p")
    return found.withColumn("stars", P.significance_stars(F.col("p")))


@register(f"{EVENTS} SELECT user_id, count(*) AS n, round(avg(abs(x - y)), 6) AS mae, CASE WHEN var_pop(x) > 0 THEN round(1 - sum((x - y) ** 2) / (var_pop(x) * count(*)), 5) END AS r2 FROM ev GROUP BY user_id")
def regression_metrics(spark, sf_dir):
    return rounded(rounded(A.regression_metrics(_scores(spark, sf_dir), ["user_id"], "x", "y"), "mae"), "r2", digits=5)


VOTE = "SELECT subject_id, event_id, count(*) AS rows, CAST(avg(true_label) >= 0.5 AS INTEGER) AS true_label, CAST(avg(predicted_label) >= 0.5 AS INTEGER) AS predicted_label FROM pred GROUP BY subject_id, event_id"


@register(f"{PRED} {VOTE}")
def event_vote(spark, sf_dir):
    return A.event_vote(S.predictions(spark, sf_dir), ["subject_id", "event_id"])


SPLIT = """split AS (SELECT *, row_number() OVER (PARTITION BY subject_id, true_label ORDER BY sample_index) <= greatest(1, floor(count(*) OVER (PARTITION BY subject_id, true_label) * 0.1::DOUBLE)) AS calibration FROM pred)"""


@register(f"{PRED}, {SPLIT} SELECT subject_id, sample_index, true_label, calibration FROM split")
def calibration_split(spark, sf_dir):
    return W.calibration_split(S.predictions(spark, sf_dir)).select("subject_id", "sample_index", "true_label", "calibration")


@register(f"{PRED}, {SPLIT} SELECT subject_id, sample_index, true_label FROM split WHERE NOT calibration")
def evaluation_minus_calibration(spark, sf_dir):
    rows = W.calibration_split(S.predictions(spark, sf_dir))
    return W.evaluation_minus_calibration(rows, rows.filter("calibration")).select("subject_id", "sample_index", "true_label")


def _threshold_sql(stat: str) -> str:
    value = "coalesce(tn / nullif(neg, 0), 0)" if stat == "specificity" else "coalesce(2 * (pos - fn) / nullif(2 * (pos - fn) + neg - tn + fn, 0), 0)"
    return f"""{PRED}, t AS (SELECT subject_id, proba, count(*) FILTER (true_label = 1) AS p, count(*) FILTER (true_label = 0) AS n FROM pred GROUP BY ALL),
    c AS (SELECT subject_id, proba, coalesce(sum(p) OVER w, 0) AS fn, coalesce(sum(n) OVER w, 0) AS tn, sum(p) OVER (PARTITION BY subject_id) AS pos, sum(n) OVER (PARTITION BY subject_id) AS neg
          FROM t WINDOW w AS (PARTITION BY subject_id ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT *, {value} AS stat FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(stat - 0.9::DOUBLE), proba) AS r FROM v)
    SELECT subject_id, proba AS threshold, round(stat, 6) AS {stat} FROM b WHERE r = 1"""


@register(_threshold_sql("specificity"))
def calibrate_threshold(spark, sf_dir):
    return rounded(W.calibrate_threshold(S.predictions(spark, sf_dir), ["subject_id"]), "specificity")


@register(_threshold_sql("f1"))
def calibrate_threshold_f1(spark, sf_dir):
    return rounded(W.calibrate_threshold(S.predictions(spark, sf_dir), ["subject_id"], stat="f1"), "f1")


def _side(c: str, n: str) -> str:
    return ", ".join(f"count(*) FILTER (true_label = {k} AND {c} = {p}) AS {n}{k}{p}" for k in (0, 1) for p in (0, 1))


SWEEP = f"""{PRED}, per AS (SELECT sample_index, {_side('predicted_label', 'a')}, {_side('predicted_b', 'b')} FROM pred GROUP BY sample_index
    UNION ALL SELECT -1, 0, 0, 0, 0, 0, 0, 0, 0),
    m AS (SELECT sample_index + 1 AS n, {', '.join(f'sum(a{k}{p}) OVER w + sum(b{k}{p}) OVER () - sum(b{k}{p}) OVER w AS c{k}{p}' for k in (0, 1) for p in (0, 1))} FROM per WINDOW w AS (ORDER BY sample_index)),
    f AS (SELECT n, c00 + c01 AS s0, c10 + c11 AS s1, (c00 + c11) / (c00 + c01 + c10 + c11) AS acc, coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) AS f0, coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0) AS f1 FROM m),
    sweep AS (SELECT n, round(acc, 6) AS accuracy, round((s0 * f0 + s1 * f1) / (s0 + s1), 6) AS f1 FROM f)"""


@register(f"{SWEEP} SELECT * FROM sweep")
def hybrid_sweep(spark, sf_dir):
    return rounded(W.hybrid_sweep(S.predictions(spark, sf_dir)), "accuracy", "f1")


@register(f"{SWEEP} SELECT * FROM sweep ORDER BY f1 DESC, n LIMIT 1")
def best_n(spark, sf_dir):
    return W.best_n(rounded(W.hybrid_sweep(S.predictions(spark, sf_dir)), "accuracy", "f1"))


HYBRID = PRED.replace("WITH pred", "WITH pred0") + ", pred AS (SELECT *, CASE WHEN sample_index < 100 THEN predicted_label ELSE predicted_b END AS hybrid_label FROM pred0)"


@register(HYBRID + _CLASSES.format(p="hybrid_label") + f" SELECT subject_id, num_samples, {_WCM_ROUND} FROM wcm")
def hybrid_predictions(spark, sf_dir):
    mixed = W.hybrid_predictions(S.predictions(spark, sf_dir), 100)
    return rounded(A.weighted_class_metrics(mixed, ["subject_id"], predicted="hybrid_label"), *RATE_NAMES)


@register(
    f"""{METRICS}, s AS (SELECT avg(f1) AS m, sum(num_samples * f1) / sum(num_samples) AS w, sum(num_samples * f1 * f1) / sum(num_samples) AS q FROM metrics)
    SELECT round(m, 6) AS mean, round(w, 6) AS weighted_mean, round(sqrt(greatest(0, q - w * w)), 6) AS weighted_std FROM s"""
)
def weighted_mean_std(spark, sf_dir):
    return rounded(A.weighted_mean_std(_metrics(spark, sf_dir), "f1", "num_samples"), "mean", "weighted_mean", "weighted_std")


@register(
    f"{METRICS} SELECT min(f1) AS min, max(f1) AS max, round(quantile_cont(f1, 0.25), 6) AS q1, round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.75), 6) AS q3, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std FROM metrics"
)
def score_summary(spark, sf_dir):
    return rounded(A.score_summary(_metrics(spark, sf_dir), "f1"), "q1", "median", "q3", "mean", "std")


LONG = f"{METRICS}, long AS (SELECT subject_id, measure, value FROM metrics UNPIVOT (value FOR measure IN (accuracy, \"precision\", recall, f1)))"


@register(f"{LONG} SELECT * FROM long")
def melt_metrics(spark, sf_dir):
    return A.melt_metrics(_metrics(spark, sf_dir), ["subject_id"], list(RATE_NAMES))


@register(
    f"""{LONG} SELECT measure, count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
    round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM long GROUP BY measure"""
)
def describe_by_measure(spark, sf_dir):
    return rounded(A.describe_by(melt_metrics(spark, sf_dir), "value", ["measure"]), "mean", "std", "q25", "q50", "q75")


_CORR = f"{EVENTS}, c AS (SELECT user_id % 10 AS channel, event_type AS filter, round(corr(x, y), 6) AS correlation FROM ev GROUP BY ALL)"
_KINDS = ("signup", "view", "click", "purchase", "error")


def _channel_correlations(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("channel"), F.col("event_type").alias("filter")).agg(F.round(A.correlation("x", "y"), 6).alias("correlation"))


@register(f"{_CORR} SELECT channel, {', '.join(f'max(correlation) FILTER (filter = \'{k}\') AS f{k}' for k in _KINDS)}, round(avg(abs(correlation)), 6) AS mean_abs FROM c GROUP BY channel")
def pivot_correlations(spark, sf_dir):
    return rounded(A.pivot_correlations(_channel_correlations(spark, sf_dir), list(_KINDS)), "mean_abs")


@register(f"{_CORR} SELECT * FROM c ORDER BY abs(correlation) DESC, channel, filter LIMIT 10")
def top_channel_filters(spark, sf_dir):
    return W.top_channel_filters(_channel_correlations(spark, sf_dir))


@register(f"{EVENTS} SELECT user_id % 10 AS channel, event_type AS filter, count(*) AS n, round(regr_slope(x, y), 6) AS slope, round(regr_intercept(x, y), 6) AS intercept FROM ev GROUP BY ALL HAVING count(*) >= 5")
def linear_fit(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumns({"channel": F.col("user_id") % 10, "filter": F.col("event_type")})
    return rounded(A.linear_fit_by(rows, ["channel", "filter"], "x", "y"), "slope", "intercept")


@register(f"{PRED} SELECT event_id, CAST(round_even(avg(true_label), 0) AS INTEGER) AS truth FROM pred GROUP BY event_id")
def window_truth(spark, sf_dir):
    grouped = S.predictions(spark, sf_dir).groupBy("event_id").agg(F.collect_list("true_label").alias("labels"))
    return grouped.select("event_id", A.window_truth(F.col("labels")).alias("truth"))


EPOCHS = f"WITH {S.EPOCHS_SQL}"


@register(
    f"{EPOCHS} SELECT count(*) AS rows, count(DISTINCT subject_id) AS subjects, count(DISTINCT event_id) AS events, count(*) FILTER (is_background) AS background, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM epochs"
)
def dataset_profile(spark, sf_dir):
    return A.dataset_profile(S.epochs(spark, sf_dir))


@register(f"{EVENTS} SELECT user_id, event_type, x, round(coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0), 6) AS scaled FROM ev WINDOW w AS (PARTITION BY user_id)")
def minmax_scale(spark, sf_dir):
    return rounded(A.minmax_scale(_scores(spark, sf_dir).drop("y"), "x", ["user_id"]), "scaled").select("user_id", "event_type", "x", "scaled")


@register(
    f"WITH {S.SAMPLES_SQL} SELECT session_id, round(count(*) / 250, 6) AS seconds, round(avg(CAST(isnan(v) AS INTEGER)), 6) AS nan_fraction, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean, round(stddev_pop(v) FILTER (NOT isnan(v)), 6) AS std FROM samples GROUP BY session_id"
)
def signal_profile(spark, sf_dir):
    rows = S.samples(spark, sf_dir).withColumn("x", F.col("x")[0])
    return rounded(A.signal_profile(rows, 250, ["session_id"]), "seconds", "nan_fraction", "mean", "std")


@register(f"{METRICS} SELECT * FROM metrics ORDER BY f1 DESC, subject_id LIMIT 10")
def top_subjects(spark, sf_dir):
    return W.top_subjects(_metrics(spark, sf_dir))


@register(f"{METRICS} SELECT subject_id, sample_index, event_id FROM pred WHERE subject_id IN (SELECT subject_id FROM metrics ORDER BY f1 DESC, subject_id LIMIT 10)")
def top_subject_rows(spark, sf_dir):
    return J.top_subject_filter(S.predictions(spark, sf_dir), _metrics(spark, sf_dir)).select("subject_id", "sample_index", "event_id")


@register(f"{METRICS} SELECT subject_id, f1, CAST(dense_rank() OVER (ORDER BY f1 DESC) AS INTEGER) AS position FROM metrics")
def rank_subjects(spark, sf_dir):
    return W.rank_subjects(_metrics(spark, sf_dir)).select("subject_id", "f1", "position")


@register(f"{PRED} SELECT subject_id, sample_index, predicted_label, 1 - predicted_b AS predicted_label_b FROM pred WHERE sample_weight > 0.5")
def merge_predictions(spark, sf_dir):
    p = S.predictions(spark, sf_dir)
    other = p.filter("sample_weight > 0.5").select("subject_id", "sample_index", (1 - F.col("predicted_b")).alias("predicted_label"))
    return J.merge_predictions(p.select("subject_id", "sample_index", "predicted_label"), other)


@register(f"{METRICS} SELECT subject_id, num_samples, f1, f1 IS NULL AS missing FROM (SELECT subject_id, num_samples FROM metrics) LEFT JOIN (SELECT subject_id, f1 FROM metrics WHERE f1 >= 0.4) USING (subject_id)")
def attach_metric(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return J.attach_metric(m.select("subject_id", "num_samples"), m.filter("f1 >= 0.4"))


@register(
    f"""{METRICS}, m AS (SELECT subject_id, subject_id % 3 AS k, "precision" FROM metrics UNION ALL SELECT subject_id, 7, recall FROM metrics WHERE recall > 0.45),
    c AS (SELECT subject_id, "precision", row_number() OVER (PARTITION BY subject_id ORDER BY CAST(k <> 2 AS INTEGER), k) AS r FROM m)
    SELECT subject_id, num_samples, p AS "precision" FROM metrics JOIN (SELECT subject_id, "precision" AS p FROM c WHERE r = 1) USING (subject_id)"""
)
def channel_power_precision(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    by_k = m.select("subject_id", (F.col("subject_id") % 3).alias("k"), "precision").unionByName(m.filter("recall > 0.45").select("subject_id", F.lit(7).cast("long").alias("k"), F.col("recall").alias("precision")))
    return J.channel_power_precision(m.select("subject_id", "num_samples"), by_k, 2)


@register(
    f"""WITH {S.SAMPLES_SQL}, a AS (SELECT session_id, event_type, idx, k AS x, k * 0.5 + ref AS y FROM samples)
    SELECT session_id, event_type, count(*) AS n, round(corr(x, y), 6) AS correlation, round(avg(x), 6) AS mean_a, round(stddev_pop(x), 6) AS std_a, round(avg(y), 6) AS mean_b, round(stddev_pop(y), 6) AS std_b FROM a GROUP BY ALL"""
)
def compare_preprocessing(spark, sf_dir):
    s = S.samples(spark, sf_dir)
    keys = ("session_id", "event_type", "idx")
    out = J.compare_preprocessing(s.select(*keys, F.col("x")[1].alias("x")), s.select(*keys, (F.col("x")[1] * 0.5 + F.col("x")[2]).alias("x")), keys)
    return rounded(out, "correlation", "mean_a", "std_a", "mean_b", "std_b")


@register(f"{EPOCHS} SELECT vec_id, subject_id FROM epochs WHERE label <> 1 AND NOT is_background")
def exclude_label(spark, sf_dir):
    return P.drop_background(P.exclude_label(S.epochs(spark, sf_dir), 1)).select("vec_id", "subject_id")


@register(f"{EPOCHS} SELECT vec_id, subject_id FROM epochs WHERE subject_id IN (SELECT subject_id FROM epochs WHERE sample_weight > 0.97::DOUBLE) AND subject_id NOT IN (SELECT subject_id FROM epochs WHERE sample_weight < 0.01::DOUBLE)")
def select_subjects(spark, sf_dir):
    e = S.epochs(spark, sf_dir)
    return P.exclude_subjects(P.select_subjects(e, e.filter("sample_weight > 0.97")), e.filter("sample_weight < 0.01")).select("vec_id", "subject_id")


@register(f"{PRED} SELECT subject_id, event_id, sample_index FROM pred WHERE subject_id IN (SELECT subject_id FROM pred GROUP BY subject_id HAVING count(*) >= 600 AND count(DISTINCT true_label) > 1)")
def require_group_size(spark, sf_dir):
    return P.require_group_size(S.predictions(spark, sf_dir), 600, label="true_label").select("subject_id", "event_id", "sample_index")


_LABELS = " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in P.EVENT_LABELS.items())
ANNOTATED = f"WITH {S.SAMPLES_SQL}, {S.ANNOTATIONS_SQL}"


@register(f"{ANNOTATED} SELECT subject_id, event_id, split_part(description, '#', 1) AS event, CAST(CASE split_part(description, '#', 1) {_LABELS} END AS INTEGER[]) AS labels FROM annotations")
def decode_event_label(spark, sf_dir):
    return P.decode_event_label(S.annotations(spark, sf_dir)).select("subject_id", "event_id", "event", "labels")


@register(f"{ANNOTATED} SELECT subject_id, event_id, CASE WHEN contains(description, 'VAS=') THEN TRY_CAST(split_part(description, 'VAS=', 2) AS DOUBLE) / 100 ELSE 1 END AS score FROM annotations")
def parse_score(spark, sf_dir):
    return S.annotations(spark, sf_dir).select("subject_id", "event_id", P.parse_score(F.col("description")).alias("score"))


@register(
    f"""{EPOCHS} SELECT vec_id, CASE WHEN is_background THEN 0 WHEN label = 0 THEN 1 WHEN label = 1 AND is_right_hand THEN 2 WHEN label = 1 THEN 3 ELSE -1 END AS coarse,
    CASE WHEN is_background THEN 0 WHEN label = 0 THEN 1 WHEN label = 1 AND is_point THEN 4 WHEN label = 1 AND is_right_hand THEN 2 WHEN label = 1 THEN 3 ELSE -1 END AS fine FROM epochs"""
)
def condition_class(spark, sf_dir):
    once = P.condition_class(S.epochs(spark, sf_dir)).withColumnRenamed("condition", "coarse")
    return P.condition_class(once, fine=True).select("vec_id", "coarse", F.col("condition").alias("fine"))


@register(f"{ANNOTATED} SELECT subject_id, event_id FROM annotations WHERE split_part(description, '@@', 1) IN ('Rest', 'Image') AND subject_id % 2 = 0 AND event_id % 3 IN (0, 1)")
def trial_filter(spark, sf_dir):
    a = S.annotations(spark, sf_dir)
    named = a.withColumns({"event": F.split_part("description", F.lit("@@"), F.lit(1)), "block_type": F.when(F.col("subject_id") % 2 == 0, "even").otherwise("odd"), "trial_type": (F.col("event_id") % 3).cast("string")})
    return P.trial_filter(named, ["Rest", "Image"], "even", ["0", "1"]).select("subject_id", "event_id")


@register(f"{PRED} SELECT subject_id, sample_index, proba FROM pred WHERE sample_weight >= 0.1 AND proba > 0")
def valid_predictions(spark, sf_dir):
    p = S.predictions(spark, sf_dir)
    holes = p.withColumns({"predicted_label": F.when(F.col("sample_weight") < 0.1, -99).otherwise(F.col("predicted_label")), "proba": F.when(F.col("proba") == 0, float("nan")).otherwise(F.col("proba"))})
    return P.valid_predictions(holes, score="proba").select("subject_id", "sample_index", "proba")


@register(f"{ANNOTATED} SELECT DISTINCT split_part(description, '#', 1) AS event FROM annotations")
def event_vocabulary(spark, sf_dir):
    named = P.decode_event_label(S.annotations(spark, sf_dir))
    return W.event_vocabulary(named.filter("subject_id % 2 = 0"), named.filter("subject_id % 2 = 1"))


@register(f"{METRICS} SELECT 'a' AS pipeline, subject_id, f1 FROM metrics UNION ALL SELECT 'b', subject_id, recall FROM metrics")
def concat_results(spark, sf_dir):
    from sigloom.plans.pipeline import concat_named

    m = _metrics(spark, sf_dir)
    return concat_named({"a": m.select("subject_id", "f1"), "b": m.select("subject_id", F.col("recall").alias("f1"))}, "pipeline")


@register(f"{EPOCHS}, c AS (SELECT subject_id AS fold, count(*) AS test_rows FROM epochs GROUP BY subject_id) SELECT fold, test_rows, CAST(sum(test_rows) OVER () - test_rows AS BIGINT) AS train_rows FROM c")
def group_folds(spark, sf_dir):
    return P.group_folds(S.epochs(spark, sf_dir))


@register(f"{PRED} SELECT subject_id, sample_index, round((sample_index) / nullif(count(*) OVER (PARTITION BY subject_id) - 1, 0), 6) AS fraction, round(0.2 + 0.8 * sample_index / nullif(count(*) OVER (PARTITION BY subject_id) - 1, 0), 6) AS weight FROM pred")
def time_fraction(spark, sf_dir):
    return rounded(W.time_fraction(S.predictions(spark, sf_dir), order="sample_index"), "fraction", "weight").select("subject_id", "sample_index", "fraction", "weight")


@register(f"{PRED} SELECT subject_id, sample_index // 2 AS pair_index, max(proba) FILTER (sample_index % 2 = 0) AS first, max(proba) FILTER (sample_index % 2 = 1) AS second, max(sample_weight) FILTER (sample_index % 2 = 1) AS score FROM pred GROUP BY ALL HAVING count(*) = 2")
def pair_consecutive(spark, sf_dir):
    return W.pair_consecutive(S.predictions(spark, sf_dir), "proba", "sample_weight", order="sample_index")


@register(
    f"""{PRED}, v AS (SELECT subject_id, event_id, CAST(avg(true_label) >= 0.5 AS INTEGER) AS true_label, CAST(avg(predicted_label) >= 0.5 AS INTEGER) AS predicted_label FROM pred GROUP BY subject_id, event_id)
    SELECT subject_id, CAST(count(*) FILTER (true_label = predicted_label) AS BIGINT) AS same, count(*) AS n FROM v GROUP BY subject_id"""
)
def compare_sequences(spark, sf_dir):
    votes = A.event_vote(S.predictions(spark, sf_dir), ["subject_id", "event_id"])
    at = W.sample_index(votes, ["event_id"], name="pos")
    out = J.compare_sequences(at.select("subject_id", "pos", F.col("true_label").cast("string").alias("state")), at.select("subject_id", "pos", F.col("predicted_label").cast("string").alias("state")), key="subject_id")
    return out.groupBy("subject_id").agg(F.count_if("same").alias("same"), F.count("*").alias("n"))
