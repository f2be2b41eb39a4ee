"""Matrix jobs on two channels, where roots, logarithms and eigenvectors have closed forms, so that SQL says the same.

A symmetric matrix is three columns. ``means`` writes out the fixed-point steps of the Riemannian mean as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import matrix
from sigloom.operators import aggregates as A
from sigloom.operators import projections as P
from sigloom.operators import windows as W
from sigloom.plans import evaluate as E
from sigloom.plans.pipeline import Step, run_pipeline
from sigloom.queries import standins as S
from sigloom.queries.matrices import COV2, DIST2, rows2
from sigloom.queries.relational import CELLS, RATE_NAMES, RATES, p_sql, rounded
from sigloom.sources.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 4
ROUNDS = 12


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def staged2(spark, sf_dir) -> DataFrame:
    return stage(rows2(spark, sf_dir), "rows")


def cut(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded entries; adding zero takes the sign off a zero."""
    return F.transform(c, lambda v: F.round(v, digits) + 0.0)


def cut_sql(*entries: str, digits: int = DIGITS) -> str:
    return "[" + ", ".join(f"round({e}, {digits}) + 0.0" for e in entries) + "]"


# Columns of a SELECT, each name used by those after it; p is their prefix.
def roots(p: str, a: str, b: str, d: str) -> str:
    """Root (pra, prb, prd) and inverse root (pia, pib, pid)."""
    return f"""sqrt({a} * {d} - {b} * {b}) AS {p}s, sqrt({a} + {d} + 2 * {p}s) AS {p}t, ({a} + {p}s) / {p}t AS {p}ra, {b} / {p}t AS {p}rb, ({d} + {p}s) / {p}t AS {p}rd,
        ({d} + {p}s) / ({p}s * {p}t) AS {p}ia, -({b}) / ({p}s * {p}t) AS {p}ib, ({a} + {p}s) / ({p}s * {p}t) AS {p}id"""


def congruent(p: str, e: tuple[str, str, str, str], a: str, b: str, d: str) -> str:
    """E C E' (p00, p01, p11)."""
    w, x, y, z = e
    return f"""{w} * {w} * {a} + 2 * {w} * {x} * {b} + {x} * {x} * {d} AS {p}00, {w} * {y} * {a} + ({w} * {z} + {x} * {y}) * {b} + {x} * {z} * {d} AS {p}01,
        {y} * {y} * {a} + 2 * {y} * {z} * {b} + {z} * {z} * {d} AS {p}11"""


def spectral(p: str, f: Callable[[str], str], slope: Callable[[str], str], a: str, b: str, d: str) -> str:
    """A function of a symmetric matrix through its eigenvalues (p00, p01, p11); ``slope``: its derivative, where they are equal."""
    return f"""({a} + {d}) / 2 AS {p}m, sqrt((({a} - {d}) / 2) ** 2 + {b} * {b}) AS {p}q, CASE WHEN {p}q <= 1e-12 * abs({p}m) THEN {slope(p + "m")} ELSE ({f(f"({p}m + {p}q)")} - {f(f"({p}m - {p}q)")}) / (2 * {p}q) END AS {p}c,
        ({f(f"({p}m + {p}q)")} + {f(f"({p}m - {p}q)")}) / 2 AS {p}h, {p}h + {p}c * ({a} - {d}) / 2 AS {p}00, {p}c * {b} AS {p}01, {p}h - {p}c * ({a} - {d}) / 2 AS {p}11"""


def log_of(p: str, a: str, b: str, d: str) -> str:
    return spectral(p, lambda x: f"ln({x})", lambda x: f"1 / {x}", a, b, d)


def exp_of(p: str, a: str, b: str, d: str) -> str:
    return spectral(p, lambda x: f"exp({x})", lambda x: f"exp({x})", a, b, d)


def means(source: str, by: list[str], out: str, weight: str = "1") -> str:
    """CTEs that end in ``out`` (by, a, b, d, n): weighted means of the matrices (s00, s01, s11) of ``source``."""
    keys, group = "".join(f"{k}, " for k in by), f"GROUP BY {', '.join(by)}" if by else ""
    meet = lambda x: f"JOIN {x} USING ({', '.join(by)})" if by else f"CROSS JOIN {x}"
    parts = [f"{out}_0 AS MATERIALIZED (SELECT {keys}sum({weight} * s00) / sum({weight}) AS a, sum({weight} * s01) / sum({weight}) AS b, sum({weight} * s11) / sum({weight}) AS d, sum({weight}) AS n FROM {source} {group})"]
    for k in range(ROUNDS):
        m = f"{out}_{k}"
        parts += [
            f"{m}i AS MATERIALIZED (SELECT *, {roots('r', 'a', 'b', 'd')} FROM {m})",
            f"{m}w AS (SELECT {keys}{weight} AS wt, {congruent('w', ('ria', 'rib', 'rib', 'rid'), 's00', 's01', 's11')} FROM {source} {meet(m + 'i')})",
            f"{m}l AS (SELECT {keys}wt, {log_of('l', 'w00', 'w01', 'w11')} FROM {m}w)",
            f"{m}s AS (SELECT {keys}sum(wt * l00) / sum(wt) AS x00, sum(wt * l01) / sum(wt) AS x01, sum(wt * l11) / sum(wt) AS x11 FROM {m}l {group})",
            f"{m}e AS (SELECT {keys}n, rra, rrb, rrd, {exp_of('e', 'x00', 'x01', 'x11')} FROM {m}i {meet(m + 's')})",
            f"{m}z AS (SELECT {keys}n, {congruent('z', ('rra', 'rrb', 'rrb', 'rrd'), 'e00', 'e01', 'e11')} FROM {m}e)",
            f"{out}_{k + 1} AS MATERIALIZED (SELECT {keys}z00 AS a, z01 AS b, z11 AS d, n FROM {m}z)",
        ]
    return ",\n    ".join([*parts, f"{out} AS MATERIALIZED (SELECT * FROM {out}_{ROUNDS})"])


COV = COV2.replace("cov AS (", "cov AS MATERIALIZED (").replace("WITH ", "WITH RECURSIVE ", 1)
SUBJECT = f"{COV}, {means('cov', ['subject_id'], 'mean')}"
AS_ROWS = "as_rows AS MATERIALIZED (SELECT subject_id, a AS s00, b AS s01, d AS s11, n AS held FROM mean)"
GENERAL = f"{SUBJECT}, {AS_ROWS}, {means('as_rows', [], 'general', 'held')}"


@register(f"{SUBJECT} SELECT subject_id, {cut_sql('a', 'b', 'b', 'd', digits=7)} AS mean, CAST(n AS DOUBLE) AS n FROM mean")
def subject_means_2ch(spark, sf_dir):
    return matrix.subject_means(staged2(spark, sf_dir)).select("subject_id", cut("mean", 7).alias("mean"), "n")


@register(
    f"""{SUBJECT}, {AS_ROWS}, others AS MATERIALIZED (SELECT f.subject_id AS fold, s00, s01, s11, held FROM as_rows JOIN (SELECT subject_id FROM as_rows) f ON f.subject_id <> as_rows.subject_id),
    {means('others', ['fold'], 'apart', 'held')} SELECT fold, {cut_sql('a', 'b', 'b', 'd', digits=7)} AS mean, CAST(n AS DOUBLE) AS n FROM apart"""
)
def general_mean_excluding_2ch(spark, sf_dir):
    means_ = stage(matrix.subject_means(staged2(spark, sf_dir)), "means")
    return matrix.general_mean_excluding(means_).select("fold", cut("mean", 7).alias("mean"), "n")


MOVED = f"""{GENERAL}, placed AS (SELECT mean.subject_id, g.a AS ga, g.b AS gb, g.d AS gd, {roots('m', 'mean.a', 'mean.b', 'mean.d')} FROM mean CROSS JOIN general g),
    seen AS (SELECT *, {congruent('k', ('mia', 'mib', 'mib', 'mid'), 'ga', 'gb', 'gd')} FROM placed),
    half AS (SELECT *, {roots('h', 'k00', 'k01', 'k11')} FROM seen),
    e AS MATERIALIZED (SELECT subject_id, ga, gb, gd, mra * hra + mrb * hrb AS t00, mra * hrb + mrb * hrd AS t01, mrb * hra + mrd * hrb AS t10, mrb * hrb + mrd * hrd AS t11,
        t00 * mia + t01 * mib AS e00, t00 * mib + t01 * mid AS e01, t10 * mia + t11 * mib AS e10, t10 * mib + t11 * mid AS e11 FROM half),
    moved AS MATERIALIZED (SELECT vec_id, subject_id, event_id, label, i, ga, gb, gd, {congruent('c', ('e00', 'e01', 'e10', 'e11'), 's00', 's01', 's11')} FROM cov JOIN e USING (subject_id))"""


@register(f"{MOVED} SELECT vec_id, subject_id, {cut_sql('c00', 'c01', 'c01', 'c11', digits=6)} AS cov FROM moved")
def transport_2ch(spark, sf_dir):
    return E.transport_dataset(S.epochs(spark, sf_dir, 2), 2)[0].select("vec_id", "subject_id", cut("cov", 6).alias("cov"))


TANGENT = f"""g AS (SELECT {roots('g', 'a', 'b', 'd')} FROM general), gw AS (SELECT vec_id, subject_id, event_id, label, i, {congruent('w', ('gia', 'gib', 'gib', 'gid'), '{0}00', '{0}01', '{0}11')} FROM {{1}} CROSS JOIN g),
    tangent AS MATERIALIZED (SELECT *, {log_of('l', 'w00', 'w01', 'w11')}, sqrt(2) * l01 AS l01s FROM gw)"""


@register(f"{MOVED}, {TANGENT.replace('{0}', 'c').replace('{1}', 'moved')} SELECT vec_id, subject_id, {cut_sql('l00', 'l01s', 'l11')} AS tangent FROM tangent")
def tangent_2ch(spark, sf_dir):
    return E.transport_dataset(S.epochs(spark, sf_dir, 2), 2)[1].select("vec_id", "subject_id", cut("tangent").alias("tangent"))


@register(
    f"""{GENERAL}, {TANGENT.replace('{0}', 's').replace('{1}', 'cov')}, near AS (
        SELECT a.subject_id, a.i AS test, a.label AS true_label, b.label AS label, sqrt((a.l00 - b.l00) ** 2 + (a.l01s - b.l01s) ** 2 + (a.l11 - b.l11) ** 2) AS dist,
               row_number() OVER (PARTITION BY a.subject_id, a.i ORDER BY dist, b.subject_id, b.i) AS r FROM tangent a JOIN tangent b ON a.subject_id <> b.subject_id),
    votes AS (SELECT subject_id, test, true_label, label, sum(CASE WHEN dist > 0 THEN 1 / dist ELSE 1e300 END) AS v FROM near WHERE r <= 25 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY subject_id, test ORDER BY v DESC, label) AS r FROM votes)
    SELECT subject_id, test, true_label, label AS predicted_label FROM best WHERE r = 1"""
)
def tangent_knn_loso_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    return E.tangent_knn_loso(rows, matrix.general_mean(stage(matrix.subject_means(rows), "means")), 25)


# Class means, then the eigenvectors of the first one seen from their sum: k = 1, 2 in order of their eigenvalue's distance from one half.
def csp_sql(by: str) -> str:
    keys = [by, "label"] if by else ["label"]
    both = f"JOIN (SELECT * FROM class WHERE label = 1) y USING ({by})" if by else "CROSS JOIN (SELECT * FROM class WHERE label = 1) y"
    name = f"x.{by} AS {by}, " if by else ""
    kept = f"{by}, " if by else ""
    return f"""{means('cov', keys, 'class')},
    summed AS (SELECT {name}x.a AS fa, x.b AS fb, x.d AS fd, {roots('c', '(x.a + y.a)', '(x.b + y.b)', '(x.d + y.d)')} FROM (SELECT * FROM class WHERE label = 0) x {both}),
    turned AS (SELECT *, {congruent('v', ('cia', 'cib', 'cib', 'cid'), 'fa', 'fb', 'fd')} FROM summed),
    values_ AS (SELECT *, (v00 + v11) / 2 AS vm, sqrt(((v00 - v11) / 2) ** 2 + v01 * v01) AS vq, unnest([vm - vq, vm + vq]) AS eigen FROM turned),
    csp AS MATERIALIZED (SELECT {kept}cia, cib, cid, cra, crb, crd, CAST(row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY -abs(eigen - 0.5), eigen) AS INTEGER) AS k,
        v01 / sqrt(v01 * v01 + (eigen - v00) ** 2) AS p, (eigen - v00) / sqrt(v01 * v01 + (eigen - v00) ** 2) AS q FROM values_)"""


@register(
    f"""{COV}, {csp_sql('')}, power AS (SELECT vec_id, k, p * cia + q * cib AS w0, p * cib + q * cid AS w1, ln(w0 * w0 * s00 + 2 * w0 * w1 * s01 + w1 * w1 * s11) AS f FROM cov CROSS JOIN csp)
    SELECT vec_id, [round(max(f) FILTER (k = 1), {DIGITS}) + 0.0, round(max(f) FILTER (k = 2), {DIGITS}) + 0.0] AS features FROM power GROUP BY vec_id"""
)
def csp_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    model = matrix.csp_fit(rows.withColumn("all", F.lit(0)), ["all"], 2).select(F.col("filters").alias("w"))
    return rows.crossJoin(F.broadcast(model)).select("vec_id", cut(matrix.filtered("w", "cov")).alias("features"))


POOLED = f"""WITH {S.EPOCHS_SQL}, bg AS (SELECT subject_id, sample[1:32] AS x, sample[33:64] AS y FROM epochs WHERE is_background),
    sums AS (SELECT subject_id, count(*) * 32 AS n, sum(list_sum(x)) / (count(*) * 32) AS mx, sum(list_sum(y)) / (count(*) * 32) AS my,
        sum(list_sum(list_transform(x, lambda v: v * v))) / (count(*) * 32) - mx * mx AS c00, sum(list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2]))) / (count(*) * 32) - mx * my AS c01,
        sum(list_sum(list_transform(y, lambda v: v * v))) / (count(*) * 32) - my * my AS c11 FROM bg GROUP BY subject_id),
    oas AS (SELECT subject_id, n, (c00 + c11) / 2 AS mu, (c00 * c00 + 2 * c01 * c01 + c11 * c11) / 4 AS alpha, least(1, (alpha + mu * mu) / ((n + 1) * (alpha - mu * mu / 2))) AS rho,
        (1 - rho) * c00 + rho * mu AS s00, (1 - rho) * c01 AS s01, (1 - rho) * c11 + rho * mu AS s11 FROM sums),
    pooled AS MATERIALIZED (SELECT *, {roots('w', 's00', 's01', 's11')} FROM oas)"""


@register(f"{POOLED} SELECT subject_id, CAST(n AS DOUBLE) AS n, {cut_sql('s00', 's01', 's01', 's11', digits=9)} AS cov, {cut_sql('wia', 'wib', 'wib', 'wid')} AS whitening FROM pooled")
def pooled_covariance_2ch(spark, sf_dir):
    out = matrix.pooled_covariance(S.epochs(spark, sf_dir, 2).filter("is_background"), ["subject_id"], 2)
    return out.select("subject_id", "n", cut("cov", 9).alias("cov"), cut("whitening").alias("whitening"))


WHITE = f"{POOLED}, white AS MATERIALIZED (SELECT vec_id, list_transform(list_zip(sample[1:32], sample[33:64]), lambda p: wia * p[1] + wib * p[2]) AS x, list_transform(list_zip(sample[1:32], sample[33:64]), lambda p: wib * p[1] + wid * p[2]) AS y FROM epochs JOIN pooled USING (subject_id))"


@register(f"{WHITE} SELECT vec_id, list_transform(list_concat(x, y), lambda v: round(v, {DIGITS}) + 0.0) AS sample FROM white")
def whitening_2ch(spark, sf_dir):
    epochs = S.epochs(spark, sf_dir, 2)
    w = stage(matrix.pooled_covariance(epochs.filter("is_background"), ["subject_id"], 2), "whitening")
    return matrix.apply_whitening(epochs, w).select("vec_id", cut("sample").alias("sample"))


_LAGGED = ["x[1:28]", "y[1:28]", "x[3:30]", "y[3:30]"]
_ENTRY = lambda i, j: f"m{min(i, j)}{max(i, j)}"


@register(
    f"""{WHITE}, lagged AS (SELECT vec_id, {', '.join(f'list_transform({c}, lambda v: v - list_avg({c})) AS c{k}' for k, c in enumerate(_LAGGED))} FROM white),
    moments AS (SELECT vec_id, {', '.join(f'list_sum(list_transform(list_zip(c{i}, c{j}), lambda p: p[1] * p[2])) / 28 AS m{i}{j}' for i in range(4) for j in range(i, 4))} FROM lagged),
    shrunk AS (SELECT *, (m00 + m11 + m22 + m33) / 4 AS mu, ({' + '.join(f'{_ENTRY(i, j)} ** 2' for i in range(4) for j in range(4))}) / 16 AS alpha, least(1, (alpha + mu * mu) / (29 * (alpha - mu * mu / 4))) AS rho FROM moments)
    SELECT vec_id, {cut_sql(*[f"(1 - rho) * {_ENTRY(i, j)}" + (" + rho * mu" if i == j else "") for i in range(4) for j in range(4)])} AS cov FROM shrunk"""
)
def pipeline_steps_2ch(spark, sf_dir):
    """Whitening as a fitted calibration step, then lag embedding and covariance."""
    steps = [
        Step("covariance", lambda df, _: df.withColumn("cov", matrix.covariance("sample", 4))),
        Step("whiten", lambda df, t: matrix.apply_whitening(df, t["whitening"]), fit=lambda df: {"whitening": stage(matrix.pooled_covariance(df.filter("is_background"), ["subject_id"], 2), "whitening")}, calibration=True),
        Step("embed", lambda df, _: P.lag_embed(df, 2, 2), calibration=True),
    ]
    return run_pipeline(S.epochs(spark, sf_dir, 2), steps).select("vec_id", cut("cov").alias("cov"))


@register(
    f"""{GENERAL}, d AS (SELECT x.subject_id, x.i AS i, y.i AS j, x.s00 - y.s00 AS u, x.s01 - y.s01 AS v, x.s11 - y.s11 AS w FROM cov x JOIN cov y ON x.subject_id = y.subject_id AND x.i < y.i)
    SELECT subject_id, i, j, round(sqrt((g.a * u + g.b * v) ** 2 + (g.a * v + g.b * w) ** 2 + (g.b * v + g.d * w) ** 2), 9) AS d FROM d CROSS JOIN general g"""
)
def reference_weighted_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    found = E.reference_pairs(rows.withColumn("tangent", P.flatten_upper(F.col("cov"), 2)), "tangent", matrix.general_mean(stage(matrix.subject_means(rows), "means")))
    return found.select("subject_id", "i", "j", P.round_half_away(F.col("d"), 9).alias("d"))


_MATRIX_SQL = {
    "sqrtm": f"(SELECT {cut_sql('kra', 'krb', 'krb', 'krd', digits=6)} FROM (SELECT {roots('k', 's00', 's01', 's11')}))",
    "invsqrtm": f"(SELECT {cut_sql('kia', 'kib', 'kib', 'kid')} FROM (SELECT {roots('k', 's00', 's01', 's11')}))",
    "logm": f"(SELECT {cut_sql('k00', 'k01', 'k01', 'k11', digits=6)} FROM (SELECT {log_of('k', 's00', 's01', 's11')}))",
    "expm": f"(SELECT {cut_sql('k00', 'k01', 'k01', 'k11', digits=6)} FROM (SELECT {exp_of('k', 's00', 's01', 's11')}))",
    "inv": cut_sql("s11 / (s00 * s11 - s01 * s01)", "-s01 / (s00 * s11 - s01 * s01)", "-s01 / (s00 * s11 - s01 * s01)", "s00 / (s00 * s11 - s01 * s01)", digits=3),
}


@register(
    f"""{COV}, parts AS (SELECT vec_id, unnest([0, 1, 2]) AS part, sample FROM epochs)
    SELECT vec_id, part, {', '.join(f'{v} AS {k}' for k, v in _MATRIX_SQL.items())}, list_concat(p.sample[part * 10 + 1 : part * 10 + 10], p.sample[33 + part * 10 : 42 + part * 10]) AS sample FROM cov JOIN parts p USING (vec_id)"""
)
def matrix_sql_2ch(spark, sf_dir):
    """All matrix functions and the window splitter as SQL functions."""
    matrix.register_sql(spark)
    staged2(spark, sf_dir).createOrReplaceTempView("sigloom_epochs_2ch")
    out = spark.sql(f"SELECT vec_id, part, {', '.join(f'matrix_{k}(cov) AS {k}' for k in _MATRIX_SQL)}, s.sample AS sample FROM sigloom_epochs_2ch, LATERAL split_windows(sigloom_epochs_2ch.sample, 2, 3) s")
    digits = {"invsqrtm": DIGITS, "inv": 3}
    return out.select("vec_id", "part", "sample", *[cut(k, digits.get(k, 6)).alias(k) for k in _MATRIX_SQL])


# Leave-one-out votes from a table of distances (subject_id, i, j, e1, e2, l1, l2, d), as CTEs that end in votes_<name> and metrics_<name>.
def loo_sql(dist: str, name: str, k: int) -> str:
    return f"""open_{name} AS (SELECT *, max(CAST(e1 <> e2 AS INTEGER)) OVER (PARTITION BY subject_id, i) AS other FROM {dist}),
    near_{name} AS (SELECT *, row_number() OVER (PARTITION BY subject_id, i ORDER BY d, j) AS r FROM open_{name} WHERE e1 <> e2 OR other = 0),
    count_{name} AS (SELECT subject_id, i, l1, l2, count(*) AS n FROM near_{name} WHERE r <= {k} GROUP BY ALL),
    best_{name} AS (SELECT *, row_number() OVER (PARTITION BY subject_id, i ORDER BY n DESC, l2) AS r FROM count_{name}),
    votes_{name} AS (SELECT subject_id, i AS test, l1 AS true_label, l2 AS predicted_label FROM best_{name} WHERE r = 1),
    cells_{name} AS (SELECT subject_id, {CELLS} FROM votes_{name} GROUP BY subject_id),
    metrics_{name} AS (SELECT subject_id, tp + tn + fp + fn AS num_samples, {RATES} FROM cells_{name})"""


LOO = DIST2.format(op="=", cond="AND a.i <> b.i")


def _metrics(rows: DataFrame, k: int) -> DataFrame:
    return rounded(E.knn_metrics(E.riemannian_knn_loo(rows, k)), *RATE_NAMES)


@register(f"{LOO}, {loo_sql('dist', 'a', 25)} SELECT * FROM metrics_a")
def knn_metrics_2ch(spark, sf_dir):
    return _metrics(staged2(spark, sf_dir), 25)


@register(f"{LOO}, {loo_sql('dist', 'a', 25)} SELECT * FROM metrics_a ORDER BY f1 DESC, subject_id LIMIT 10")
def calibrated_top_subjects_2ch(spark, sf_dir):
    return W.top_subjects(_metrics(staged2(spark, sf_dir), 25))


@register(
    f"""{LOO}, {loo_sql('dist', 'a', 5)}, {loo_sql('dist', 'b', 15)}, both_ AS (SELECT 'k5' AS pipeline, * FROM metrics_a UNION ALL SELECT 'k15', * FROM metrics_b),
    long AS (SELECT pipeline, measure, value FROM both_ UNPIVOT (value FOR measure IN (accuracy, "precision", recall, f1)))
    SELECT pipeline, measure, count(value) AS "count", round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 9) AS q25,
           round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.75), 9) AS q75, max(value) AS max FROM long GROUP BY ALL"""
)
def compare_pipelines_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    table = E.compare_pipelines({"k5": lambda: _metrics(rows, 5), "k15": lambda: _metrics(rows, 15)})[1]
    return rounded(table, "mean", "std", "q25", "q50", "q75", digits=9)


def _renamed(sql: str, suffix: str) -> str:
    """The distance CTEs on another table of matrices."""
    body = sql.split(", pair AS (", 1)[1]
    return f"pair{suffix} AS (" + body.replace("cov a JOIN cov b", f"cov{suffix} a JOIN cov{suffix} b").replace("dist AS (", f"dist{suffix} AS (").replace("FROM pair)", f"FROM pair{suffix})")


@register(
    f"""{LOO}, cov_p AS (SELECT r.vec_id, r.subject_id, r.event_id, r.label, c00 + 1e-3 AS s00, c01 AS s01, c11 + 1e-3 AS s11, i FROM rho r JOIN cov USING (vec_id)), {_renamed(LOO, '_p')},
    {loo_sql('dist', 'a', 5)}, {loo_sql('dist_p', 'b', 5)}, two AS (SELECT subject_id, metrics_a.f1 AS a, metrics_b.f1 AS b FROM metrics_a JOIN metrics_b USING (subject_id))
    SELECT subject_id, a, b, round(b - a, 6) + 0.0 AS difference, CASE WHEN abs(round(b - a, 6)) < 0.02 THEN 'equivalent' WHEN abs(round(b - a, 6)) < 0.05 THEN 'similar' WHEN b > a THEN 'better' ELSE 'worse' END AS verdict FROM two"""
)
def preprocessing_comparison_2ch(spark, sf_dir):
    plain = E.with_covariance(S.epochs(spark, sf_dir, 2), 2, shrink=False).withColumn("cov", F.transform("cov", lambda v, k: v + F.when(k % 3 == 0, 1e-3).otherwise(0.0)))
    out = E.preprocessing_comparison(_metrics(staged2(spark, sf_dir), 5), _metrics(stage(plain, "plain"), 5))
    return out.withColumn("difference", F.round("difference", 6) + 0.0)


def spearman_sql(source: str, by: str, x: str, y: str) -> str:
    """CTEs ``ranked`` and ``spearman`` (by, n, rho)."""
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"
    return f"ranked AS (SELECT {by}, {rank(x)} AS ra, {rank(y)} AS rb FROM {source}), spearman AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM ranked GROUP BY {by})"


@register(
    f"""{LOO}, {loo_sql('dist', 'a', 5)}, steps AS (SELECT subject_id, i // 2 AS pair_index, d FROM dist WHERE i % 2 = 0 AND j = i + 1), {spearman_sql('steps', 'subject_id', 'd', 'pair_index')}
    SELECT subject_id, n, round(rho, 6) AS rho, round({p_sql('rho', 'n')}, 6) AS p, f1, f1 IS NULL AS missing FROM spearman LEFT JOIN metrics_a USING (subject_id)"""
)
def pair_distance_vs_index_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    return rounded(E.pair_distance_vs_index(rows, "sample_weight", _metrics(rows, 5)), "rho", "p")


@register(
    f"""{LOO.replace("WITH ", "WITH RECURSIVE ", 1)}, {loo_sql('dist', 'a', 5)}, {csp_sql('subject_id')},
    patterns AS (SELECT subject_id, k - 1 AS filter, unnest([0, 1]) AS channel, unnest([abs(p * cra + q * crb), abs(p * crb + q * crd)]) AS power FROM csp),
    scaled AS (SELECT *, coalesce((power - min(power) OVER w) / nullif(max(power) OVER w - min(power) OVER w, 0), 0) AS s FROM patterns WINDOW w AS (PARTITION BY subject_id, filter)),
    r AS (SELECT channel, filter, count(*) AS n, CASE WHEN stddev_pop(s) > 0 AND stddev_pop("precision") > 0 THEN corr(s, "precision") END AS r FROM scaled JOIN metrics_a USING (subject_id) GROUP BY ALL HAVING count(*) > 5)
    SELECT channel, CAST(filter AS INTEGER) AS filter, n, round(r, 6) + 0.0 AS r, round({p_sql('r', 'n')}, 6) AS p FROM r"""
)
def channel_contribution_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    out = E.channel_contribution(rows, _metrics(rows, 5).withColumn("k", F.lit(5).cast("long")), 2, 2, 5)
    return out.withColumns({"r": F.round("r", 6) + 0.0, "p": F.round("p", 6)})


@register(
    f"""{COV}, centred3 AS (SELECT vec_id, subject_id, event_id, label, row_number() OVER (PARTITION BY subject_id ORDER BY event_id, vec_id) - 1 AS i, a, b FROM centred),
    m AS (SELECT *, {', '.join(f'list_sum(list_transform(list_zip(a, b), lambda p: p[1] ** {3 - k} * p[2] ** {k})) / 32 AS m{k}' for k in range(4))} FROM centred3),
    sh AS (SELECT *, m0 ** 2 + 3 * m1 ** 2 + 3 * m2 ** 2 + m3 ** 2 AS norm, (m0 + m3) ** 2 AS s, 32 * norm - 15 * s AS below, CASE WHEN below = 0 THEN 1 ELSE least(1, greatest(0, s / below)) END AS rho FROM m),
    dist3 AS (SELECT x.subject_id, x.i AS i, y.i AS j, x.event_id AS e1, y.event_id AS e2, x.label AS l1, y.label AS l2,
        sqrt({' + '.join(f'((1 - x.rho) * x.m{k} - (1 - y.rho) * y.m{k}) ** 2' for k in range(4))}) AS d FROM sh x JOIN sh y ON x.subject_id = y.subject_id AND x.i <> y.i),
    {loo_sql('dist3', 'a', 25)} SELECT * FROM votes_a"""
)
def third_moment_knn_2ch(spark, sf_dir):
    return E.third_moment_knn(S.epochs(spark, sf_dir, 2), 2, 25)


# The mean moves along the geodesic to each row by that row's share of the weight so far.
@register(
    f"""{GENERAL}, cap AS (SELECT floor(avg(n)) AS cap FROM mean),
    walk AS (SELECT subject_id, CAST(0 AS BIGINT) AS step, general.a AS a, general.b AS b, general.d AS d, CAST(1 AS DOUBLE) AS n FROM general CROSS JOIN (SELECT DISTINCT subject_id FROM cov)
        UNION ALL SELECT subject_id, step + 1, z00, z01, z11, n + 1 FROM (SELECT *, {congruent('z', ('rra', 'rrb', 'rrb', 'rrd'), 'k00', 'k01', 'k11')} FROM (
            SELECT *, {spectral('k', lambda x: f'pow({x}, 1 / (n + 1))', lambda x: f'pow({x}, 1 / (n + 1) - 1) / (n + 1)', 'w00', 'w01', 'w11')} FROM (
                SELECT *, {congruent('w', ('ria', 'rib', 'rib', 'rid'), 's00', 's01', 's11')} FROM (
                    SELECT walk.*, s00, s01, s11, {roots('r', 'walk.a', 'walk.b', 'walk.d')} FROM walk JOIN cov ON cov.subject_id = walk.subject_id AND cov.i = walk.step CROSS JOIN cap WHERE walk.n + 1 <= cap.cap))))),
    last AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY step DESC) AS r FROM walk)
    SELECT subject_id, {cut_sql('a', 'b', 'b', 'd', digits=6)} AS mean, n FROM last WHERE r = 1"""
)
def adapt_means_2ch(spark, sf_dir):
    rows = staged2(spark, sf_dir)
    general = stage(matrix.general_mean(stage(matrix.subject_means(rows), "means")), "general")
    start = rows.select("subject_id").distinct().crossJoin(F.broadcast(general.select("mean", F.lit(1.0).alias("n"), F.col("cap").cast("double").alias("cap"))))
    return E.adapt_means_batch(rows, start).select("subject_id", cut("mean", 6).alias("mean"), "n")


def geodesic_sql(source: str, way: str, t: str, old: tuple[str, str, str], p: str) -> str:
    """A subquery of ``source`` with the point (``p``00, ``p``01, ``p``11) at share ``t`` of the way from the matrix ``old`` to (s00, s01, s11); other names begin with ``way``."""
    r, w, k = f"{way}r", f"{way}w", f"{way}k"
    seen = f"SELECT *, {congruent(w, (f'{r}ia', f'{r}ib', f'{r}ib', f'{r}id'), 's00', 's01', 's11')} FROM (SELECT *, {roots(r, *old)} FROM ({source}))"
    powered = f"SELECT *, {spectral(k, lambda x: f'pow({x}, {t})', lambda x: f'{t} * pow({x}, {t} - 1)', f'{w}00', f'{w}01', f'{w}11')} FROM ({seen})"
    return f"SELECT *, {congruent(p, (f'{r}ra', f'{r}rb', f'{r}rb', f'{r}rd'), f'{k}00', f'{k}01', f'{k}11')} FROM ({powered})"


def transport_sql(source: str, old: tuple[str, str, str], to: tuple[str, str, str]) -> str:
    """A subquery of ``source`` with e00, e01, e10, e11, which moves the matrix ``old`` to ``to``."""
    seen = f"SELECT *, {congruent('k', ('mia', 'mib', 'mib', 'mid'), *to)} FROM (SELECT *, {roots('m', *old)} FROM ({source}))"
    return f"""SELECT *, mra * hra + mrb * hrb AS t00, mra * hrb + mrb * hrd AS t01, mrb * hra + mrd * hrb AS t10, mrb * hrb + mrd * hrd AS t11,
        t00 * mia + t01 * mib AS e00, t00 * mib + t01 * mid AS e01, t10 * mia + t11 * mib AS e10, t10 * mib + t11 * mid AS e11 FROM (SELECT *, {roots('h', 'k00', 'k01', 'k11')} FROM ({seen}))"""


def _distance_sql(x: tuple[str, str, str], y: str) -> str:
    t = f"(({x[2]} * {y}.a - 2 * {x[1]} * {y}.b + {x[0]} * {y}.d) / ({x[0]} * {x[2]} - {x[1]} * {x[1]}))"
    d = f"(({y}.a * {y}.d - {y}.b * {y}.b) / ({x[0]} * {x[2]} - {x[1]} * {x[1]}))"
    top = f"(({t} + sqrt(greatest(0, {t} * {t} - 4 * {d}))) / 2)"
    return f"sqrt(ln({top}) ** 2 + ln({d} / {top}) ** 2)"


def adapt_sql(cov: str, weight: str, seen: str, judged: str) -> str:
    """CTEs that end in ``votes``: for each subject models of the others, the walk of its mean and the general mean along ``seen`` (subject_id, i from 0, entries), and the nearest class of each row that is ``judged``."""
    return f"""{cov}, {means('cov', ['subject_id'], 'mean')}, {AS_ROWS},
    others AS MATERIALIZED (SELECT f.subject_id AS fold, as_rows.subject_id AS subject_id, s00, s01, s11, held FROM as_rows JOIN (SELECT subject_id FROM as_rows) f ON f.subject_id <> as_rows.subject_id),
    {means('others', ['fold'], 'apart', 'held')},
    learnt AS MATERIALIZED (SELECT * FROM cov WHERE {judged}), {means('learnt', ['subject_id', 'label'], 'own')},
    moves AS MATERIALIZED ({transport_sql('SELECT fold, subject_id, s00, s01, s11, apart.a AS ga, apart.b AS gb, apart.d AS gd FROM others JOIN apart USING (fold)', ('s00', 's01', 's11'), ('ga', 'gb', 'gd'))}),
    given AS MATERIALIZED (SELECT fold, label, n AS held, c00 AS s00, c01 AS s01, c11 AS s11 FROM (SELECT fold, label, n, {congruent('c', ('e00', 'e01', 'e10', 'e11'), 'a', 'b', 'd')} FROM moves JOIN own USING (subject_id))),
    {means('given', ['fold', 'label'], 'class', 'held')},
    seen AS MATERIALIZED ({seen}), cap AS (SELECT f.subject_id AS subject_id, floor(avg(o.n)) AS cap FROM mean f JOIN mean o ON f.subject_id <> o.subject_id GROUP BY f.subject_id),
    walk AS (SELECT fold AS subject_id, CAST(-1 AS BIGINT) AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d, 0.0::DOUBLE AS n, apart.a AS ga, apart.b AS gb, apart.d AS gd, CAST(apart.n AS DOUBLE) AS gn, cap FROM apart JOIN cap ON cap.subject_id = fold
        UNION ALL SELECT subject_id, place, CASE WHEN ok THEN z00 ELSE a END, CASE WHEN ok THEN z01 ELSE b END, CASE WHEN ok THEN z11 ELSE d END, CASE WHEN ok THEN n + w ELSE n END,
            CASE WHEN ok THEN y00 ELSE ga END, CASE WHEN ok THEN y01 ELSE gb END, CASE WHEN ok THEN y11 ELSE gd END, CASE WHEN ok THEN gn + w ELSE gn END, cap FROM (
            {geodesic_sql(geodesic_sql(f"SELECT walk.*, seen.i AS place, s00, s01, s11, {weight} AS w, n + {weight} <= cap AS ok FROM walk JOIN seen ON seen.subject_id = walk.subject_id AND seen.i = walk.i + 1", 'p', '(w / (n + w))', ('a', 'b', 'd'), 'z'), 'q', '(w / (gn + w))', ('ga', 'gb', 'gd'), 'y')})),
    placed AS ({transport_sql(f'SELECT walk.subject_id, walk.i, label, s00, s01, s11, a, b, d, ga, gb, gd FROM walk JOIN seen ON seen.subject_id = walk.subject_id AND seen.i = walk.i WHERE walk.n > 0 AND {judged}', ('a', 'b', 'd'), ('ga', 'gb', 'gd'))}),
    turned AS (SELECT subject_id, i, label, {congruent('c', ('e00', 'e01', 'e10', 'e11'), 's00', 's01', 's11')} FROM placed),
    far AS (SELECT turned.subject_id, i, turned.label AS true_label, {_distance_sql(('c00', 'c01', 'c11'), 'x')} AS d0, {_distance_sql(('c00', 'c01', 'c11'), 'y')} AS d1
        FROM turned JOIN class x ON x.fold = subject_id AND x.label = 0 JOIN class y ON y.fold = subject_id AND y.label = 1),
    votes AS (SELECT subject_id, i, true_label, CAST(d1 < d0 AS INTEGER) AS predicted_label, d0 / (d0 + d1) AS p FROM far)"""


LOSOCV = adapt_sql(COV, "1.0::DOUBLE", "SELECT * FROM cov", "true")


@register(f"{LOSOCV} SELECT subject_id, i, CAST(true_label AS INTEGER) AS label, predicted_label, round(p, 4) + 0.0 AS predicted_proba FROM votes")
def adapt_then_predict_2ch(spark, sf_dir):
    """Every row moves the held-out subject's mean and the general mean, and is then predicted."""
    return E.adapt_then_predict(staged2(spark, sf_dir), "nearest").withColumn("predicted_proba", F.round("predicted_proba", 4) + 0.0)


@register(
    f"""{LOSOCV}, cells AS (SELECT subject_id, {CELLS} FROM votes GROUP BY subject_id), metrics AS (SELECT subject_id, {RATES} FROM cells)
    SELECT round(min(f1), 6) AS min, round(max(f1), 6) AS max, round(quantile_cont(f1, 0.25), 6) AS q1, round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.75), 6) AS q3, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std FROM metrics"""
)
def losocv_summary_2ch(spark, sf_dir):
    metrics = rounded(E.losocv(staged2(spark, sf_dir), classifier="nearest")[0], *RATE_NAMES)
    return rounded(A.score_summary(metrics, "f1"), "min", "max", "q1", "median", "q3", "mean", "std")


_PART_COV = (
    COV.replace("sample[1:32] AS a, sample[33:64] AS b FROM epochs", "part, is_background, sample[part * 10 + 1 : part * 10 + 10] AS a, sample[33 + part * 10 : 42 + part * 10] AS b FROM epochs CROSS JOIN (SELECT unnest([0, 1, 2]) AS part)")
    .replace("SELECT vec_id, subject_id, event_id, label, list", "SELECT vec_id, part, is_background, subject_id, event_id, label, list")
    .replace("SELECT vec_id, subject_id, event_id, label, (1", "SELECT vec_id, part, is_background, subject_id, event_id, label, (1")
    .replace(" / 32", " / 10").replace("33 * (alpha", "11 * (alpha").replace("ORDER BY event_id, vec_id)", "ORDER BY event_id, vec_id, part)")
)
_BACKGROUND_FIRST = "SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY subject_id ORDER BY NOT is_background, i) - 1 AS i FROM cov"


@register(
    f"""{adapt_sql(_PART_COV, "(1.0::DOUBLE / 3)", _BACKGROUND_FIRST, "NOT is_background")}, cells AS (SELECT subject_id, {CELLS} FROM votes GROUP BY subject_id)
    SELECT subject_id, tp + tn + fp + fn AS num_samples, {RATES} FROM cells"""
)
def adaptation_eval_2ch(spark, sf_dir):
    """Windows in three parts, background parts first: metrics of the subjects."""
    return rounded(E.adaptation_eval(S.epochs(spark, sf_dir, 2), 2, True, classifier="nearest"), *RATE_NAMES)
