import inspect

import pytest
from pyspark.sql import functions as F

from sigloom.operators import projections as P
from sigloom.plans import evaluate as E
from sigloom.queries import matrices


@pytest.mark.parametrize("operator, name, size", [(E.permutation_test, "n", 9999), (E.pair_distance_vs_score, "permutations_", 9999), (E.rf_classify_loso, "trees", 100), (E.score_regression_cv, "trees", 100)])
def test_defaults_are_the_references(operator, name, size):
    assert inspect.signature(operator).parameters[name].default == size


@pytest.mark.parametrize("query", ["permutation_by_user", "pair_distance_vs_score", "rf_classify_loso", "score_regression"])
def test_queries_leave_the_sizes_to_the_operators(query):
    source = inspect.getsource(matrices.QUERIES[query])
    assert "trees=" not in source and "999" not in source


def test_three_stars_are_within_reach(spark):
    rows = [(1, float(k), float(k * k)) for k in range(30)]
    found = E.permutation_test(spark.createDataFrame(rows, "g int, x double, y double"), "g", "x", "y").withColumn("stars", P.significance_stars(F.col("p"))).first()
    assert (found.p, found.stars) == (2 / 10_000, "***")
