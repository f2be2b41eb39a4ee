import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import filters, signal_ops
from sigloom.operators import projections as P
from sigloom.queries import signal


@pytest.mark.parametrize("start", ["zero", "unit_step"])
def test_filters_are_one_pass_to_the_last_bit(spark, start):
    """A digit that a sum in another order changes is a difference once a value lies at the border of rounding."""
    random, designs = np.random.default_rng(5), [filters.butter_bandpass(4, 8, 100.0), filters.butter_bandpass(13, 30, 100.0)]
    sessions = {s: random.normal(0, 50, (2, n)) for s, n in (("a", 50), ("b", 37), ("c", 16), ("d", 5))}
    rows = [(s, i, [float(v) for v in x[:, i]]) for s, x in sessions.items() for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, "session_id string, idx long, x array<double>").repartition(3)
    out = signal_ops.from_chunks(signal_ops.run_filters(signal_ops.to_chunks(df, 8), designs, start), 8).collect()
    for s, x in sessions.items():
        first = [None if start == "zero" else np.repeat(filters.unit_step_state(d)[..., None], 2, 2) for d in designs]
        whole = np.concatenate([filters.sosfilt(d, x, z)[0] for d, z in zip(designs, first, strict=True)])
        found = np.array([r.x for r in sorted((r for r in out if r.session_id == s), key=lambda r: r.idx)]).T
        assert np.array_equal(found, whole)


def test_rounding_keeps_the_sign_of_a_zero(spark):
    given = [-3e-7, 3e-7, -0.0, 0.0, 2.5e-6, -2.5e-6, 0.0000005, 0.4999999999999999e-6, 12345.1234565, -7.25, 1e300]
    out = [r.v for r in spark.createDataFrame([(v,) for v in given], "x double").select(P.round_half_away(F.col("x"), 6).alias("v")).collect()]
    want = [math.copysign(math.floor(abs(v) * 1e6) + (abs(v) * 1e6 - math.floor(abs(v) * 1e6) >= 0.5), v) / 1e6 if abs(v) < 1e9 else v for v in given]
    assert [repr(v) for v in out] == [repr(v) for v in want]
    assert repr(out[0]) == "-0.0"


def test_small_negative_differences_are_negative_zeros(spark, tmp_path):
    rows = [(v, 1, [0.25, 0.5] if v < 20 else [0.25 - 3e-8, 0.5]) for v in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = signal.difference_vector(spark, str(tmp_path)).collect()
    assert len(out) == 20 and all(repr(r.difference) == "[-0.0, 0.0]" for r in out)
