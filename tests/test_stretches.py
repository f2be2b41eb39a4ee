import random
import re

import pytest
from pyspark.sql import functions as F

from sigloom.operators import windows as W
from sigloom.operators.stretches import runs_along
from sigloom.queries import signal


def plain_runs(values):
    """(run, place) of each value, one after another."""
    out, run, place, before = [], 0, 0, object()
    for v in values:
        if v is None:
            out.append((None, None))
        else:
            run, place = (run, place + 1) if v == before else (run + 1, 0)
            out.append((run, place))
        before = v
    return out


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_runs_equal_one_pass(spark, stretch):
    """Runs within, across and along whole stretches; nulls at either side of their bounds; stretches without rows."""
    r = random.Random(stretch)
    data = []
    for key in range(4):
        values = [v for _ in range(25) for v in [r.choice(["a", "b", None])] * r.choice([1, 1, 2, 5, 20])]
        at = sorted(r.sample(range(4 * len(values)), len(values))) if key % 2 else range(len(values))
        data += [(key, i, v, *p) for i, v, p in zip(at, values, plain_runs(values), strict=True)]
    df = spark.createDataFrame(data, "key int, idx long, v string, wanted long, place long").repartition(3)
    found = runs_along(df, ["key"], "idx", F.col("v"), "run", "at", stretch).collect()
    assert len(found) == len(data) and all((x.run, x["at"]) == (x.wanted, x.place) for x in found)


def test_segments_and_windows_read_their_input_twice(spark, tmp_path):
    """The files of the rows are in the plan twice, however segments and windows follow one another."""
    path = str(tmp_path / "rows")
    spark.range(100).select(F.lit(1).alias("session_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("ts"), F.when(F.col("id") % 10 > 1, "g").alias("grp")).write.parquet(path)
    windows = W.sliding_windows(W.segments(spark.read.parquet(path), at="at"), 3, 2, at="at", collect={"where": "idx"})
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 2
    assert sorted(r["where"] for r in windows.collect())[:2] == [[2, 3, 4], [4, 5, 6]] and windows.count() == 30


def test_scans_of_the_query(spark, sf_dir):
    plan = signal.QUERIES["sliding_windows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) <= 8
