"""Row numbers, running sums and earlier rows along a key, without one task that sorts the whole key.

A key's rows are cut into stretches of a numeric order. Each is worked out by itself, and what it needs of those before it
comes from one small row a stretch. A window over (key, stretch) and the join with those rows share one partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def _cut(df: DataFrame, order: str, stretch: float) -> DataFrame:
    return df.withColumn("__stretch", F.floor(F.col(order) / stretch).cast("long"))


def _joined(cut: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "__stretch"]
    renamed = carried.withColumnsRenamed({n: f"__of_{n}" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in keys], F.col("__stretch").eqNullSafe(F.col("__of___stretch")))
    return cut.join(renamed, same).drop(*[f"__of_{n}" for n in names])


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], stretch: float = STRETCH, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add, by name, the sums (long) of ``values`` over the key's rows up to this one by ``order``; ``ties`` order rows of the same ``order``."""
    of = {name: f"__of_row_{k}" for k, name in enumerate(values)}
    cut = _cut(df, order, stretch).withColumns({of[n]: v.cast("long") for n, v in values.items()})
    sums = cut.groupBy(*keys, "__stretch").agg(*[F.sum(c).alias(c) for c in of.values()])
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in of.values()])
    within = Window.partitionBy(*keys, "__stretch").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = {n: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in of.items()}
    return _joined(cut, carried, keys).withColumns(summed).drop("__stretch", *of.values(), *[f"{c}_before" for c in of.values()])


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, stretch: float = STRETCH, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: one of ``running_sums``."""
    return running_sums(df, keys, order, {name: value}, stretch, ties)


def row_numbers(df: DataFrame, keys: list[str], order: str, name: str, stretch: float = STRETCH, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: gapless numbers from 0 along the key."""
    return running_sum(df, keys, order, F.lit(1), name, stretch, ties).withColumn(name, F.col(name) - 1)


def previous(df: DataFrame, keys: list[str], order: str, value: Column, name: str, stretch: float = STRETCH) -> DataFrame:
    """Add ``name``, a struct with ``value`` (``v``) of the key's row before this one; null for the first row."""
    cut = _cut(df, order, stretch).withColumn("__of_row", F.struct(value.alias("v")))
    last = cut.groupBy(*keys, "__stretch").agg(F.max_by("__of_row", order).alias("__last"))
    carried = last.select(*keys, "__stretch", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__stretch")).alias("__carried_row"))
    within = Window.partitionBy(*keys, "__stretch").orderBy(order)
    return _joined(cut, carried, keys).withColumn(name, F.coalesce(F.lag("__of_row").over(within), "__carried_row")).drop("__of_row", "__carried_row", "__stretch")


def runs_along(df: DataFrame, keys: list[str], order: str, value: Column, number: str, at: str, stretch: float = STRETCH) -> DataFrame:
    """Add ``number`` (from 1, along the key) and ``at`` (from 0 within it) of each row's run of equal ``value``; null is no run, and ends one.

    The input is read twice: once, narrow, for a row a stretch with what later ones need (how many runs begin in it, its first and last
    value, how long its last run is), and once for the rows, which one window per stretch numbers.
    """
    cut = _cut(df, order, stretch).withColumn("__run_value", F.struct(value.alias("v")))
    within = Window.partitionBy(*keys, "__stretch").orderBy(order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has, rn, before = F.col("__run_value.v").isNotNull(), F.row_number().over(within), F.lag("__run_value").over(within)
    # A stretch's first row begins a run or not by the stretch before.
    begins = has & (F.col("__run_rn") > 1) & ~F.col("__run_value.v").eqNullSafe(F.col("__run_before.v"))
    marked = lambda rows: rows.withColumns({"__run_rn": rn, "__run_before": before}).withColumn("__run_begins", begins)
    narrow = marked(cut.select(*keys, "__stretch", order, "__run_value"))
    sums = narrow.groupBy(*keys, "__stretch").agg(
        F.count("*").alias("rows"), F.min_by("__run_value", "__run_rn").alias("first"), F.max_by("__run_value", "__run_rn").alias("last"), F.count_if("__run_begins").alias("begun"), F.max(F.when(F.col("__run_begins"), F.col("__run_rn"))).alias("last_at")
    )
    along = Window.partitionBy(*keys).orderBy("__stretch")
    earlier, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = sums.withColumn("opens", F.col("first.v").isNotNull() & ~F.col("first.v").eqNullSafe(F.lag("last").over(along)["v"]))
    told = told.withColumns({"upto": F.sum("rows").over(upto), "all": F.col("begun") + F.col("opens").cast("int")})
    # How long the run at a stretch's end is: since the last run began, in this stretch or an earlier one.
    open_at = F.when(F.col("begun") > 0, F.col("rows") - F.col("last_at") + 1).when(F.col("opens"), F.col("rows")) - F.col("upto")
    told = told.withColumn("open", F.col("upto") + F.last(open_at, ignorenulls=True).over(upto))
    carried = told.select(*keys, "__stretch", F.struct(F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("runs"), "opens", F.coalesce(F.lag("open").over(along), F.lit(0)).alias("open")).alias("__run_carried"))
    rows = _joined(marked(cut), carried, keys)
    latest = F.max(F.when(F.col("__run_begins"), F.col("__run_rn"))).over(so_far)
    rows = rows.withColumns({"__run_local": F.sum(F.col("__run_begins").cast("int")).over(so_far), "__run_latest": latest})
    c = F.col("__run_carried")
    runs = c["runs"] + c["opens"].cast("long") + F.col("__run_local")
    place = F.when(F.col("__run_latest").isNotNull(), F.col("__run_rn") - F.col("__run_latest")).when(c["opens"], F.col("__run_rn") - 1).otherwise(c["open"] + F.col("__run_rn") - 1)
    out = rows.withColumns({number: F.when(has, runs), at: F.when(has, place.cast("long"))})
    return out.drop("__stretch", *[f"__run_{c}" for c in ("value", "rn", "before", "begins", "carried", "local", "latest")])
