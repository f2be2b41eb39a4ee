"""Chains of steps: each fits model tables on rows and applies them to rows, lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass
class Step:
    """``fit`` turns rows into model tables (None: stateless); ``apply`` turns rows and tables into rows; ``update`` refits on new rows."""

    name: str
    apply: Callable[[DataFrame, Tables], DataFrame]
    fit: Callable[[DataFrame], Tables] | None = None
    update: Callable[[DataFrame, Tables], Tables] | None = None
    calibration: bool = False
    tables: Tables = field(default_factory=dict)

    @property
    def ready(self) -> bool:
        return self.fit is None or bool(self.tables)


def run_pipeline(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Calibration steps first, then the others; each is fitted on what the ones before give, and applied."""
    ordered = [s for s in steps if s.calibration] + [s for s in steps if not s.calibration]
    for step in ordered:
        if not step.ready:
            step.tables = step.fit(df)
        df = step.apply(df, step.tables)
    return df


def fit_next(df: DataFrame, steps: list[Step]) -> str | None:
    """Fit the first step that is not fitted, on rows passed through those before it; its name, or None."""
    for step in steps:
        if not step.ready:
            step.tables = step.fit(df)
            return step.name
        df = step.apply(df, step.tables)
    return None


def partial_fit(df: DataFrame, steps: list[Step]) -> None:
    """Let every step that can be updated take in new rows."""
    for step in steps:
        if step.update is not None and step.tables:
            step.tables = step.update(df, step.tables)
        df = step.apply(df, step.tables)


def transform(df: DataFrame, steps: list[Step]) -> DataFrame:
    if missing := [s.name for s in steps if not s.ready]:
        raise ValueError(f"not fitted: {', '.join(missing)}")
    return reduce(lambda rows, s: s.apply(rows, s.tables), steps, df)


def concat_named(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All parts below each other, with the part's key in the column ``name``."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias(name), *df.columns) for k, df in parts.items()])
