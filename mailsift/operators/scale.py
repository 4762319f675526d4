"""Standard scaling of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaling:
    """Mean and divisor per column, as fitted on one set of rows."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    divisors: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns in place; other columns are kept."""
        scaled = {
            c: (F.col(c).cast("double") - F.lit(m)) / F.lit(d)
            for c, m, d in zip(self.columns, self.means, self.divisors)
        }
        return df.withColumns(scaled)


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """Mean and population deviation of each column in one aggregate. A constant column is divided by 1."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        aggs += [F.avg(value).alias(f"m{i}"), F.var_pop(value).alias(f"v{i}")]
    row = df.agg(*aggs).first()
    eps = 2.220446049250313e-16
    means, divisors = [], []
    for i in range(len(columns)):
        mean, var = row[f"m{i}"] or 0.0, row[f"v{i}"] or 0.0
        # a variance that rounding alone can produce counts as zero
        noise = row["n"] * eps * var + (row["n"] * mean * eps) ** 2
        means.append(mean)
        divisors.append(var**0.5 if var > noise else 1.0)
    return Scaling(tuple(columns), tuple(means), tuple(divisors))
