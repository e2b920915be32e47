"""Exactly rounded means that don't depend on the order or the partitions of what is added up.

A finite double is a whole number of 53 bits times a power of two.  Its exponent is cut in two: the lower five bits
shift the whole number, the upper ones name a bin, and numbers of one bin are added up as decimals without rounding.
Bins of one group (at most 64) make up its exact sum; one division at the end rounds once, as ``statistics.mean`` does.
Sums of one bin hold at least 10**11 numbers; beyond that they are an error, never a wrong sum.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Powers of two in one bin, as bits.
_SHIFT = 5
#: The least power of two of a double, by the exponent 0 that its bits have.
_LEAST = 1075
UNITS = "decimal(37,0)"


def split(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``bin`` and ``units`` of a column of doubles; both are null where it isn't a finite number."""
    number = F.col(value)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    bits = F.when(finite, F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number)).cast("long")
    exponent = F.shiftrightunsigned("bits", 52).bitwiseAND(2047)
    fraction = F.col("bits").bitwiseAND((1 << 52) - 1)
    whole = F.when(exponent == 0, fraction).otherwise(fraction + (1 << 52))
    power = F.greatest(exponent, F.lit(1))
    shift = F.pow(F.lit(2.0), power.bitwiseAND((1 << _SHIFT) - 1)).cast("decimal(10,0)")
    units = whole.cast("decimal(16,0)") * shift
    signed = F.when(F.col("bits") < 0, -units).otherwise(units).cast("decimal(27,0)")
    return rows.withColumn("bits", bits).withColumns({"bin": F.when(F.col("bits").isNotNull(), F.shiftright(power, _SHIFT).cast("int")), "units": signed}).drop("bits")


def infinite_of(value: Column, sign: int) -> Column:
    return F.count_if(value == F.lit(float("inf") * sign))


@F.pandas_udf(T.DoubleType())
def _divided(bins: pd.Series, units: pd.Series, n: pd.Series) -> pd.Series:
    """The mean of n finite numbers from the units (as text) of their bins; one row a group."""
    total = lambda bins, units: sum(int(u) << (int(b) << _SHIFT) for b, u in zip(bins, units, strict=True))
    return pd.Series([total(b, u) / (int(k) << _LEAST) if k else None for b, u, k in zip(bins, units, n, strict=True)], dtype="float64")


def mean(bins: str, units: str, n: str, up: str, down: str) -> Column:
    """The mean of n numbers from the bins of the finite ones and from how many are infinite; null of none."""
    infinite = lambda c: F.col(c) > 0
    whole = F.when(infinite(up) & infinite(down), float("nan")).when(infinite(up), float("inf")).when(infinite(down), float("-inf"))
    return whole.otherwise(_divided(bins, units, n))


def collected(bin_col: str = "bin", units_col: str = "units") -> tuple[Column, Column]:
    """A group's bins and their units, for ``mean``; a group has each bin once."""
    pairs = F.collect_list(F.when(F.col(bin_col).isNotNull(), F.struct(bin_col, F.col(units_col).cast("string").alias("u"))))
    return F.transform(pairs, lambda p: p[bin_col]), F.transform(pairs, lambda p: p["u"])


def means(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name): the mean of the group's numbers, null if it has none; nulls and NaN don't count."""
    known = split(rows.select(*keys, F.when(~F.isnan(value), value).cast("double").alias("value")), "value")
    v = F.col("value")
    binned = known.groupBy(*keys, "bin").agg(F.sum("units").cast(UNITS).alias("units"), F.count("value").alias("n"), infinite_of(v, 1).alias("up"), infinite_of(v, -1).alias("down"))
    bins, units = collected()
    whole = binned.groupBy(*keys).agg(bins.alias("bins"), units.alias("units"), *[F.sum(c).alias(c) for c in ("n", "up", "down")])
    return whole.select(*keys, mean("bins", "units", "n", "up", "down").alias(name))
