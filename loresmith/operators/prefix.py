"""Running totals over a long order, worked out part by part, so that no key's whole history stands in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], part: Column | None = None, inclusive: bool = True) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over the rows of the same keys up to this one (or, not ``inclusive``, before it).

    ``part`` must not fall as ``order`` rises (a day of a time, say).  Each part
    is summed alone and the totals of the parts before it, one row for each key
    and part, are added; without a part a key's rows are one window.  A null
    value counts as nothing.
    """
    last = 0 if inclusive else -1
    values = {name: F.coalesce(value, F.lit(0)) for name, value in sums.items()}
    by = [*keys, *(["__part"] if part is not None else [])]
    held = rows.withColumns({f"__{name}": value for name, value in values.items()})
    if part is not None:
        held = held.withColumn("__part", part)
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    out = held.withColumns({name: F.coalesce(F.sum(f"__{name}").over(window), F.lit(0)) for name in sums})
    if part is not None:
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        totals = held.groupBy(*by).agg(*(F.sum(f"__{name}").alias(f"__{name}") for name in sums))
        before = totals.select(*by, *(F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums))
        out = out.alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]).select("r.*", *(f"b.__before_{name}" for name in sums))
        out = out.withColumns({name: F.col(name) + F.col(f"__before_{name}") for name in sums})
    return out.select(*rows.columns, *sums)
