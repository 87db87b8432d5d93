"""Statistics of experiments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Student's t at 97.5 % and 95 % for 1 to 10 degrees of freedom.
T975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)
T95 = (6.314, 2.920, 2.353, 2.132, 2.015, 1.943, 1.895, 1.860, 1.833, 1.812)


def student(df: Column, table: tuple[float, ...], beyond: float) -> Column:
    return F.when((df >= 1) & (df <= len(table)), F.element_at(F.array(*[F.lit(t) for t in table]), df.cast("int"))).otherwise(F.lit(beyond))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - prod (n - c - i) / (n - i) for i < k; 1 where fewer than k fail."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def sign_test(gained: Column, lost: Column) -> Column:
    """Exact two-sided p of the smaller count under fair coins; 1 without trials."""
    n, k = gained + lost, F.least(gained, lost)
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.pow(F.lit(0.5), n.cast("double")).alias("total"))
    step = lambda s, i: F.struct((s["term"] * (n - i + 1) / i).alias("term"), (s["total"] + s["term"] * (n - i + 1) / i).alias("total"))
    total = F.aggregate(F.filter(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), lambda i: i > 0), start, step, lambda s: s["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))
