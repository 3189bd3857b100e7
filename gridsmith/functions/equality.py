"""Equality of two answer cells, each given as a (num, str) pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V


def values_equal(a_num: Column, a_str: Column, b_num: Column, b_str: Column,
                 abs_tol: float = V.ABS_TOLERANCE, rel_tol: float = V.REL_TOLERANCE) -> Column:
    """NULL equals NULL, numbers agree within tolerance, NaN equals nothing, text is exact."""
    a_null = a_num.isNull() & a_str.isNull()
    b_null = b_num.isNull() & b_str.isNull()
    both_numbers = a_num.isNotNull() & b_num.isNotNull()
    infinite = F.abs(a_num).eqNullSafe(F.lit(float("inf"))) | F.abs(b_num).eqNullSafe(F.lit(float("inf")))
    slack = F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a_num), F.abs(b_num)), F.lit(abs_tol))
    return (
        F.when(a_null | b_null, a_null & b_null)
        .when(both_numbers & (F.isnan(a_num) | F.isnan(b_num)), F.lit(False))
        .when(both_numbers & infinite, a_num == b_num)
        .when(both_numbers, F.abs(a_num - b_num) <= slack)
        .otherwise(F.coalesce(a_str == b_str, F.lit(False)))
    )
