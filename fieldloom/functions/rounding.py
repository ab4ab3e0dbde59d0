"""Rounding by the exact value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.rows import let


def exact_round(value: Column, digits: int) -> Column:
    """Round to the nearest, judged by the double itself: 2.675 lies below the tie and gives 2.67; a true tie goes to the even digit.

    Only values whose shortest decimal form is a tie differ from ``round``. Those are compared as whole numbers: the
    mantissa with the tie, both scaled. Of values with more than 17 digits up to the last place the tie goes up.
    """
    size, steps = F.abs(value), 10 ** (digits + 1)
    near = F.rint(size * float(steps))
    suspect = (F.abs(size * float(steps) - near) <= near * 1e-12) & (near % 10 == 5) & (near < 1e17)

    def decided(parts: Column) -> Column:
        mantissa, tie = parts["x"] * F.lit(steps).cast("decimal(8,0)"), parts["t"] * parts["p"] * parts["q"]
        even = F.pmod(parts["t"] - 5, F.lit(20)) == 0
        down = (mantissa < tie) | ((mantissa == tie) & even)
        whole = F.when(down, parts["t"] - 5).otherwise(parts["t"] + 5)
        return F.signum(value) * (whole / 10).cast("double") / F.lit(float(10**digits))

    shift = F.greatest(F.lit(53) - F.floor(F.log2(size)), F.lit(0))
    first = F.least(shift, F.lit(40))
    parts = F.struct(
        (size * F.pow(F.lit(2.0), shift)).cast("bigint").cast("decimal(19,0)").alias("x"),
        near.cast("bigint").cast("decimal(17,0)").alias("t"),
        # in two factors, each of which a double and its decimal form hold exactly
        F.pow(F.lit(2.0), first).cast("decimal(13,0)").alias("p"),
        F.pow(F.lit(2.0), shift - first).cast("decimal(16,0)").alias("q"),
    )
    return F.when(suspect, let(parts, decided)).otherwise(F.round(value, digits))
