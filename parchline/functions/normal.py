"""Normal distribution as column expressions (Spark has neither erf nor a quantile)."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16, 1988),
# highest power first.
CENTRAL_NUM = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTRAL_DEN = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
MIDDLE_NUM = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
TAIL_DEN = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)
# Abramowitz and Stegun 7.1.26, highest power first.
ERF_SERIES = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
ERF_STEP = 0.3275911
# Fixed value: probabilities are kept this far from 0 and 1.
PROBABILITY_MARGIN = 1e-12


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(probability: Column) -> Column:
    """Standard normal quantile, exact to double precision (three rational pieces)."""
    p = F.greatest(F.lit(PROBABILITY_MARGIN), F.least(F.lit(1.0 - PROBABILITY_MARGIN), probability))
    q = p - F.lit(0.5)
    central = F.lit(0.180625) - q * q
    radius = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(F.lit(1.0) - p)))
    middle = radius - F.lit(1.6)
    far = radius - F.lit(5.0)
    tail = F.when(
        radius <= 5.0, horner(middle, MIDDLE_NUM) / horner(middle, MIDDLE_DEN)
    ).otherwise(horner(far, TAIL_NUM) / horner(far, TAIL_DEN))
    # greatest and least pass over nulls, so a missing probability is sorted out here.
    return F.when(probability.isNull(), F.lit(None).cast("double")).when(
        F.abs(q) <= 0.425, q * horner(central, CENTRAL_NUM) / horner(central, CENTRAL_DEN)
    ).otherwise(F.when(q < 0, -tail).otherwise(tail))


def with_normal_quantiles(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add quantiles (value) of probability columns (key).

    The same three pieces, but their common argument is a column of its own, so the
    plan stays small however often the polynomials mention it.
    """
    def clipped(p: str) -> Column:
        kept = F.greatest(F.lit(PROBABILITY_MARGIN), F.least(F.lit(1.0 - PROBABILITY_MARGIN), F.col(p)))
        return F.when(F.col(p).isNotNull(), kept)

    names = list(columns)
    staged = df.withColumns({f"_c_{p}": clipped(p) for p in names})
    staged = staged.withColumns(
        {
            f"_r_{p}": F.sqrt(-F.log(F.least(F.col(f"_c_{p}"), F.lit(1.0) - F.col(f"_c_{p}"))))
            for p in names
        }
    )

    def argument(p: str) -> Column:
        q, r = F.col(f"_c_{p}") - 0.5, F.col(f"_r_{p}")
        return F.when(F.abs(q) <= 0.425, F.lit(0.180625) - q * q).when(r <= 5.0, r - 1.6).otherwise(r - 5.0)

    staged = staged.withColumns({f"_x_{p}": argument(p) for p in names})

    def value(p: str) -> Column:
        q, r, x = F.col(f"_c_{p}") - 0.5, F.col(f"_r_{p}"), F.col(f"_x_{p}")
        central = q * horner(x, CENTRAL_NUM) / horner(x, CENTRAL_DEN)
        middle = horner(x, MIDDLE_NUM) / horner(x, MIDDLE_DEN)
        far = horner(x, TAIL_NUM) / horner(x, TAIL_DEN)
        return F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * F.when(r <= 5.0, middle).otherwise(far))

    return staged.withColumns({name: value(p) for p, name in columns.items()}).drop(
        *[f"_{part}_{p}" for part in "crx" for p in names]
    )


def erf(x: Column) -> Column:
    """Error function, absolute error below 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * ERF_STEP)
    magnitude = F.lit(1.0) - horner(t, ERF_SERIES) * t * F.exp(-x * x)
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def normal_cdf(x: Column) -> Column:
    return (erf(x / math.sqrt(2.0)) + 1.0) * 0.5
