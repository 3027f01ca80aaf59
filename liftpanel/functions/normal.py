"""Normal distribution as column expressions, so that it stays in generated JVM code."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abramowitz & Stegun (1964), formula 26.2.17, absolute error below 7.5e-8.
TAIL_P = 0.2316419
TAIL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# Wichura (1988), algorithm AS 241, PPND16.
CENTRE_A = (
    3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_B = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
TAIL_C = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
TAIL_D = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
FAR_E = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
FAR_F = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def _poly(coefficients, x: Column) -> Column:
    """Horner evaluation, lowest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = F.try_divide(x - mean, sd)
    return F.try_divide(F.exp(-z * z / 2), sd * math.sqrt(2 * math.pi))


def normal_tail(z: Column) -> Column:
    """P(Z > |z|): the smaller of the two tails."""
    a = F.abs(z)
    t = 1 / (1 + TAIL_P * a)
    return F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * _poly(TAIL_B, t)


def with_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add ``out``, the inverse of the normal distribution function at column ``p`` (0 < p < 1).

    The arguments of the polynomials become columns of their own first: written in place they would
    be repeated in every term of the generated code.
    """
    q, r, w = F.col("_q"), F.col("_r"), F.col("_w")
    near, far = F.col("_near"), F.col("_far")
    tail = F.when(w <= 5.0, _poly(TAIL_C, near) / _poly(TAIL_D, near)).otherwise(_poly(FAR_E, far) / _poly(FAR_F, far))
    centre = q * _poly(CENTRE_A, r) / _poly(CENTRE_B, r)
    return (
        df.withColumn("_q", F.col(p) - 0.5)
        .withColumn("_w", F.sqrt(-F.ln(F.least(F.col(p), 1 - F.col(p)))))
        .withColumns({"_r": 0.180625 - q * q, "_near": w - 1.6, "_far": w - 5.0})
        .withColumn("_tail", tail)
        .withColumn(out, F.when(F.abs(q) <= 0.425, centre).when(q < 0, -F.col("_tail")).otherwise(F.col("_tail")))
        .drop("_q", "_w", "_r", "_near", "_far", "_tail")
    )


def two_sided_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)
