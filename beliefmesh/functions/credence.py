"""Credences: points and Beta distributions, their moments, text forms and information measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_mean(a: Column, b: Column) -> Column:
    """a / (a + b); both are halved where the sum overflows."""
    return F.when(a + b == float("inf"), (a / 2) / (a / 2 + b / 2)).otherwise(a / (a + b))


def beta_variance(a: Column, b: Column) -> Column:
    m = beta_mean(a, b)
    return m * (1 - m) / (a + b + 1)


def from_mean_concentration(mean: Column, concentration: Column) -> Column:
    """Struct (alpha, beta) of that mean and that sum; null outside 0 < mean < 1 and for a sum that isn't positive."""
    return F.when((mean > 0) & (mean < 1) & (concentration > 0) & (concentration < float("inf")), F.struct((mean * concentration).alias("alpha"), ((1 - mean) * concentration).alias("beta")))


def from_mean_sd(mean: Column, sd: Column) -> Column:
    """Struct (alpha, beta), null where sd^2 >= mean (1 - mean)."""
    k = mean * (1 - mean) / (sd * sd) - 1
    return F.when((sd > 0) & (k > 0), F.struct((mean * k).alias("alpha"), ((1 - mean) * k).alias("beta")))


def parse_credence(text: Column) -> Column:
    """`0.3` or `beta:8,2` as struct (p, alpha, beta); null if neither or out of range."""
    p = F.trim(text).try_cast("double")
    a, b = (F.regexp_extract(text, r"(?i)^\s*beta:\s*([^,]+),\s*([^,]+)\s*$", i).try_cast("double") for i in (1, 2))
    null = F.lit(None).cast("double")
    point = F.struct(p.alias("p"), null.alias("alpha"), null.alias("beta"))
    return F.when((p >= 0) & (p <= 1), point).when((a > 0) & (b > 0) & (a < float("inf")) & (b < float("inf")), F.struct(null.alias("p"), a.alias("alpha"), b.alias("beta")))


def format_credence(c: Column) -> Column:
    """`0.3` or `beta:8,2`, whole numbers without a fraction; the inverse of parse_credence."""
    number = lambda x: F.when(x == F.floor(x), F.when(F.abs(x) < 1e15, x.cast("long").cast("string")).otherwise(x.cast("string"))).otherwise(x.cast("string"))
    return F.when(c["p"].isNotNull(), number(c["p"])).when(c["alpha"].isNotNull(), F.concat(F.lit("beta:"), number(c["alpha"]), F.lit(","), number(c["beta"])))


def logit_gap(p: Column, q: Column) -> Column:
    """ln odds p - ln odds q; 0 within 1e-12, infinite where only one side is certain."""
    return F.when(F.abs(p - q) <= 1e-12, F.lit(0.0)).when((p >= 1) | (q <= 0), F.lit(float("inf"))).when((p <= 0) | (q >= 1), F.lit(float("-inf"))).otherwise(F.log(p / (1 - p)) - F.log(q / (1 - q)))


def mutual_information(t1: Column, t0: Column, y: Column) -> Column:
    """Bits between a target and a variable of probability y, the target's being t1 or t0 given it; at least 0."""
    t = y * t1 + (1 - y) * t0
    part = lambda w, p, q: F.when((w > 0) & (p > 0), w * p * F.log2(p / q)).otherwise(F.lit(0.0))
    total = part(y, t1, t) + part(y, 1 - t1, 1 - t) + part(1 - y, t0, t) + part(1 - y, 1 - t0, 1 - t)
    return F.greatest(F.lit(0.0), total)
