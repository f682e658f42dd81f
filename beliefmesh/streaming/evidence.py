"""Evidence that arrives as events: a claim's odds are multiplied by each observation's likelihood ratio.

`posteriors` is one aggregation of logarithms, partial on the map side, so it runs on a table and, with Structured
Streaming, on a stream: with a watermark, as sums by window that are final when the watermark has passed, or as running
sums without one. Observations are independent given their claim, as an observes relation each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posteriors(observations: DataFrame, keys: list[str], prior: str = "0.5D", window: str | None = None, watermark: str | None = None) -> DataFrame:
    """keys, n, posterior, error of observations(keys, passed, sensitivity, false_pass, and `at` for windows). prior: SQL of the
    claim's base. window: such as '1 hour', of evidence that counts together; watermark: how late an observation may be.

    A null outcome is no observation. A rate of exactly 0 or 1 makes a value impossible: `zero-probability` if both are."""
    seen = observations.where("passed is not null and sensitivity is not null and false_pass is not null")
    if watermark is not None:
        seen = seen.withWatermark("at", watermark)
    by = [F.col(k) for k in keys] + ([F.window("at", window).alias("window")] if window else [])
    if_true = F.when(F.col("passed"), F.col("sensitivity")).otherwise(1 - F.col("sensitivity"))
    if_false = F.when(F.col("passed"), F.col("false_pass")).otherwise(1 - F.col("false_pass"))
    # impossible under one value: counted apart, as its logarithm is infinite
    ratio = F.when((if_true > 0) & (if_false > 0), F.log(if_true) - F.log(if_false)).otherwise(F.lit(0.0))
    sums = seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ratio).alias("r"), F.sum((if_true <= 0).cast("long")).alias("not_true"), F.sum((if_false <= 0).cast("long")).alias("not_false"),
    )
    p = F.expr(prior)
    odds = F.exp(-F.col("r")) * (1 - p) / p
    no_true, no_false = (F.col("not_true") > 0) | (p <= 0), (F.col("not_false") > 0) | (p >= 1)
    posterior = F.when(no_true & no_false, F.lit(None).cast("double")).when(no_true, F.lit(0.0)).when(no_false, F.lit(1.0)).otherwise(1 / (1 + odds))
    error = F.when(no_true & no_false, F.lit("zero-probability"))
    return sums.select(*keys, *(["window"] if window else []), "n", posterior.alias("posterior"), error.alias("error"))
