"""Token counts and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price in dollars per million tokens.
INPUT_PRICE = "0.03"
OUTPUT_PRICE = "0.14"


def _priced(tokens: Column, price: str) -> Column:
    per_token = F.lit(price).cast("decimal(4,2)") / F.lit(1000000).cast("decimal(7,0)")
    return tokens.cast("decimal(20,0)") * per_token.cast("decimal(12,8)")


def cost_usd(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Exact decimal cost of given token counts."""
    cost = _priced(prompt_tokens, INPUT_PRICE) + _priced(completion_tokens, OUTPUT_PRICE)
    return cost.cast("decimal(28,8)")


def cost_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and cost per key. Tokens are summed first, in the map tasks, and
    priced once per group."""
    totals = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    return totals.withColumn(
        "cost_usd", cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"))
    )
