"""Pure folds over append-only logs: attempts, backoff steps, chunk failures."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.scalars import backoff_ms, global_retry_delay
from docflow.schema import CHUNK_KEYS, REF_KEYS
from docflow.session import spread

MAX_RETRIES = 3
MAX_GLOBAL_RETRIES = 5

# Steps of one key that may share a window group. A longer key goes segment by
# segment; only one summary row per segment is then ordered per key.
SEGMENT_ROWS = 65536


def _running(group: list[str], order: list[str]):
    ordered = Window.partitionBy(*group).orderBy(*order)
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _preceding(group: list[str], order: str):
    return (
        Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )


def attempt_fold(
    attempts: DataFrame,
    keys: list[str] = REF_KEYS,
    order: list[str] | None = None,
    max_retries: int = MAX_RETRIES,
    carry: list[str] | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """Final or pending state of every ref from its attempts.

    ``order`` is a total order per ref (default ``seq``); rows that repeat an order value of
    their ref are ignored. ``before`` (keys, ``before``) gives the failures that refs had in
    earlier attempts; all of those must come before the rows given here.

    Two steps of aggregates, no order over all rows of a ref. First its summary: the
    first hard end (done, skipped, permanent), the places of the first ``max_retries``
    failures and the first ``max_retries`` transient ones. The ref is exhausted by its first
    transient failure at or behind the failure that spends the last retry, and at most
    ``max_retries - 1`` transient ones come before that. These picks are limited in the
    tasks before any shuffle. Then the failures up to the end are counted, with the few
    summary rows joined to the many failures. A ref that owns a third of the log is
    spread over many tasks in both.

    Result: keys, status, retry_count, error, and the ``carry`` columns of the
    row that decided the status.
    """
    order, carry = order or ["seq"], carry or []
    at = F.struct(*order)
    fails = F.col("outcome").isin("rate_limit", "transient")
    hard = F.col("outcome").isin("done", "skipped", "permanent")
    soft = F.col("outcome") == "transient"
    columns = list(dict.fromkeys([*keys, *order, "outcome", "message", *carry]))
    rows = attempts.select(*columns).dropDuplicates(list(dict.fromkeys([*keys, *order])))

    end = F.struct(at.alias("at"), "outcome", "message", *carry)
    kinds = [F.when(test, F.lit(kind)) for kind, test in (("hard", hard), ("soft", soft), ("fail", fails))]
    heads = rows.select(*keys, end.alias("end"), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    first = Window.partitionBy(*keys, "kind").orderBy("end.at")
    heads = heads.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= max_retries)

    def picked(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("end"))))

    # at most three times max_retries rows per ref from here on
    summary = heads.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "hard", F.col("end"))).alias("hard"),
        picked("fail").alias("fails"),
        picked("soft").alias("softs"),
    )
    if before is None:
        summary = summary.withColumn("before", F.lit(0).cast("long"))
    else:
        summary = summary.join(spread(before.select(*keys, "before")), keys, "left").fillna(0, ["before"])
    needed = F.greatest(F.lit(1).cast("long"), F.lit(max_retries) - F.col("before")).cast("int")
    last_retry = F.get("fails", needed - 1)["at"]
    spent = F.get(F.filter("softs", lambda s: s["at"] >= last_retry), F.lit(0))
    ends = summary.select(*keys, "before", F.least("hard", spent).alias("end"))

    failures = attempts.where(fails).select(*keys, at.alias("at")).distinct()
    counted = (
        failures.join(spread(ends.select(*keys, F.col("end.at").alias("end_at"))), keys)
        .where(F.col("end_at").isNull() | (F.col("at") <= F.col("end_at")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per ref on either side; an aggregate instead of an outer join of them
    final = (
        ends.withColumn("n", F.col("before"))
        .unionByName(counted, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("end").alias("end"), F.sum("n").alias("retry_count"))
    )
    outcome, message = F.col("end.outcome"), F.col("end.message")
    return final.select(
        *keys,
        F.when(F.col("end").isNull(), "pending")
        .when(outcome.isin("done", "skipped"), outcome)
        .otherwise("error")
        .alias("status"),
        "retry_count",
        F.when(outcome == "permanent", message)
        .when(
            outcome == "transient",
            F.concat(F.lit(f"Failed after {max_retries} retries: "), message),
        )
        .alias("error"),
        *[F.col(f"end.{c}").alias(c) for c in carry],
    )


def backoff_steps(attempts: DataFrame, keys: list[str] = CHUNK_KEYS) -> DataFrame:
    """Processing steps of an attempt log: one per chunk and round, rate-limited
    if any of its attempts was."""
    limited = F.bool_or(F.col("outcome") == "rate_limit").alias("rate_limited")
    return attempts.groupBy(*keys, F.col("seq").alias("step")).agg(limited)


def backoff_streaks(
    steps: DataFrame,
    keys: list[str] = CHUNK_KEYS,
    order: str = "step",
    jitter: Column | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rate-limit streak and delay after each processing step of a chunk.

    ``steps`` holds one row per step with a whole-number ``order``, unique per
    chunk, and the boolean ``rate_limited``. The streak is the distance to the
    last step without a rate limit; it is found inside segments of the order
    first, then carried over from the segment summaries.
    """
    group = [*keys, "_seg"]
    rows = steps.withColumn("_seg", F.floor(F.col(order) / segment_rows))
    ordered, upto = _running(group, [order])
    rows = rows.withColumn("_idx", F.row_number().over(ordered).cast("long")).withColumn(
        "_reset", F.max(F.when(~F.col("rate_limited"), F.col("_idx"))).over(upto)
    )

    parts = rows.groupBy(*group).agg(F.max("_idx").alias("_n"), F.max("_reset").alias("_last"))
    earlier = _preceding(keys, "_seg")
    parts = parts.withColumn(
        "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))
    )
    last_before = F.max(F.col("_start") + F.col("_last")).over(earlier)
    parts = parts.select(
        *group, (F.col("_start") - F.coalesce(last_before, F.lit(0).cast("long"))).alias("_carry")
    )

    streak = F.when(F.col("_reset").isNull(), F.col("_carry") + F.col("_idx")).otherwise(
        F.col("_idx") - F.col("_reset")
    )
    # null-safe keys: no filter is derived for one side only, so both branches
    # keep the same shuffle and Spark reuses it
    parts = parts.select(*[F.col(c).alias(f"_p{c}") for c in group], "_carry")
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in group])
    return (
        rows.join(parts, match)
        .withColumn("streak", streak)
        .withColumn("delay_ms", backoff_ms(F.col("streak"), jitter))
        .drop(*[f"_p{c}" for c in group], "_seg", "_idx", "_reset", "_carry")
    )


def current_streak(
    steps: DataFrame, keys: list[str] = CHUNK_KEYS, order: str = "step"
) -> DataFrame:
    """Per key the rate-limited steps since its last other one (keys, ``streak``).

    The last row of ``backoff_streaks``, from two aggregates and without any order over rows.
    """
    last = steps.groupBy(*keys).agg(F.max(F.when(~F.col("rate_limited"), F.col(order))).alias("_ok"))
    after = F.col("_ok").isNull() | (F.col(order) > F.col("_ok"))
    joined = steps.select(*keys, order).join(spread(last), keys)
    return joined.groupBy(*keys).agg(F.count_if(after).alias("streak"))


def chunk_fail_fold(
    failures: DataFrame,
    keys: list[str] = CHUNK_KEYS,
    order: list[str] | None = None,
    max_retries: int = MAX_GLOBAL_RETRIES,
) -> DataFrame:
    """Chunk-level failures: retry with a delay, or ERROR at the limit.

    Only the first ``max_retries`` failures of a chunk matter, so the ranking is
    a top-k that Spark already limits before the shuffle.
    """
    order = order or ["seq"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = failures.withColumn("_rank", rank).where(F.col("_rank") <= max_retries)
    folded = first.groupBy(*keys).agg(
        F.max("_rank").cast("long").alias("global_retry_count"),
        F.max(F.when(F.col("_rank") == max_retries, F.col("message"))).alias("global_error"),
    )
    exhausted = F.col("global_retry_count") >= max_retries
    return folded.select(
        *keys,
        F.when(exhausted, "ERROR").alias("phase"),
        "global_error",
        "global_retry_count",
        F.when(~exhausted, global_retry_delay(F.col("global_retry_count"))).alias("retry_delay_ms"),
    )
