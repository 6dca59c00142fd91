"""Rounds of extraction over an append-only attempt log."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import count
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docflow.functions.jsondoc import field_text, has_value, merge_ocr, parse_doc
from docflow.functions.scalars import (
    BASE_DELAY_MS,
    JITTER_SHARE,
    MAX_DELAY_MS,
    MAX_EXPONENT,
    utf16_length,
)
from docflow.functions.urls import url_variants
from docflow.operators.contents import content_id
from docflow.operators.cost import cost_rollup
from docflow.operators.fold import MAX_RETRIES
from docflow.plans.extract import Model, extract_once
from docflow.schema import ATTEMPTS, CHUNK_KEYS, REF_KEYS
from docflow.session import is_done, once, set_done, spread


#: Slices in flight when the policy leaves the concurrency to the session.
SLICES_AT_ONCE = 4


@dataclass(frozen=True)
class Policy:
    """Limits of the loop.

    ``max_rounds``: rounds after which this call stops; what is still pending
    then stays pending, and a later call goes on. ``concurrency``: tasks that call
    the model at once (default: the session's parallelism), each with ``threads``
    calls in flight. ``pause`` receives the seconds to wait after a round with rate
    limits; None goes on at once. ``model_key`` names the model: a worker keeps it
    loaded over tasks and rounds. ``slice_refs``: a round of more refs runs in slices of about
    so many, each kept when it has ended.
    """

    cdn_host: str
    max_retries: int = MAX_RETRIES
    max_rounds: int | None = None
    concurrency: int | None = None
    threads: int = 4
    call_size: int = 16
    pause: Callable[[float], None] | None = time.sleep
    model_key: str | None = None
    slice_refs: int = 100_000

    def __post_init__(self):
        if self.slice_refs < 1:
            raise ValueError("slice_refs must be at least 1")
        if self.max_rounds is not None and self.max_rounds < 1:
            raise ValueError("max_rounds must be at least 1")


class Rounds(NamedTuple):
    """The last round that ran, and whether no ref is pending any more."""

    number: int
    finished: bool


#: A ref's keys, the most varied first: sorts compare few rows beyond the first key then.
_BY_REF = ["pi", "filename", "chunk_id", "batch_id"]

#: What a round keeps besides the log's columns, so that the next one follows from it.
_ADDRESSES = "primary string, fallback string"


def _flag(log_path: str, number: int) -> str:
    return f"{log_path}/done/round={number}"


def _write_slice(rows: DataFrame, log_path: str, number: int, part: int = 0) -> None:
    """Replace the folder of one slice of a round."""
    columns = [c.split()[0] for c in f"{ATTEMPTS}, {_ADDRESSES}".split(", ")]
    rows.select(*[c for c in columns if c in rows.columns]).write.mode("overwrite").parquet(
        f"{log_path}/attempts/round={number}/slice={part}"
    )


def read_log(
    spark: SparkSession, log_path: str, number: int | str = "*", more: str = ""
) -> DataFrame:
    return spark.read.schema(ATTEMPTS + more).parquet(f"{log_path}/attempts/round={number}/slice=*")


def _settled(refs: DataFrame) -> DataFrame:
    """Round 0: refs that need no model call."""
    missing = F.coalesce(F.col("ref_data_json"), F.lit("")) == ""
    return refs.where(missing | has_value(F.col("ref_data_json"), "ocr")).select(
        *REF_KEYS,
        F.lit(0).cast("long").alias("seq"),
        F.current_timestamp().alias("attempted_at"),
        F.when(missing, "permanent").otherwise("skipped").alias("outcome"),
        F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("tokens"),
        F.when(missing, F.concat(F.lit("Ref data not found for: "), F.col("filename"))).alias(
            "message"
        ),
        F.lit(0).cast("long").alias("fails"),
    )


def _still_pending(attempts: DataFrame, max_retries: int) -> DataFrame:
    again = (F.col("outcome") == "rate_limit") | (
        (F.col("outcome") == "transient") & (F.col("fails") < max_retries)
    )
    return attempts.where(again).select(*REF_KEYS, "fails", "primary", "fallback")


def _first_todo(refs: DataFrame, policy: Policy, extra: list[str]) -> DataFrame:
    doc = F.col("ref_data_json")
    missing = F.coalesce(doc, F.lit("")) == ""
    urls = url_variants(F.col("cdn_url"), policy.cdn_host)
    open_refs = refs.where(~missing & ~has_value(doc, "ocr"))
    return open_refs.select(
        *REF_KEYS, F.lit(0).cast("long").alias("fails"), urls.alias("_urls"), *extra
    ).select(*REF_KEYS, "fails", "_urls.primary", "_urls.fallback", *extra)


def _slices(todo: DataFrame, size: int, policy: Policy, path: str) -> list[DataFrame]:
    """A round's work in slices by a hash of the ref, about ``slice_refs`` each.

    ``size`` is the number of rows, or less than a slice. Several slices are cut once and
    stored, a folder each with few files, so that none of them reads or lists all the work
    again; the stored cut also stays the same when the round is taken up again.
    """
    spark = todo.sparkSession
    if size <= policy.slice_refs:
        return [todo]

    def cut() -> DataFrame:
        n = -(-size // policy.slice_refs)
        return todo.withColumn("slice", F.pmod(F.xxhash64(*REF_KEYS), F.lit(n)))

    def write() -> None:
        cut().repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/rows")

    once(spark, f"{path}/done", write)
    schema = StructType([*todo.schema.fields, StructField("slice", LongType())])
    stored_cut = spark.read.schema(schema).parquet(f"{path}/rows")
    numbers = sorted(r.slice for r in stored_cut.select("slice").distinct().collect())
    return [spark.read.schema(todo.schema).parquet(f"{path}/rows/slice={k}") for k in numbers]


def run_rounds(
    refs: DataFrame,
    load_model: Callable[[], Model],
    log_path: str,
    policy: Policy,
    payload: str | None = None,
) -> Rounds:
    """Attempt every pending ref once per round until none is left.

    ``refs`` must be a stored table; it needs the ref keys, ``cdn_url`` and
    ``ref_data_json``. Each attempt row carries the failure count and the addresses of its ref,
    so the next round's work follows from the last round alone: neither the log nor the
    refs are read again (but for a payload).

    A round is kept slice by slice. A call that was cut off goes on behind the last
    finished slice: finished rounds are not looked at again, and neither calls nor waits
    of theirs are repeated. Without a stated concurrency a few slices run at once, so that the
    start and the last tasks of one leave no core idle; the session's cores bound their calls. With ``max_rounds`` this call may stop early.
    """
    spark = refs.sparkSession
    extra = [payload] if payload else []

    def run_slice(number: int, k: int, part: DataFrame, alone: bool) -> None:
        flag = f"{_flag(log_path, number)}-slices/{k}"
        if not alone and is_done(spark, flag):
            return
        _write_slice(_attempted(part, load_model, number, policy, payload), log_path, number, k)
        if not alone:
            set_done(spark, flag)

    if not is_done(spark, _flag(log_path, 0)):
        _write_slice(_settled(refs), log_path, 0)
        set_done(spark, _flag(log_path, 0))
    n_refs = refs.count()
    number = next(n for n in count(1) if not is_done(spark, _flag(log_path, n)))
    streak, called = 0, 0
    for number in count(number):
        if number == 1:
            todo, size = _first_todo(refs, policy, extra), n_refs
            if n_refs > policy.slice_refs:  # the rest of round 0
                size = n_refs - read_log(spark, log_path, 0).count()
        else:
            last = read_log(spark, log_path, number - 1, f", {_ADDRESSES}")
            todo = _still_pending(last, policy.max_retries)
            if todo.isEmpty():
                return Rounds(number - 1, True)
            size = todo.count() if n_refs > policy.slice_refs else n_refs
            if payload:
                todo = todo.join(refs.select(*REF_KEYS, payload), REF_KEYS)
        if called == policy.max_rounds:
            return Rounds(number - 1, False)
        called += 1
        parts = _slices(todo, size, policy, f"{log_path}/todo/round={number}")
        if policy.concurrency or len(parts) == 1:
            # a stated concurrency holds over all tasks, so its slices follow each other
            for k, part in enumerate(parts):
                run_slice(number, k, part, len(parts) == 1)
        else:
            target = inheritable_thread_target(spark)(run_slice)
            with ThreadPoolExecutor(SLICES_AT_ONCE) as pool:
                running = [pool.submit(target, number, k, p, False) for k, p in enumerate(parts)]
                try:
                    for slice_ in running:
                        slice_.result()
                finally:
                    for slice_ in running:
                        slice_.cancel()
        set_done(spark, _flag(log_path, number))
        if policy.pause:
            limited = read_log(spark, log_path, number).where(F.col("outcome") == "rate_limit")
            streak = 0 if limited.isEmpty() else streak + 1
            if streak:
                policy.pause(_delay_seconds(streak))


def _attempted(
    todo: DataFrame,
    load_model: Callable[[], Model],
    number: int,
    policy: Policy,
    payload: str | None,
) -> DataFrame:
    """One attempt per row of ``todo`` with the failures of its ref so far."""
    tried = extract_once(
        todo,
        load_model,
        REF_KEYS,
        seq=number,
        payload=payload,
        carry=["fails", "primary", "fallback"],
        concurrency=policy.concurrency or todo.sparkSession.sparkContext.defaultParallelism,
        threads=policy.threads,
        call_size=policy.call_size,
        model_key=policy.model_key,
    )
    failed = F.col("outcome").isin("rate_limit", "transient").cast("long")
    return tried.withColumn("fails", F.col("fails") + failed).withColumn(
        "attempted_at", F.current_timestamp()
    )


def _delay_seconds(streak: int) -> float:
    delay = min(BASE_DELAY_MS * 2 ** min(streak - 1, MAX_EXPONENT), MAX_DELAY_MS)
    return delay * (1 + JITTER_SHARE * random.uniform(-1, 1)) / 1000


def call_cost(
    spark: SparkSession, log_path: str, keys: list[str] = CHUNK_KEYS
) -> DataFrame:
    """Attempts, tokens and cost per key, from the engine's own log.

    Failed attempts count with what their calls were charged; refs that needed no call do not.
    """
    calls = read_log(spark, log_path).where(F.col("seq") > 0)
    return cost_rollup(calls, keys)


def ref_status(
    spark: SparkSession,
    log_path: str,
    max_retries: int = MAX_RETRIES,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """Status of every attempted ref, or of those of the given chunks (one row each).

    The loop attempts a ref until it has ended and no further, and each row carries
    the failures so far: a ref's last row decides. Texts stay out of it.
    """
    log = read_log(spark, log_path)
    if chunks is not None:
        log = log.join(spread(chunks), CHUNK_KEYS, "left_semi")
    return _status_rows(log, max_retries, _BY_REF)


def _status_rows(log: DataFrame, max_retries: int, keys: list[str]) -> DataFrame:
    """Status of every ref that the rows tell of, from its last row."""
    last = F.max_by(F.struct("seq", "outcome", "fails", "message"), "seq").alias("l")
    folded = log.groupBy(*keys).agg(last)
    outcome, spent = F.col("l.outcome"), F.col("l.fails") >= max_retries
    status = (
        F.when(outcome.isin("done", "skipped"), outcome)
        .when((outcome == "permanent") | ((outcome == "transient") & spent), "error")
        .otherwise("pending")
    )
    error = F.when(outcome == "permanent", F.col("l.message")).when(
        (outcome == "transient") & spent,
        F.concat(F.lit(f"Failed after {max_retries} retries: "), F.col("l.message")),
    )
    return folded.select(
        *REF_KEYS,
        status.alias("status"),
        F.col("l.fails").alias("retry_count"),
        error.alias("error"),
        F.col("l.seq").alias("seq"),
    )


def enriched_refs(refs: DataFrame, log_path: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Refs with status, new document, its content id and the text length.

    Skipped refs get a document too: the old one as it is, so its content id stays.
    """
    log = read_log(refs.sparkSession, log_path)
    # a ref with a text has ended, so only the other rows are reduced to each ref's last one;
    # both are slim, and refs, rows and texts are shuffled and sorted once, by the same keys
    done_row = F.col("outcome") == "done"
    others = _status_rows(log.where(~done_row), max_retries, _BY_REF).withColumnRenamed(
        "seq", "_seq"
    )
    texts = log.where(done_row).select(
        *_BY_REF, F.col("seq").alias("_done_seq"), F.col("fails").alias("_fails"), "text", "tokens"
    )
    joined = refs.join(others, _BY_REF, "left").join(texts, _BY_REF, "left")
    has_text = F.col("_done_seq").isNotNull() & (
        F.coalesce(F.col("_seq"), F.lit(-1)) <= F.col("_done_seq")
    )
    joined = joined.select(
        *REF_KEYS,
        *[c for c in refs.columns if c not in REF_KEYS],
        F.when(has_text, "done").otherwise(F.col("status")).alias("status"),
        F.when(has_text, F.col("_fails")).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(~has_text, F.col("error")).alias("error"),
        F.when(has_text, F.col("_done_seq")).otherwise(F.col("_seq")).alias("seq"),
        F.when(has_text, F.col("text")).alias("text"),
        F.when(has_text, F.col("tokens")).alias("tokens"),
    )
    old = F.col("ref_data_json")
    done, skipped = F.col("status") == "done", F.col("status") == "skipped"
    document = F.when(done, merge_ocr(old, F.col("text"))).when(skipped, old)
    length = F.when(done, utf16_length(F.col("text"))).when(
        skipped, utf16_length(field_text(parse_doc(old), "ocr"))
    )
    # exploded from one element, or the id's hash would make the document once more
    joined = joined.select("*", F.inline(F.array(F.struct(document.alias("content")))))
    return (
        joined.withColumn("status", F.coalesce("status", F.lit("pending")))
        .withColumn("result_cid", content_id(F.col("content")))
        .withColumn("ocr_text_length", length)
        .drop("ref_data_json", "text")
    )


def enrich(
    refs: DataFrame,
    load_model: Callable[[], Model],
    log_path: str,
    policy: Policy,
    payload: str | None = None,
) -> DataFrame:
    """The loop followed by the fold."""
    run_rounds(refs, load_model, log_path, policy, payload)
    return enriched_refs(refs, log_path, policy.max_retries)
