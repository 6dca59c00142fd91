"""The whole path: requests in, new entity versions and reports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.scalars import elapsed_ms, status_of_phase
from docflow.operators.contents import only_wanted, put_contents
from docflow.operators.discover import load_manifests, refs_of, wanted_files
from docflow.operators.fold import chunk_fail_fold
from docflow.operators.report import chunk_progress, chunk_report, failed_refs, pi_results
from docflow.operators.requests import admit, validate_requests, work_items
from docflow.operators.versions import (
    chain_updates,
    entity_tip,
    manifest_merge,
    only_entities,
    publish_heads,
    publishable,
)
from docflow.plans.enrich import Policy, enriched_refs, ref_status, run_rounds
from docflow.plans.extract import Model
from docflow.schema import CHUNK_FAILURES, CHUNK_KEYS, PHASES, PI_KEYS, REF_KEYS, key_violations
from docflow.session import is_done, once, spread, stored
from docflow.sources.sinks import append_versions, write_contents, write_reports

#: An entity's keys, the most varied first: sorts compare few rows beyond the first key then.
_BY_PI = ["pi", "chunk_id", "batch_id"]


@dataclass(frozen=True)
class Store:
    """The tables a run reads, and the folder it appends to."""

    versions: DataFrame
    components: DataFrame
    contents: DataFrame
    path: str


def accept_requests(requests: DataFrame, chunk_status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests to run, answers). Invalid requests, requests that name an
    entity twice and requests for a chunk in flight are answered, not run."""
    ok, rejected = validate_requests(requests)
    twice = key_violations(work_items(ok).withColumn("one", F.lit(1)), PI_KEYS)
    twice = twice.select(*CHUNK_KEYS).distinct()
    clean = ok.join(twice, CHUNK_KEYS, "left_anti")
    judged = admit(clean, chunk_status)
    answers = (
        judged.select(*CHUNK_KEYS, "request_id", "status", "phase")
        .unionByName(
            ok.join(twice, CHUNK_KEYS, "left_semi").select(
                *CHUNK_KEYS, "request_id", F.lit("duplicate_pi").alias("status")
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            rejected.select(*CHUNK_KEYS, "request_id", F.lit("rejected").alias("status")),
            allowMissingColumns=True,
        )
    )
    return judged.where(F.col("status") == "accepted").drop("status", "phase"), answers


def publish(
    pis: DataFrame, ref_results: DataFrame, store: Store, run_path: str, write_id: str
) -> DataFrame:
    """Append new versions; returns the entities with tip, version and error.

    An update is one entity in one chunk: batch and chunk stay two columns.
    """
    spark = pis.sparkSession

    def plan_versions() -> DataFrame:
        tips = entity_tip(only_entities(store.versions, pis))
        heads = publish_heads(pis, ref_results, _BY_PI).withColumnRenamed("pi", "entity")
        return chain_updates(heads.where(F.col("n_components") > 0), tips, CHUNK_KEYS)

    plan = stored(spark, f"{run_path}/plan", plan_versions)
    components = publishable(ref_results).select(
        F.col("pi").alias("entity"),
        *CHUNK_KEYS,
        "filename",
        F.col("result_cid").alias("cid"),
    )
    once(
        spark,
        f"{run_path}/published",
        lambda: append_versions(plan, components, store.path, write_id, CHUNK_KEYS),
    )
    outcome = plan.select(
        *CHUNK_KEYS, F.col("entity").alias("pi"), "new_tip", "new_version", "entity_error"
    )
    return pis.select(*_BY_PI).join(outcome, _BY_PI, "left")


Gate = Callable[[DataFrame, int], DataFrame]


class ChunkFailures:
    """Failures of whole chunks, as rows of a log below the run's folder.

    ``gates`` names, by phase, functions that look at what a phase made and return the
    chunks that failed in it (batch_id, chunk_id, message); they also get the number of
    the try. A failed chunk's phase is repeated, alone, until it passes or the chunk has failed
    ``MAX_GLOBAL_RETRIES`` times over all phases; then it is in ERROR and leaves the run. All
    other chunks go on. Every try's rows and failures are stored once.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        gates: dict[str, Gate],
        pause: Callable[[float], None] | None,
    ):
        unknown = set(gates) - set(PHASES[:3])
        if unknown:
            raise ValueError(f"no phases: {sorted(unknown)}")
        self.spark, self.path, self.gates, self.pause = spark, path, gates, pause
        self.parts: list[DataFrame] = []

    def log(self) -> DataFrame:
        """(batch_id, chunk_id, seq, phase, message) of all failures so far."""
        empty = self.spark.createDataFrame([], CHUNK_FAILURES)
        return reduce(DataFrame.unionByName, self.parts, empty)

    def folded(self) -> DataFrame:
        """Phase ERROR or a retry with its delay, for each chunk that ever failed."""
        return chunk_fail_fold(self.log())

    def without_lost(self, rows: DataFrame) -> DataFrame:
        """Rows of the chunks that are not in ERROR."""
        if not self.parts:
            return rows
        lost = self.folded().where("phase = 'ERROR'").select(*CHUNK_KEYS)
        return rows.join(lost, CHUNK_KEYS, "left_anti")

    def passed(
        self, phase: str, name: str, build: Callable[[DataFrame | None], DataFrame]
    ) -> DataFrame:
        """Rows of a phase for the chunks that got through it.

        ``build`` makes the rows of the given chunks (None: all).
        """
        if phase not in self.gates:
            return self.without_lost(stored(self.spark, f"{self.path}/{name}", lambda: build(None)))
        kept, again, start = [], None, 100 * PHASES.index(phase)
        for attempt in count(1):
            at = f"{self.path}/{name}/try={attempt}"
            rows = stored(self.spark, at, lambda: build(again))
            noted = f"{self.path}/failures/{phase}-{attempt}"
            tried_before = is_done(self.spark, f"{noted}/done")
            failed = stored(
                self.spark,
                noted,
                lambda: self.gates[phase](rows, attempt)
                .dropDuplicates(CHUNK_KEYS)
                .select(
                    *CHUNK_KEYS,
                    F.lit(start + attempt).cast("long").alias("seq"),
                    F.lit(phase).alias("phase"),
                    "message",
                ),
            )
            if failed.isEmpty():
                return self.without_lost(reduce(DataFrame.unionByName, kept, rows))
            self.parts.append(failed)
            kept.append(rows.join(spread(failed.select(*CHUNK_KEYS)), CHUNK_KEYS, "left_anti"))
            waiting = self.folded().where("retry_delay_ms IS NOT NULL")
            again = failed.select(*CHUNK_KEYS).join(waiting, CHUNK_KEYS).select(
                *CHUNK_KEYS, "retry_delay_ms"
            )
            delay = again.agg(F.max("retry_delay_ms")).first()[0]
            if delay is None:
                return self.without_lost(reduce(DataFrame.unionByName, kept))
            if self.pause and not tried_before:
                self.pause(delay / 1000)
            again = again.select(*CHUNK_KEYS)


def _of_chunks(rows: DataFrame, chunks: DataFrame | None) -> DataFrame:
    return rows if chunks is None else rows.join(spread(chunks), CHUNK_KEYS, "left_semi")


def process_chunks(
    requests: DataFrame,
    store: Store,
    load_model: Callable[[], Model],
    policy: Policy,
    run_path: str,
    write_id: str,
    gates: dict[str, Gate] | None = None,
) -> DataFrame:
    """Run accepted requests to the end and return the chunk reports.

    If the policy limits the rounds and refs are still pending after them, nothing is
    published or reported: the result says which chunks are processing and how far
    they are, and the next call goes on.

    The tables between the stages are written once and read back: work items, files,
    refs (so that documents are looked up once), enriched refs (so that nothing downstream
    repeats the merge) and the publish plan. A run that was cut off goes on
    behind its last finished table when called again with the same
    ``run_path`` and ``write_id``; a finished one changes nothing.

    ``gates`` make single chunks fail and be tried again: see ``ChunkFailures``. A chunk in
    ERROR is reported as such, and nothing of it is processed further or published.
    Reports of all runs are kept in the store, by ``write_id``; ids of later runs must
    sort behind those of earlier ones.
    """
    spark: SparkSession = requests.sparkSession
    chunks = stored(
        spark,
        f"{run_path}/chunks",
        lambda: requests.select(*CHUNK_KEYS, F.current_timestamp().alias("started_at")),
    )
    items = stored(spark, f"{run_path}/items", lambda: work_items(requests))
    failures = ChunkFailures(spark, run_path, gates or {}, policy.pause)

    def find_files(of: DataFrame | None) -> DataFrame:
        wanted = _of_chunks(items, of)
        manifests = load_manifests(wanted, entity_tip(only_entities(store.versions, wanted)))
        known = manifests.where(F.col("fetch_error").isNull()).select(*PI_KEYS)
        latest = manifest_merge(only_entities(store.components, wanted))
        return wanted_files(known, latest)

    files = failures.passed("FETCHING", "files", find_files)
    refs = stored(spark, f"{run_path}/refs", lambda: refs_of(files, store.contents))
    log = f"{run_path}/log"
    if not is_done(spark, f"{run_path}/ref_results/done"):
        if not run_rounds(refs, load_model, log, policy).finished:
            left = failures.without_lost(chunks)
            return _in_between(left, refs, ref_status(spark, log, policy.max_retries))
    ended_refs = stored(
        spark, f"{run_path}/ref_results", lambda: enriched_refs(refs, log, policy.max_retries)
    )
    results = ended_refs
    for phase in ("PROCESSING", "PUBLISHING"):
        if phase in failures.gates:
            rows = failures.passed(
                phase, phase.lower(), lambda of: _of_chunks(ended_refs.drop("content"), of)
            )
            lost = rows.select(*CHUNK_KEYS).distinct()
            results = results.join(spread(lost), CHUNK_KEYS, "left_semi")
    results = failures.without_lost(results)

    def put_new() -> None:
        named = results.where(F.col("content").isNotNull()).withColumn("cid", F.col("result_cid"))
        _, fresh = put_contents(named, only_wanted(store.contents, named))
        write_contents(fresh, f"{store.path}/contents", write_id)

    once(spark, f"{run_path}/contents", put_new)
    slim = results.drop("content")
    pis = publish(failures.without_lost(items), slim, store, run_path, write_id)

    entities = stored(spark, f"{run_path}/entities", lambda: pi_results(pis, slim, _BY_PI))
    ended = chunks.withColumn("completed_at", F.current_timestamp())
    if failures.parts:
        lost = failures.folded().select(*CHUNK_KEYS, "phase", "global_error")
        ended = ended.join(spread(lost), CHUNK_KEYS, "left").fillna("DONE", ["phase"])
    else:
        ended = ended.select(
            "*", F.lit("DONE").alias("phase"), F.lit(None).cast("string").alias("global_error")
        )
    report = stored(
        spark,
        f"{run_path}/chunk_reports",
        lambda: chunk_report(ended, entities, F.current_timestamp()),
    )
    failed = failed_refs(slim, PI_KEYS)
    path = f"{store.path}/reports"
    once(
        spark, f"{run_path}/reported", lambda: write_reports(report, entities, failed, path, write_id)
    )
    return report


def _in_between(chunks: DataFrame, refs: DataFrame, status: DataFrame) -> DataFrame:
    """Chunk reports of a run that is not over: no chunk has an outcome yet.

    Chunks with pending refs are being processed; the others wait to be published.
    """
    known = refs.select(*REF_KEYS).join(status, REF_KEYS, "left")
    counts = chunk_progress(known.withColumn("status", F.coalesce("status", F.lit("pending"))))
    phase = F.when(F.col("pending") > 0, "PROCESSING").otherwise("PUBLISHING")
    return (
        chunks.join(counts, CHUNK_KEYS, "left")
        .fillna(0, ["total_refs", "completed", "failed", "skipped", "pending"])
        .select(
            *CHUNK_KEYS,
            status_of_phase(phase).alias("status"),
            "total_refs",
            "completed",
            "failed",
            "skipped",
            elapsed_ms(F.col("started_at"), F.lit(None), F.current_timestamp()).alias(
                "processing_time_ms"
            ),
            F.lit(None).cast("string").alias("error"),
        )
    )
