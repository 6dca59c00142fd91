"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow import fixtures
from docflow.fixtures import AS_OF, CDN, table
from docflow.functions.classify import classify_error, fallback_eligible, normalise_message
from docflow.functions.jsondoc import field_text, merge_ocr, parse_doc
from docflow.functions.scalars import (
    backoff_remaining,
    chunk_label,
    in_backoff,
    is_ref,
    network_tag,
    utf16_length,
)
from docflow.functions.urls import url_variants
from docflow.operators import batches, contents, discover, fold, queue, report, versions
from docflow.operators.cost import cost_rollup as roll_up_cost
from docflow.operators.prompts import item_text, prompt_lines
from docflow.operators.requests import admit, reject_reason, work_items as explode_items
from docflow.operators.requests import assign_chunks as cut_chunks
from docflow.plans.enrich import Policy, enrich, run_rounds
from docflow.plans.enrich import call_cost as cost_of_log
from docflow.plans.extract import extract_once
from docflow.plans.process import Store, process_chunks as run_process
from docflow.plans.status import run_status
from docflow.schema import key_violations as find_violations
from docflow.session import configure, durable, run_dir, stored
from docflow.sources.keyed import KeyedTable
from docflow.sources.sinks import write_contents, write_reports
from docflow.sources.tables import (
    read_components,
    read_contents,
    read_latest_reports,
    read_reports,
    read_versions,
)
from docflow.streaming.complete import publish_batches, write_complete_chunks
from docflow.streaming.fold import folded, state_table, write_fold
from docflow.suite.models import asset_model, letter_model, title_model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _str(column: str):
    return F.col(column).cast("string")


def _parted_stream(spark: SparkSession, sf_dir: str, name: str, order: str, parts: int = 3):
    """A table as a stream of several micro-batches, cut by ranges of ``order``."""
    rows = table(spark, sf_dir, name)
    path = run_dir(spark, f"parts-{name}")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-(high - low + 1) // parts)) if low is not None else 1
    for part in range(parts):
        start = (low or 0) + part * width
        own = rows.where((F.col(order) >= start) & (F.col(order) < start + width))
        # one file each, so that a micro-batch is a whole part
        own.coalesce(1).write.parquet(f"{path}/part={part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(f"{path}/part=*")


# --- sources, requests -------------------------------------------------------


@query
def work_items(spark, sf_dir):
    requests = (
        fixtures.pis(spark, sf_dir)
        .groupBy("batch_id", "chunk_id")
        .agg(F.sort_array(F.collect_list("pi")).alias("pis"))
    )
    return explode_items(requests).withColumn("pos", F.col("pos").cast("long"))


@query
def request_validation(spark, sf_dir):
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(key % 7 == 0, None)
        .when(key % 11 == 0, "")
        .otherwise(F.concat(F.lit("b"), _str("c_nationkey")))
        .alias("batch_id"),
        F.when(key % 13 == 0, "").otherwise(_str("c_custkey")).alias("chunk_id"),
        F.when(key % 17 == 0, None)
        .when(key % 19 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(_str("c_custkey")))
        .alias("pis"),
    )
    return requests.select(
        "request_id",
        reject_reason(requests).alias("reason"),
        F.array_size("pis").cast("long").alias("n_pis"),
    )


@query
def admit_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(
        F.lit("b").alias("batch_id"),
        F.col("o_custkey").alias("chunk_id"),
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").alias("received_at"),
    )
    kind = F.col("c_custkey") % 5
    known = (
        table(spark, sf_dir, "customer")
        .where(kind != 0)
        .select(
            F.lit("b").alias("batch_id"),
            F.col("c_custkey").alias("chunk_id"),
            F.when(kind == 1, "DONE")
            .when(kind == 2, "ERROR")
            .when(kind == 3, "PROCESSING")
            .otherwise("PUBLISHING")
            .alias("phase"),
        )
    )
    return admit(requests, known).select("request_id", "chunk_id", "status", "phase")


@query
def key_violations(spark, sf_dir):
    return find_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def assign_chunks(spark, sf_dir):
    pis = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pi"))
    return cut_chunks(pis, [F.col("pi")], 10)


@query
def latest_run(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("run_id")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), "l_linenumber"
    )
    newest = report.latest_run(runs, ["chunk_id"], "run_id")
    return lines.join(newest, "run_id").groupBy("chunk_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


# --- scalar functions --------------------------------------------------------


@query
def url_variants_of_pages(spark, sf_dir):
    urls = fixtures.page_urls(spark, sf_dir).select(
        "page_id", url_variants(F.col("cdn_url"), CDN).alias("v")
    )
    return urls.select(
        "page_id", F.col("v.primary").alias("primary_url"), F.col("v.fallback").alias("fallback_url")
    )


QUERIES["url_variants"] = QUERIES.pop("url_variants_of_pages")


@query
def error_classify(spark, sf_dir):
    failed = fixtures.attempts(spark, sf_dir).where(F.col("message").isNotNull())
    message = F.col("message")
    judged = failed.select(
        "event_id",
        "message",
        classify_error(message).alias("outcome"),
        fallback_eligible(message, F.col("event_id") % 2 == 0).alias("use_fallback"),
    )
    text = normalise_message(message, F.col("outcome"), F.col("use_fallback"))
    return judged.withColumn("message", text)


@query
def text_length(spark, sf_dir):
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 10 == 0, "\U0001f600").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", utf16_length(text).alias("n_units"))


@query
def network_tags(spark, sf_dir):
    key = F.col("c_custkey")
    pi = F.concat(
        F.when(key % 3 == 0, "II").when(key % 3 == 1, "ii").otherwise("01"), key.cast("string")
    )
    return table(spark, sf_dir, "customer").select(
        pi.alias("pi"), network_tag(pi).alias("network")
    )


QUERIES["network_tag"] = QUERIES.pop("network_tags")


@query
def doc_merge(spark, sf_dir):
    docs = fixtures.ref_documents(spark, sf_dir)
    merged = docs.select(
        "doc_id", merge_ocr(F.col("json"), F.concat(F.col("text"), F.lit(' "end"\n'))).alias("json")
    )
    parsed = F.from_json(
        "json",
        "url string, doc_id long, ocr string, lang string, extra struct<source: string>",
    )
    doc = merged.select("doc_id", parsed.alias("d"))
    return doc.select(
        "doc_id",
        F.col("d.url").alias("url"),
        F.col("d.doc_id").alias("inner_id"),
        F.col("d.lang").alias("lang"),
        F.col("d.extra.source").alias("source"),
        contents.content_id(F.col("d.ocr")).alias("ocr_id"),
    )


# --- discovery ---------------------------------------------------------------


def _tips(spark, sf_dir):
    return versions.entity_tip(
        fixtures.versions(spark, sf_dir), "at", ver=F.count(F.lit(1))
    )


def _manifest(spark, sf_dir):
    return versions.manifest_merge(fixtures.components(spark, sf_dir), "at")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 10.0).cast("long").alias("chunk_id"),
        F.col("c_custkey").alias("pi"),
    )


@query
def manifest_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pi"))
    return discover.load_manifests(items, _tips(spark, sf_dir))


@query
def ref_components(spark, sf_dir):
    files = discover.ref_components(fixtures.components(spark, sf_dir))
    return files.select("entity", "version_id", "filename", "cid")


@query
def content_lookup(spark, sf_dir):
    docs = fixtures.ref_documents(spark, sf_dir)
    cid = F.concat(F.lit("cid"), _str("doc_id"))
    stored = docs.where(F.col("doc_id") % 19 != 0).select(
        cid.alias("cid"), F.col("json").alias("content")
    )
    path = run_dir(spark, "contents")
    write_contents(stored, path, "w0")
    wanted = docs.select("doc_id", cid.alias("cid"))
    found = discover.lookup_contents(wanted, read_contents(spark, f"{path}/*"))
    return found.select("doc_id", "drop_reason", "cdn_url")


@query
def discover_refs(spark, sf_dir):
    found = discover.discover_refs(
        _customers(spark, sf_dir), _manifest(spark, sf_dir), fixtures.part_contents(spark, sf_dir)
    )
    return found.select("chunk_id", "pi", "filename", "original_cid", "cdn_url")


@query
def discovery_totals(spark, sf_dir):
    items = _customers(spark, sf_dir)
    found = discover.discover_refs(
        items, _manifest(spark, sf_dir), fixtures.part_contents(spark, sf_dir)
    )
    return discover.discovery_totals(items, found, ["chunk_id"])


@query
def skip_enriched(spark, sf_dir):
    docs = fixtures.ref_documents(spark, sf_dir)
    skip, todo = discover.split_enriched(docs, "json")
    length = utf16_length(field_text(parse_doc(F.col("json")), "ocr"))
    return skip.select(
        "doc_id", F.lit(True).alias("skipped"), length.alias("ocr_text_length")
    ).unionByName(
        todo.select(
            "doc_id",
            F.lit(False).alias("skipped"),
            F.lit(None).cast("long").alias("ocr_text_length"),
        )
    )


# --- contents ----------------------------------------------------------------


@query
def content_put(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.col("lang") == "en").select(contents.content_id(F.col("text")).alias("cid"))
    _, fresh = contents.put_contents(docs, known, "text")
    return fresh.select("cid", utf16_length(F.col("content")).alias("size"))


def _letters(distinct: DataFrame) -> DataFrame:
    sent = distinct.withColumn("primary", F.col("cid")).withColumn(
        "fallback", F.lit(None).cast("string")
    )
    return extract_once(sent, letter_model, ["cid"], payload="text")


@query
def dedup_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = contents.dedup_extract(docs, "text", _letters)
    return done.select("doc_id", F.col("text").alias("result"), "tokens")


@query
def reused_results(spark, sf_dir):
    """A first call for the English documents, a second one for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")

    def extract(distinct: DataFrame) -> DataFrame:
        done = _letters(distinct).where(F.col("outcome") == "done")
        return done.select("cid", F.col("text").alias("result"), "tokens")

    results = KeyedTable(
        run_dir(spark, "reused-results"), ["cid"], "cid string, result string, tokens long"
    )
    contents.extract_new(docs.where("lang = 'en'"), "text", extract, results)
    done = contents.extract_new(docs, "text", extract, results)
    return done.select("doc_id", "result", "tokens", "reused")


# --- folds -------------------------------------------------------------------


def _fold_input(spark, sf_dir):
    message = normalise_message(F.col("message"), F.col("outcome"), F.lit(False))
    return fixtures.attempts(spark, sf_dir).withColumn("message", message)


@query
def attempt_fold(spark, sf_dir):
    return fold.attempt_fold(
        _fold_input(spark, sf_dir),
        keys=["pi", "filename"],
        order=["ts", "event_id"],
    )


@query
def backoff_streaks(spark, sf_dir):
    steps = (
        table(spark, sf_dir, "events")
        .groupBy(F.floor(F.col("event_id") / 10.0).cast("long").alias("step"))
        .agg(F.bool_or(F.col("event_type") == "click").alias("rate_limited"))
        .withColumn("chunk_id", F.lit(0).cast("long"))
    )
    jitter = (F.col("step") % 21 - 10) / F.lit(10.0)
    streaks = fold.backoff_streaks(steps, ["chunk_id"], "step", jitter)
    until, as_of = F.col("step") * 1000 + F.col("delay_ms"), F.col("step") * 1000 + 1500
    return streaks.withColumn("remaining_ms", backoff_remaining(until, as_of)).withColumn(
        "is_waiting", in_backoff(until, as_of)
    )


@query
def streaks_by_user(spark, sf_dir):
    """Each event is a step of its user; clicks stand for rate limits."""
    steps = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_type") == "click").alias("rate_limited")
    )
    return fold.backoff_streaks(steps, ["user_id"], "event_id")


@query
def current_streaks(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_type") == "click").alias("rate_limited")
    )
    return fold.current_streak(steps, ["user_id"], "event_id")


@query
def chunk_fail_fold(spark, sf_dir):
    failures = fixtures.attempts(spark, sf_dir).where(F.col("message").isNotNull())
    return fold.chunk_fail_fold(failures, ["pi", "filename"], ["ts", "event_id"])


# --- ordered picks -----------------------------------------------------------


def _pending_batch(spark, sf_dir):
    refs = fixtures.refs(spark, sf_dir)
    return refs, queue.next_batch(refs, ["chunk_id"], ["pi", "filename"], 5)


@query
def next_batch(spark, sf_dir):
    _, batch = _pending_batch(spark, sf_dir)
    return batch.select("chunk_id", "pi", "filename", F.col("rank").cast("long").alias("rank"))


@query
def claim_batch(spark, sf_dir):
    refs, batch = _pending_batch(spark, sf_dir)
    return queue.claim_batch(refs, batch, ["pi", "filename"]).select(
        "pi", "filename", "status", "result_cid"
    )


@query
def log_tail(spark, sf_dir):
    tail = queue.log_tail(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 50)
    return tail.select("user_id", "event_id", F.col("age").cast("long").alias("age"))


@query
def kept_log(spark, sf_dir):
    """A log capped at 100 entries per chunk, after two appends."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    capped = KeyedTable(
        run_dir(spark, "kept-log"), ["user_id"], "user_id long, event_id long, ts timestamp_ntz"
    )
    for half in range(2):
        queue.append_log(capped, events.where(F.col("event_id") % 2 == half), ["ts", "event_id"])
    return capped.read(spark, 1).select("user_id", "event_id")


# --- versions ----------------------------------------------------------------


@query
def entity_tip(spark, sf_dir):
    return _tips(spark, sf_dir)


@query
def manifest_merge(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query
def publish_plan(spark, sf_dir):
    return versions.publish_plan(fixtures.refs(spark, sf_dir), ["pi"])


def _updates(spark, sf_dir):
    key = F.col("o_orderkey")
    tips = _tips(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.when(key % 97 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("entity"),
        key.alias("update_id"),
        (key % 3 == 0).alias("is_fresh"),
        (key % 5 + 1).alias("n_components"),
        F.concat(F.lit("OCR: Updated "), (key % 5 + 1).cast("string"), F.lit(" refs")).alias("note"),
    )
    current = tips.select("entity", "tip")
    return (
        orders.join(current, "entity", "left")
        .withColumn("expect_tip", F.when(F.col("is_fresh"), F.col("tip")).otherwise("tip-stale"))
        .drop("tip", "is_fresh")
    ), tips


@query
def cas_plan(spark, sf_dir):
    plan = versions.cas_plan(*_updates(spark, sf_dir))
    return plan.select(
        "entity",
        "update_id",
        "committed",
        "round",
        "new_version",
        "new_tip",
        "prev_tip",
        "entity_error",
    )


@query
def version_append(spark, sf_dir):
    return versions.version_rows(versions.cas_plan(*_updates(spark, sf_dir)))


# --- reports -----------------------------------------------------------------


def _results(spark, sf_dir, refs=None):
    refs = refs or fixtures.refs(spark, sf_dir)
    pis = fixtures.pis(spark, sf_dir).drop("o_orderdate")
    return report.pi_results(pis, refs, ["batch_id", "chunk_id", "pi"]), refs


def _report(spark, sf_dir):
    results, _ = _results(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("timestamp")
    return report.chunk_report(fixtures.chunks(spark, sf_dir), results, as_of)


def _reports(spark, sf_dir):
    # both are stored tables in a real run
    results, refs = _results(spark, sf_dir, durable(fixtures.refs(spark, sf_dir)))
    results = durable(results)
    as_of = F.lit(AS_OF).cast("timestamp")
    chunk_rows = report.chunk_report(fixtures.chunks(spark, sf_dir), results, as_of)
    failed = report.failed_refs(refs, ["batch_id", "chunk_id", "pi"])
    return chunk_rows, results, failed


@query
def pi_results(spark, sf_dir):
    results, _ = _results(spark, sf_dir)
    return results.select("pi", "chunk_id", "status", "refs_completed", "refs_failed")


@query
def chunk_progress(spark, sf_dir):
    return report.chunk_progress(fixtures.refs(spark, sf_dir))


@query
def failed_refs(spark, sf_dir):
    return report.failed_refs(fixtures.refs(spark, sf_dir), ["pi"])


@query
def chunk_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query
def chunk_status(spark, sf_dir):
    known = fixtures.chunks(spark, sf_dir)
    unknown = table(spark, sf_dir, "supplier").select(
        F.lit("none").alias("batch_id"), F.col("s_suppkey").alias("chunk_id")
    )
    wanted = known.select("batch_id", "chunk_id").unionByName(unknown)
    progress = report.chunk_progress(fixtures.refs(spark, sf_dir))
    status = report.chunk_status(wanted, known, progress)
    label = chunk_label(F.col("batch_id"), _str("chunk_id"))
    return status.select(
        label.alias("label"), "status", "phase", "total_refs", "completed", "failed", "skipped",
        "pending",
    )


@query
def complete_chunks(spark, sf_dir):
    return report.complete_chunks(fixtures.refs(spark, sf_dir), fixtures.chunks(spark, sf_dir))


@query
def report_sink(spark, sf_dir):
    path = run_dir(spark, "reports")
    write_reports(*_reports(spark, sf_dir), path)
    _, entities, failed = read_reports(spark, path)
    return batches.report_lines(entities, failed)


@query
def batch_rollup(spark, sf_dir):
    reports = _report(spark, sf_dir).where(F.col("chunk_id") % 101 != 100)
    return batches.batch_rollup(fixtures.chunks(spark, sf_dir), reports)


@query
def apply_report(spark, sf_dir):
    _, results, failed = _reports(spark, sf_dir)
    entities = report.entity_rows(results).where(F.col("chunk_id") % 5 != 0)
    failed = failed.where(F.col("chunk_id") % 5 != 0)
    # every third entity is reported by a second chunk, with an older and a newer version
    again = entities.where(F.col("pi") % 3 == 0)
    older = again.select(
        "batch_id", (-F.col("chunk_id") - 1).alias("chunk_id"), "pi", "status",
        F.lit("zzz").alias("new_tip"), F.lit(0).cast("long").alias("new_version"),
        "refs_completed", "refs_failed",
    )
    newer = older.withColumn("new_tip", F.lit("aaa")).withColumn(
        "new_version", F.lit(9).cast("long")
    )
    newer = newer.where(F.col("pi") % 2 == 0)
    twice = failed.withColumn("chunk_id", -F.col("chunk_id") - 1)
    nodes = fixtures.refs(spark, sf_dir).select("pi", "filename")
    applied = batches.apply_report(
        nodes,
        entities.unionByName(older).unionByName(newer),
        failed.unionByName(twice),
    )
    return batches.node_states(applied)


# --- documented extras -------------------------------------------------------


@query
def cost_rollup(spark, sf_dir):
    calls = table(spark, sf_dir, "documents").select(
        "source",
        F.col("n_chars").alias("prompt_tokens"),
        (F.col("doc_id") % 100).alias("completion_tokens"),
    )
    return roll_up_cost(calls, ["source"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query
def assemble_prompts(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", item_text(F.col("role"), F.col("turn"), F.col("text")).alias("item")
    )
    return prompt_lines(items, ["conv_id"], "turn", F.col("conv_id"), F.lit(1))


# --- extraction --------------------------------------------------------------


@query
def extract_pages(spark, sf_dir):
    urls = fixtures.page_urls(spark, sf_dir).select(
        "page_id", url_variants(F.col("cdn_url"), CDN).alias("v"), "html"
    )
    todo = urls.select("page_id", "v.primary", "v.fallback", "html")
    tried = extract_once(todo, title_model, ["page_id"], payload="html")
    return tried.select("page_id", "outcome", "text", "tokens", "message", "on_fallback")


def page_refs(spark, sf_dir):
    key = F.col("page_id")
    document = F.to_json(
        F.struct(
            F.col("cdn_url").alias("url"), "page_id", F.when(key % 10 == 9, "old text").alias("ocr")
        )
    )
    return fixtures.page_urls(spark, sf_dir).select(
        F.lit("b0").alias("batch_id"),
        F.floor(key / 10.0).cast("string").alias("chunk_id"),
        key.cast("string").alias("pi"),
        F.concat(F.lit("page"), key.cast("string"), F.lit(".ref.json")).alias("filename"),
        "cdn_url",
        F.when(key % 50 != 49, document).alias("ref_data_json"),
        "html",
    )


@query
def enrich_pages(spark, sf_dir):
    done = enrich(
        page_refs(spark, sf_dir),
        title_model,
        run_dir(spark, "enrich"),
        Policy(cdn_host=CDN, pause=None),
        payload="html",
    )
    return done.select(
        "pi",
        "filename",
        "status",
        "retry_count",
        "error",
        "ocr_text_length",
        "tokens",
        field_text(parse_doc(F.col("content")), "ocr").alias("ocr"),
    )


@query
def call_cost(spark, sf_dir):
    """What a run over the pages cost, from its own attempt log."""
    path = run_dir(spark, "call-cost")
    refs = durable(page_refs(spark, sf_dir))
    run_rounds(refs, title_model, path, Policy(cdn_host=CDN, pause=None), payload="html")
    cost = cost_of_log(spark, path, ["chunk_id"])
    return cost.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def _process_requests(spark, sf_dir):
    return (
        _customers(spark, sf_dir)
        .groupBy(F.lit("b0").alias("batch_id"), _str("chunk_id").alias("chunk_id"))
        .agg(F.sort_array(F.collect_list(_str("pi"))).alias("pis"))
    )


def _process_store(spark, sf_dir, path):
    """The tables before the run, built once for all calls with the same path."""

    def build_tips():
        return _tips(spark, sf_dir).withColumn("entity", _str("entity"))

    tips = stored(spark, f"{path}/before/versions", build_tips)

    def build_manifest():
        manifest = _manifest(spark, sf_dir)
        manifest = manifest.join(tips.select(F.col("entity").cast("long"), "ver"), "entity")
        return manifest.withColumn("entity", _str("entity"))

    return Store(
        versions=tips,
        components=stored(spark, f"{path}/before/components", build_manifest),
        contents=fixtures.part_contents(spark, sf_dir),
        path=f"{path}/store",
    )


def _process(spark, sf_dir, path, policy, gates=None):
    """One call of the whole path; a second call with the same path goes on."""
    requests, store = _process_requests(spark, sf_dir), _process_store(spark, sf_dir, path)
    return run_process(requests, store, asset_model, policy, f"{path}/run", "w0", gates)


_REPORT = ["chunk_id", "status", "total_refs", "completed", "failed", "skipped"]


@query
def process_chunks(spark, sf_dir):
    path = run_dir(spark, "process")
    return _process(spark, sf_dir, path, Policy(cdn_host=CDN)).select(*_REPORT)


@query
def process_pending(spark, sf_dir):
    """The state after one round: nothing is final, nothing is published."""
    path = run_dir(spark, "process-pending")
    return _process(spark, sf_dir, path, Policy(cdn_host=CDN, max_rounds=1)).select(*_REPORT)


@query
def process_resume(spark, sf_dir):
    path = run_dir(spark, "process-resume")
    _process(spark, sf_dir, path, Policy(cdn_host=CDN, max_rounds=1))
    return _process(spark, sf_dir, path, Policy(cdn_host=CDN)).select(*_REPORT)


@query
def process_versions(spark, sf_dir):
    path = run_dir(spark, "process-versions")
    _process(spark, sf_dir, path, Policy(cdn_host=CDN))
    written = read_versions(spark, f"{path}/store")
    return written.select("entity", "ver", "tip", "prev_tip", "note", "n_components")


@query
def process_components(spark, sf_dir):
    path = run_dir(spark, "process-components")
    _process(spark, sf_dir, path, Policy(cdn_host=CDN))
    files = read_components(spark, f"{path}/store")
    texts = read_contents(spark, f"{path}/store/contents/*")
    ocr = field_text(parse_doc(F.col("content")), "ocr")
    return files.join(texts, "cid", "left").select("entity", "ver", "filename", ocr.alias("ocr"))


def _fetch_gate(files, attempt):
    kind = F.col("chunk_id").cast("long") % 7
    bad = (kind == 3) | ((kind == 5) & F.lit(attempt < 3))
    message = F.concat(F.lit("lost connection "), F.lit(str(attempt)))
    return files.where(bad).select("batch_id", "chunk_id", message.alias("message"))


@query
def process_failure(spark, sf_dir):
    """Some chunks cannot be fetched: one kind recovers at the third try, one never."""
    path = run_dir(spark, "process-failure")
    gates = {"FETCHING": _fetch_gate}
    report = _process(spark, sf_dir, path, Policy(cdn_host=CDN, pause=None), gates)
    return report.select(*_REPORT, "error")


@query
def process_status(spark, sf_dir):
    """The same chunks read after one round, and some that were never asked for."""
    path = run_dir(spark, "process-status")
    policy = Policy(cdn_host=CDN, max_rounds=1, pause=None)
    _process(spark, sf_dir, path, policy, {"FETCHING": _fetch_gate})
    unknown = table(spark, sf_dir, "supplier").select(
        F.lit("none").alias("batch_id"), _str("s_suppkey").alias("chunk_id")
    )
    wanted = _process_requests(spark, sf_dir).select("batch_id", "chunk_id").unionByName(unknown)
    status = run_status(spark, f"{path}/run", wanted)
    return status.withColumn("debug_log", F.array_join("debug_log", "\n"))


@query
def process_rerun(spark, sf_dir):
    """All chunks, then again those that were no full success; the newest report of each."""
    path = run_dir(spark, "process-rerun")
    policy = Policy(cdn_host=CDN)
    requests, store = _process_requests(spark, sf_dir), _process_store(spark, sf_dir, path)
    first = run_process(requests, store, asset_model, policy, f"{path}/run0", "w0")
    again = requests.join(
        first.where("status <> 'success'").select("batch_id", "chunk_id"), ["batch_id", "chunk_id"]
    )
    written = read_contents(spark, f"{store.path}/contents/*").drop("bucket")
    kept = ["entity", "tip", "ver"]
    grown = Store(
        versions=store.versions.select(kept).unionByName(read_versions(spark, store.path).select(kept)),
        components=store.components.unionByName(
            read_components(spark, store.path).select(store.components.columns)
        ),
        contents=store.contents.unionByName(written),
        path=store.path,
    )
    run_process(again, grown, asset_model, policy, f"{path}/run1", "w1")
    newest, _, _ = read_latest_reports(spark, f"{store.path}/reports")
    stored_reports = spark.read.parquet(f"{store.path}/reports/chunks")
    runs = stored_reports.groupBy("chunk_id").agg(F.count_distinct("run_id").alias("n_runs"))
    return newest.join(runs, "chunk_id").select(*_REPORT, "run_id", "n_runs")


# --- streams -----------------------------------------------------------------


@query
def stream_attempt_fold(spark, sf_dir):
    path = run_dir(spark, "stream-fold")
    keys = ["pi", "filename"]
    message = normalise_message(F.col("message"), F.col("outcome"), F.lit(False))
    attempts = fixtures.attempts_of(_parted_stream(spark, sf_dir, "events", "event_id"))
    attempts = attempts.withColumn("message", message)
    write_fold(attempts, path, f"{path}/checkpoint", keys, "event_id").awaitTermination()
    return folded(spark, state_table(attempts, path, keys))


@query
def stream_complete_chunks(spark, sf_dir):
    path = run_dir(spark, "stream-complete")
    keys = ["user_id", "day"]
    day = F.to_date("ts").cast("string").alias("day")
    totals = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", day)
        .agg(F.count(F.lit(1)).alias("total_refs"))
    )
    final = (
        _parted_stream(spark, sf_dir, "events", "event_id")
        .where(F.col("event_type").isin("view", "purchase"))
        .select("user_id", day)
    )
    write_complete_chunks(
        final, totals, f"{path}/out", f"{path}/checkpoint", keys
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@query
def stream_publish(spark, sf_dir):
    path = run_dir(spark, "stream-publish")
    updates = _parted_stream(spark, sf_dir, "orders", "o_orderkey").select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("update_id"),
        F.lit("streamed").alias("note"),
        F.lit(1).cast("long").alias("n_components"),
    )
    def build_files():
        files = fixtures.components(spark, sf_dir).where(is_ref(F.col("filename")))
        return files.select("entity", F.col("version_id").alias("update_id"), "filename", "cid")

    # built once and not once per micro-batch
    stored(spark, f"{path}/before/versions", lambda: _tips(spark, sf_dir))
    publish_batches(
        updates,
        lambda session: session.read.parquet(f"{path}/before/versions/rows"),
        stored(spark, f"{path}/before/components", build_files),
        path,
        f"{path}/checkpoint",
    ).awaitTermination()
    written = read_versions(spark, path, "entity long, ver long, tip string")
    files = spark.read.parquet(f"{path}/components/*").groupBy("entity", "ver").agg(
        F.count(F.lit(1)).alias("n_files")
    )
    return written.join(files, ["entity", "ver"], "left").fillna(0, ["n_files"])
