from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docflow.operators import batches, report
from docflow.operators.cost import cost_rollup, cost_usd
from docflow.operators.prompts import item_text, prompt_lines
from docflow.sources.sinks import write_reports
from docflow.sources.tables import read_reports
from tests.conftest import rows, values

KEYS = ["batch_id", "chunk_id", "pi"]
STATUSES = {
    "none": [],
    "pending": ["pending"],
    "ok": ["done", "skipped"],
    "some": ["done", "error"],
    "skip": ["skipped", "error"],
    "bad": ["error", "error"],
    "lost": ["done"],
}


@pytest.fixture(scope="module")
def refs(spark):
    flat = [
        ("b", "0", pi, f"f{i}", s, "boom" if i else "")
        for pi, states in STATUSES.items()
        for i, s in enumerate(states)
    ]
    return spark.createDataFrame(
        flat, "batch_id string, chunk_id string, pi string, filename string, status string, error string"
    ).cache()


@pytest.fixture(scope="module")
def results(spark, refs):
    pis = spark.createDataFrame(
        [("b", "0", pi, "t", 0 if pi == "ok" else 2, "CAS" if pi == "lost" else "") for pi in STATUSES],
        "batch_id string, chunk_id string, pi string, new_tip string, new_version long, entity_error string",
    )
    return report.pi_results(pis, refs, KEYS).cache()


def test_entity_status(results):
    got = {r.pi: (r.status, r.refs_completed, r.refs_failed) for r in results.collect()}
    assert got == {
        "none": ("success", 0, 0),
        "pending": ("success", 0, 0),
        "ok": ("success", 2, 0),
        "some": ("partial", 1, 1),
        "skip": ("partial", 1, 1),
        "bad": ("error", 0, 2),
        "lost": ("error", 1, 0),
    }


def chunk_rows(spark, *chunks):
    return spark.createDataFrame(
        chunks, "batch_id string, chunk_id string, phase string, global_error string"
    ).select(
        "*",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started_at"),
        F.when(F.col("phase") == "DONE", F.lit("2024-01-01 00:00:03").cast("timestamp")).alias(
            "completed_at"
        ),
    )


def test_chunk_report(spark, results):
    as_of = F.lit("2024-01-01 00:00:09").cast("timestamp")
    chunks = chunk_rows(spark, ("b", "0", "DONE", None), ("b", "1", "PROCESSING", None))
    assert rows(report.chunk_report(chunks, results, as_of), "chunk_id") == [
        ("b", "0", "partial", 10, 3, 4, 2, 3000, None),
        ("b", "1", "success", 0, 0, 0, 0, 9000, None),
    ]
    failed = chunk_rows(spark, ("b", "0", "ERROR", "lost"))
    assert report.chunk_report(failed, results, as_of).select("status", "error").first()[:] == (
        "error",
        "lost",
    )
    for names, status in ((["none", "ok"], "success"), (["bad", "lost"], "error")):
        some = results.where(F.col("pi").isin(names))
        assert report.chunk_report(chunks, some, as_of).where("chunk_id = '0'").first().status == status


def test_reports_come_back_as_flat_tables(spark, refs, results, tmp_path):
    as_of = F.lit("2024-01-01 00:00:09").cast("timestamp")
    chunks = chunk_rows(spark, ("b", "0", "DONE", None), ("b", "1", "DONE", None))
    summary = report.chunk_report(chunks, results, as_of)
    failed = report.failed_refs(refs, KEYS)
    assert {r.error for r in failed.collect()} == {"boom", "Unknown error"}
    path = str(tmp_path / "reports")
    write_reports(summary, results, failed, path)
    back = read_reports(spark, path)
    assert rows(back[0]) == rows(summary)
    assert rows(back[1]) == rows(report.entity_rows(results))
    assert rows(back[2]) == rows(failed)
    bad = {r.filename: r.error for r in back[2].where("pi = 'bad'").collect()}
    assert bad == {"f0": "Unknown error", "f1": "boom"}
    lines = batches.report_lines(back[1], back[2])
    assert lines.where("pi = 'ok'").count() == 1 and lines.where("pi = 'bad'").count() == 2


@pytest.mark.parametrize("size", [99, 101, 999, 1001])
def test_reports_have_one_form_at_any_size(spark, tmp_path, size):
    refs = spark.range(size).select(
        F.lit("b").alias("batch_id"),
        F.lit("0").alias("chunk_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("pi"),
        F.concat(F.lit("f"), F.col("id")).alias("filename"),
        F.lit("error").alias("status"),
        F.lit("e").alias("error"),
    )
    pis = refs.select(*KEYS).distinct().select(
        "*", F.lit("t").alias("new_tip"), F.lit(1).cast("long").alias("new_version"),
        F.lit(None).cast("string").alias("entity_error"),
    )
    results = report.pi_results(pis, refs, KEYS)
    summary = report.chunk_report(chunk_rows(spark, ("b", "0", "DONE", None)), results, F.current_timestamp())
    path = str(tmp_path / "reports")
    write_reports(summary, results, report.failed_refs(refs, KEYS), path)
    chunks, entities, failed = read_reports(spark, path)
    assert (chunks.count(), failed.count()) == (1, size)
    assert chunks.first().failed == size == entities.agg(F.sum("refs_failed")).first()[0]
    assert entities.columns == [*KEYS, "status", "new_tip", "new_version", "refs_completed", "refs_failed"]


def test_status_reads(spark, refs):
    chunks = chunk_rows(spark, ("b", "0", "PROCESSING", None), ("b", "1", "ERROR", "x"), ("b", "2", "DONE", None))
    wanted = spark.createDataFrame([("b", str(n)) for n in range(4)], "batch_id string, chunk_id string")
    got = report.chunk_status(wanted, chunks, report.chunk_progress(refs))
    assert rows(got.select("chunk_id", "status", "total_refs", "pending"), "chunk_id") == [
        ("0", "processing", 10, 1),
        ("1", "error", 0, 0),
        ("2", "done", 0, 0),
        ("3", "not_found", None, None),
    ]
    assert rows(report.complete_chunks(refs, chunks)) == [("b", "1", 0), ("b", "2", 0)]


def test_latest_run(spark):
    df = spark.createDataFrame([("b", "0", 1, "x"), ("b", "0", 2, "y"), ("b", "1", 1, "z")], "batch_id string, chunk_id string, run_id long, v string")
    got = report.latest_run(df, ["batch_id", "chunk_id"], "run_id")
    assert sorted(r.v for r in got.collect()) == ["y", "z"]


def test_batch_rollup_and_apply(spark, refs, results):
    sent = spark.createDataFrame(
        [("b", "0"), ("b", "1"), ("c", "0"), ("c", "1")], "batch_id string, chunk_id string"
    )
    reports = spark.createDataFrame(
        [("b", "0", "partial"), ("b", "1", "error"), ("c", "0", "success")],
        "batch_id string, chunk_id string, status string",
    )
    assert rows(batches.batch_rollup(sent, reports)) == [("b", 2, 1, 1, True), ("c", 2, 1, 0, False)]

    nodes = refs.select("pi", "filename").unionByName(
        spark.createDataFrame([("stranger", "f0")], "pi string, filename string")
    )
    entities, failed = report.entity_rows(results), report.failed_refs(refs, KEYS)
    applied = batches.apply_report(nodes, entities, failed).cache()
    got = {(r.pi, r.filename): (r.ocr_complete, r.ocr_error) for r in applied.collect()}
    assert got["some", "f0"] == (True, None)
    assert got["some", "f1"] == (False, "boom")
    assert got["pending", "f0"] == (True, None)
    assert got["stranger", "f0"] == (False, None)
    states = {r.pi: r.ocr_complete for r in batches.node_states(applied).collect()}
    assert states == {**dict.fromkeys(("pending", "ok", "some", "skip", "bad", "lost"), True), "stranger": False}


def test_cost_is_exact(spark):
    cost = values(spark, cost_usd(F.lit(1_000_000), F.lit(2_000_000)))
    assert cost == Decimal("0.31")
    assert values(spark, cost_usd(F.lit(1), F.lit(0))) == Decimal("0.00000003")
    calls = spark.range(10).select(
        F.lit("s").alias("source"), F.lit(7).cast("long").alias("prompt_tokens"),
        F.col("id").alias("completion_tokens"),
    )
    assert rows(cost_rollup(calls, ["source"])) == [("s", 10, 70, 45, Decimal("0.0000084"))]


def test_the_newest_report_of_a_node_counts(spark):
    nodes = spark.createDataFrame([("n", "f0"), ("n", "f1")], "pi string, filename string")
    kind = "batch_id string, chunk_id string, pi string, new_tip string, new_version long"
    entities = spark.createDataFrame([("b", "0", "n", "zzz_old", 2), ("b", "1", "n", "aaa_new", 3)], kind)
    failed = spark.createDataFrame(
        [("b", "0", "n", "f0", "x"), ("b", "1", "n", "f0", "y")],
        "batch_id string, chunk_id string, pi string, filename string, error string",
    )
    got = batches.apply_report(nodes, entities, failed)
    assert rows(got.select("filename", "new_tip", "new_version", "ocr_error")) == [
        ("f0", "aaa_new", 3, "y"),
        ("f1", "aaa_new", 3, None),
    ]


@pytest.mark.parametrize("first", [0, 4095, 4096])
def test_prompts_start_with_their_head(spark, first):
    df = spark.range(first, first + 25).select(
        F.lit("g").alias("group"), F.col("id").alias("n"),
        item_text(F.lit("ocr"), F.concat(F.lit("s"), F.col("id")), F.lit("text")).alias("item"),
    ).repartition(5)
    got = rows(prompt_lines(df, ["group"], "n", F.col("group"), F.lit(2)), "piece")
    assert got[0] == ("g", 0, "Directory: g (depth 2)")
    assert got[1:] == [("g", i + 1, f"## OCR: s{first + i}\ntext") for i in range(25)]
