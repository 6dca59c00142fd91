import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docflow.operators.versions import entity_tip
from docflow.plans.enrich import Policy
from docflow.plans.extract import Result
from docflow.plans.process import Store, accept_requests, process_chunks
from docflow.session import durable
from docflow.sources.sinks import write_reports
from docflow.sources.tables import (
    read_components,
    read_contents,
    read_latest_reports,
    read_reports,
    read_versions,
)
from tests.conftest import rows

HOST = "cdn.example.org"


def model():
    def call(requests):
        return [
            Result(error="corrupted image") if "BAD" in r.url else Result(text=f"text {r.url[-10:]}", tokens=1)
            for r in requests
        ]

    return call


def url(asset):
    return json.dumps({"url": f"https://{HOST}/asset/{asset}", "keep": [1]})


def test_from_requests_to_versions_and_reports(spark, tmp_path):
    versions = spark.createDataFrame(
        [("e1", 1, "t1"), ("e2", 1, "t2"), ("e3", 4, "t3")], "entity string, ver long, tip string"
    )
    components = spark.createDataFrame(
        [
            ("e1", 1, "a.ref.json", "c1"),
            ("e1", 1, "b.ref.json", "c2"),
            ("e1", 1, "m.json", "c1"),
            ("e2", 1, "a.ref.json", "bad"),
            ("e3", 4, "a.ref.json", "c3"),
        ],
        "entity string, ver long, filename string, cid string",
    )
    contents = spark.createDataFrame(
        [
            ("c1", url("A1")),
            ("c2", json.dumps({"url": "u", "ocr": "known"})),
            ("c3", url("A3")),
            ("bad", url("BAD")),
        ],
        "cid string, content string",
    )
    at = datetime(2024, 1, 1)
    requests = spark.createDataFrame(
        [
            ("r1", at, "b", "0", ["e1", "e2", "gone"]),
            ("r2", at, "b", "1", ["e1", "e3"]),
            ("r3", at, "b", "2", ["e1", "e1"]),
            ("r4", at, "b", "3", ["e1"]),
            ("r5", at, "", "4", ["e1"]),
            ("r6", at, "b", "5", []),
        ],
        "request_id string, received_at timestamp, batch_id string, chunk_id string, pis array<string>",
    )
    busy = spark.createDataFrame([("b", "3", "PROCESSING")], "batch_id string, chunk_id string, phase string")
    run, answers = accept_requests(requests, busy)
    assert rows(answers.select("request_id", "status"), "request_id") == [
        ("r1", "accepted"),
        ("r2", "accepted"),
        ("r3", "duplicate_pi"),
        ("r4", "already_processing"),
        ("r5", "rejected"),
        ("r6", "accepted"),
    ]

    store = Store(versions, components, contents, str(tmp_path / "store"))
    report = process_chunks(run, store, model, Policy(cdn_host=HOST), str(tmp_path / "run"), "w1")
    got = report.select("chunk_id", "status", "total_refs", "completed", "failed", "skipped")
    assert rows(got, "chunk_id") == [
        ("0", "partial", 3, 1, 1, 1),
        ("1", "success", 3, 2, 0, 1),
        ("5", "success", 0, 0, 0, 0),
    ]

    written = read_versions(spark, store.path)
    assert rows(written.select("entity", "ver", "note"), "entity", "ver") == [
        ("e1", 2, "OCR: Updated 2 refs"),
        ("e1", 3, "OCR: Updated 2 refs"),
        ("e3", 5, "OCR: Updated 1 refs"),
    ]
    tips = {r.ver: (r.prev_tip, r.tip) for r in written.where("entity = 'e1'").collect()}
    assert tips[2][0] == "t1"
    assert tips[3][0] == tips[2][1]
    both = entity_tip(versions.unionByName(written.select("entity", "ver", "tip")))
    assert dict(rows(both.select("entity", "ver"))) == {"e1": 3, "e2": 1, "e3": 5}

    files = read_components(spark, store.path).join(read_contents(spark, f"{store.path}/contents/*"), "cid")
    docs = {(r.entity, r.ver, r.filename): json.loads(r.content) for r in files.collect()}
    assert len(docs) == 5
    assert docs["e1", 2, "b.ref.json"] == {"url": "u", "ocr": "known"}
    doc = docs["e3", 5, "a.ref.json"]
    assert doc["keep"] == [1]
    assert doc["ocr"] == "text /A3/medium"

    # the same run again, now with the new versions in the store
    grown = versions.unionByName(written.select("entity", "ver", "tip"))
    again = Store(grown, components, contents, store.path)
    report = process_chunks(run, again, model, Policy(cdn_host=HOST), str(tmp_path / "run"), "w1")
    assert report.count() == 3
    assert rows(read_versions(spark, store.path)) == rows(written)

    _, entities, _ = read_reports(spark, f"{store.path}/reports")
    entries = {(r.chunk_id, r.pi): (r.status, r.new_version) for r in entities.collect()}
    assert entries == {
        ("0", "e1"): ("success", 2),
        ("0", "e2"): ("error", None),
        ("0", "gone"): ("success", None),
        ("1", "e1"): ("success", 3),
        ("1", "e3"): ("success", 5),
    }


def test_a_run_with_pending_refs_is_neither_published_nor_reported(spark, tmp_path):
    busy = {"on": True}

    def limited():
        on = busy["on"]
        return lambda requests: [Result(error="429") if on else Result(text="t", tokens=1) for _ in requests]

    kind = "entity string, ver long, filename string, cid string"
    store = Store(
        spark.createDataFrame([("e1", 1, "t1")], "entity string, ver long, tip string"),
        spark.createDataFrame([("e1", 1, "a.ref.json", "c1")], kind),
        spark.createDataFrame([("c1", url("A1"))], "cid string, content string"),
        str(tmp_path / "store"),
    )
    requests = spark.createDataFrame([("b", "0", ["e1"])], "batch_id string, chunk_id string, pis array<string>")
    run = str(tmp_path / "run")
    for _ in range(2):
        got = process_chunks(requests, store, limited, Policy(cdn_host=HOST, max_rounds=2, pause=None), run, "w")
        assert rows(got.select("status", "total_refs", "completed", "failed")) == [("processing", 1, 0, 0)]
    assert not (tmp_path / "store").exists() and not (tmp_path / "run" / "reported").exists()
    busy["on"] = False
    got = process_chunks(requests, store, limited, Policy(cdn_host=HOST, max_rounds=9, pause=None), run, "w")
    assert rows(got.select("status", "total_refs", "completed", "failed")) == [("success", 1, 1, 0)]
    assert rows(read_versions(spark, store.path).select("entity", "ver")) == [("e1", 2)]


def two_chunks(spark, tmp_path):
    kind = "entity string, ver long, filename string, cid string"
    store = Store(
        spark.createDataFrame([("e1", 1, "t1"), ("e2", 1, "t2")], "entity string, ver long, tip string"),
        spark.createDataFrame([("e1", 1, "a.ref.json", "c1"), ("e2", 1, "a.ref.json", "c1")], kind),
        spark.createDataFrame([("c1", url("A1"))], "cid string, content string"),
        str(tmp_path / "store"),
    )
    requests = spark.createDataFrame(
        [("b", "0", ["e1"]), ("b", "1", ["e2"])], "batch_id string, chunk_id string, pis array<string>"
    )
    return requests, store


@pytest.mark.parametrize("phase", ["FETCHING", "PROCESSING", "PUBLISHING"])
@pytest.mark.parametrize("tries", [2, 99])
def test_one_chunk_fails_and_the_other_goes_on(spark, tmp_path, phase, tries):
    requests, store = two_chunks(spark, tmp_path)
    seen, waits = [], []

    def gate(found, attempt):
        seen.append((attempt, {r.chunk_id for r in found.select("chunk_id").collect()}))
        bad = found.where((F.col("chunk_id") == "0") & F.lit(attempt <= tries))
        return bad.select("batch_id", "chunk_id", F.lit(f"down {attempt}").alias("message"))

    policy, run = Policy(cdn_host=HOST, pause=waits.append), str(tmp_path / "run")
    report = process_chunks(requests, store, model, policy, run, "w", {phase: gate})
    got = {r.chunk_id: (r.status, r.completed, r.error) for r in report.collect()}
    lost = tries > 5
    assert got == {"0": ("error", 0, "down 5") if lost else ("success", 1, None), "1": ("success", 1, None)}
    versions = rows(read_versions(spark, store.path).select("entity", "ver"))
    assert versions == ([] if lost else [("e1", 2)]) + [("e2", 2)]
    assert seen == [(1, {"0", "1"})] + [(n, {"0"}) for n in range(2, 6 if lost else 4)]
    assert waits == ([2, 4, 8, 16] if lost else [2, 4])
    # a finished run changes nothing and waits for nothing
    again = process_chunks(requests, store, model, policy, run, "w", {phase: gate})
    assert rows(again) == rows(report) and len(waits) == (4 if lost else 2)


def test_failures_of_all_phases_add_up(spark, tmp_path):
    requests, store = two_chunks(spark, tmp_path)

    def gate(found, attempt):
        bad = found.where((F.col("chunk_id") == "0") & F.lit(attempt <= 3))
        return bad.select("batch_id", "chunk_id", F.lit(f"down {attempt}").alias("message"))

    policy, run = Policy(cdn_host=HOST, pause=None), str(tmp_path / "run")
    gates = {"FETCHING": gate, "PUBLISHING": gate}
    report = process_chunks(requests, store, model, policy, run, "w", gates)
    assert rows(report.select("chunk_id", "status", "error")) == [("0", "error", "down 2"), ("1", "success", None)]


def test_runs_are_kept_apart(spark, tmp_path):
    requests, store = two_chunks(spark, tmp_path)
    policy = Policy(cdn_host=HOST, pause=None)
    process_chunks(requests, store, model, policy, str(tmp_path / "r1"), "001")
    process_chunks(requests.where("chunk_id = '1'"), store, model, policy, str(tmp_path / "r2"), "002")
    path = f"{store.path}/reports"
    chunks, entities, failed = read_latest_reports(spark, path)
    assert rows(chunks.select("chunk_id", "run_id")) == [("0", "001"), ("1", "002")]
    assert rows(entities.select("chunk_id", "pi", "run_id")) == [("0", "e1", "001"), ("1", "e2", "002")]
    assert rows(failed) == []
    assert spark.read.parquet(f"{path}/entities").count() == 3
    only = entities.where("chunk_id = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run_id" in only or "PartitionFilters: [isnotnull(run_id" in only
    # a run written again replaces its own folder alone
    want = [rows(chunks), rows(entities), []]
    mine = [durable(t.where("run_id = '001'")) for t in (chunks, entities, failed)]
    write_reports(*[t.limit(0) for t in mine], path=path, run_id="003")
    write_reports(*mine, path=path, run_id="001")
    again = [rows(t) for t in read_latest_reports(spark, path)]
    assert again == want
    assert spark.read.parquet(f"{path}/entities").count() == 2


def test_the_tables_before_a_run_are_built_once_for_all_its_calls(spark, tmp_path, monkeypatch):
    from docflow.suite import queries

    spark.createDataFrame([(1,), (2,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    tips = spark.createDataFrame([(1, "t1", 4)], "entity long, tip string, ver long")
    files = spark.createDataFrame([(1, "a", "c1"), (2, "a", "c2")], "entity long, filename string, cid string")
    built = []
    monkeypatch.setattr(queries, "_tips", lambda *a: built.append("tips") or tips)
    monkeypatch.setattr(queries, "_manifest", lambda *a: built.append("files") or files)
    for _ in range(2):
        store = queries._process_store(spark, str(tmp_path), str(tmp_path / "run"))
        assert [tuple(r) for r in store.versions.collect()] == [("1", "t1", 4)]
        assert [tuple(r) for r in store.components.collect()] == [("1", "a", "c1", 4)]
        assert store.contents.count() == 2
    assert built == ["tips", "files"]
