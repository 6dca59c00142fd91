"""Status reads of a run at any time, current streaks, cost from the log, kept results."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from docflow.operators.contents import extract_new
from docflow.operators.fold import backoff_streaks, current_streak
from docflow.plans.enrich import Policy, call_cost
from docflow.plans.extract import Result, extract_once
from docflow.plans.process import Store, process_chunks
from docflow.plans.status import run_status
from docflow.sources.keyed import KeyedTable
from tests.conftest import rows

HOST = "cdn.example.org"


def flaky():
    """Limited in the first two rounds; one asset has a bad format."""

    def call(requests):
        out = []
        for r in requests:
            if "BAD" in r.url:
                out.append(Result(error="corrupted image", prompt_tokens=7))
            elif r.seq < 3:
                out.append(Result(error="429"))
            else:
                out.append(Result(text="t", prompt_tokens=10, completion_tokens=2))
        return out

    return call


def store_of(spark, path):
    def asset(name):
        return json.dumps({"url": f"https://{HOST}/asset/{name}"})

    return Store(
        spark.createDataFrame(
            [("e1", 1, "t1"), ("e2", 1, "t2"), ("e3", 1, "t3")], "entity string, ver long, tip string"
        ),
        spark.createDataFrame(
            [
                ("e1", 1, "a.ref.json", "c1"),
                ("e1", 1, "b.ref.json", "bad"),
                ("e2", 1, "a.ref.json", "bad"),
                ("e3", 1, "a.ref.json", "c1"),
            ],
            "entity string, ver long, filename string, cid string",
        ),
        spark.createDataFrame(
            [("c1", asset("A1")), ("bad", asset("BAD"))], "cid string, content string"
        ),
        path,
    )


def test_status_at_any_time(spark, tmp_path):
    requests = spark.createDataFrame(
        [("b", "0", ["e1"]), ("b", "1", ["e2"]), ("b", "2", ["e3"])],
        "batch_id string, chunk_id string, pis array<string>",
    )
    wanted = spark.createDataFrame(
        [("b", "0"), ("b", "0"), ("b", "1"), ("b", "2"), ("x", "0")], "batch_id string, chunk_id string"
    )
    store, run = store_of(spark, str(tmp_path / "store")), str(tmp_path / "run")

    def gate(files, attempt):
        bad = files.where((F.col("chunk_id") == "2") | ((F.col("chunk_id") == "1") & F.lit(attempt == 1)))
        return bad.select("batch_id", "chunk_id", F.lit(f"lost {attempt}").alias("message"))

    def read():
        return {(r.batch_id, r.chunk_id): r for r in run_status(spark, run, wanted).collect()}

    def step(max_rounds=None):
        policy = Policy(cdn_host=HOST, max_rounds=max_rounds, pause=None)
        process_chunks(requests, store, flaky, policy, run, "w0", {"FETCHING": gate})

    before = read()
    assert len(before) == 4 and {r.status for r in before.values()} == {"not_found"}

    step(2)
    now = read()
    zero, one, lost, gone = (now[k] for k in (("b", "0"), ("b", "1"), ("b", "2"), ("x", "0")))
    assert (zero.status, zero.phase, zero.pending, zero.failed) == ("processing", "PROCESSING", 1, 1)
    assert (zero.streak, zero.delay_ms, zero.failures) == (2, 2000, 0)
    assert [line.split(": ")[0] for line in zero.debug_log] == [
        "1 e1/a.ref.json", "1 e1/b.ref.json", "2 e1/a.ref.json"
    ]
    assert (one.phase, one.failures, one.last_failure, one.error) == ("PUBLISHING", 1, "lost 1", None)
    assert (lost.status, lost.phase, lost.failures, lost.error) == ("error", "ERROR", 5, "lost 5")
    assert (lost.total_refs, lost.streak, lost.delay_ms, lost.debug_log) == (0, 0, None, None)
    assert (gone.status, gone.phase, gone.total_refs, gone.streak) == ("not_found", None, None, None)

    step()
    done = read()[("b", "0")]
    assert (done.status, done.completed, done.failed, done.pending) == ("done", 1, 1, 0)
    assert (done.streak, done.delay_ms, len(done.debug_log)) == (0, None, 3)
    assert len(run_status(spark, run, wanted, lines=1).where("chunk_id = '0'").first().debug_log) <= 1

    cost = rows(call_cost(spark, f"{run}/log"), "chunk_id")
    assert cost == [
        ("b", "0", 4, 17, 2, Decimal("0.00000079")),
        ("b", "1", 1, 7, 0, Decimal("0.00000021")),
    ]


def test_current_streak_is_the_last_of_the_streaks(spark):
    steps = spark.range(400).select(
        (F.col("id") % 7).alias("chunk"),
        F.col("id").alias("step"),
        (F.xxhash64("id") % 3 != 0).alias("rate_limited"),
    )
    every = backoff_streaks(steps, ["chunk"], "step", segment_rows=50)
    want = every.groupBy("chunk").agg(F.max_by("streak", "step").alias("streak"))
    got = current_streak(steps, ["chunk"], "step")
    assert rows(got, "chunk") == rows(want.select("chunk", F.col("streak").cast("long")), "chunk")
    assert current_streak(steps.limit(0), ["chunk"], "step").count() == 0


def test_both_calls_of_an_attempt_are_charged(spark):
    def model():
        def call(requests):
            return [
                Result(text="t", prompt_tokens=5, completion_tokens=1)
                if r.url == "small"
                else Result(error="400 Failed to download image", prompt_tokens=3)
                for r in requests
            ]

        return call

    todo = spark.createDataFrame([(1, "big", "small"), (2, "big", None)], "id long, primary string, fallback string")
    got = extract_once(todo, model, ["id"])
    columns = ["id", "tokens", "prompt_tokens", "completion_tokens", "on_fallback"]
    assert rows(got.select(*columns), "id") == [(1, 6, 8, 1, True), (2, None, 3, 0, False)]


def test_results_of_former_calls_are_reused(spark, tmp_path):
    sent = []

    def extract(distinct):
        texts = sorted(r.text for r in distinct.collect())
        sent.append(texts)
        return distinct.where("text <> 'fails'").select("cid", F.upper("text").alias("out"))

    results = KeyedTable(str(tmp_path / "results"), ["cid"], "cid string, out string", 4)

    def call(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        return rows(extract_new(df, "text", extract, results).select("id", "out", "reused"), "id")

    assert call("a", "b", "a", None, "fails", "") == [
        (0, "A", False), (1, "B", False), (2, "A", False), (3, None, None), (4, None, None), (5, "", False)
    ]
    assert call("b", "c", "fails") == [(0, "B", True), (1, "C", False), (2, None, None)]
    assert call("c", "b") == [(0, "C", True), (1, "B", True)]
    assert call() == []
    assert sent == [["", "a", "b", "fails"], ["c", "fails"], [], []]
