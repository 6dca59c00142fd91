import json

import pytest
from pyspark.sql import functions as F

from docflow.operators.fold import attempt_fold
from docflow.plans import enrich as loop
from docflow.plans.enrich import Policy, enrich, enriched_refs, read_log, run_rounds
from docflow.plans.extract import Request, Result, extract_once
from docflow.schema import REF_KEYS
from tests.conftest import rows

HOST = "cdn.example.org"
POLICY = Policy(cdn_host=HOST, max_rounds=6, pause=None)


def scripted():
    """Plays the script in the payload: one reply per attempt, the last repeats.
    A reply is ``text:...``, ``raise:...`` or an error; ``a|b`` gives b to the
    fallback address."""

    def call(requests: list[Request]) -> list[Result]:
        out = []
        for r in requests:
            steps = json.loads(r.payload)
            step = steps[min(r.seq, len(steps)) - 1]
            if "|" in step:
                step = step.split("|")[0 if r.url.endswith("/medium") else 1]
            if step.startswith("raise:"):
                raise RuntimeError(step[6:])
            out.append(Result(text=step[5:], tokens=5) if step.startswith("text:") else Result(error=step))
        return out

    return call


DOWNLOAD = "400 failed to download"
SCRIPTS = {
    "ok": ["text:hello"],
    "empty": ["text:"],
    "limited": ["429", "429", "text:late"],
    "mixed": ["429", "429", "timeout"],
    "timeout": ["timeout"],
    "twice": ["timeout", "timeout", "text:third"],
    "format": ["Invalid URL given"],
    "fallback": [f"{DOWNLOAD}|text:small"],
    "fb_limited": [f"{DOWNLOAD}|rate limit", f"{DOWNLOAD}|text:later"],
    "fb_format": [f"{DOWNLOAD}|corrupted image"],
    "fb_download": [f"{DOWNLOAD}|{DOWNLOAD}"],
    "forever": ["429"],
    "raises": ["raise:broken", "text:fixed"],
}
EXPECTED = {
    "ok": ("done", 0, None, 5),
    "empty": ("done", 0, None, 0),
    "limited": ("done", 2, None, 4),
    "mixed": ("error", 3, "Failed after 3 retries: OCR failed: timeout", None),
    "timeout": ("error", 3, "Failed after 3 retries: OCR failed: timeout", None),
    "twice": ("done", 2, None, 5),
    "format": ("error", 0, "Permanent OCR failure: Invalid URL given", None),
    "fallback": ("done", 0, None, 5),
    "fb_limited": ("done", 1, None, 5),
    "fb_format": ("error", 0, "Permanent OCR failure on fallback: corrupted image", None),
    "fb_download": (
        "error", 3, f"Failed after 3 retries: OCR fallback failed: {DOWNLOAD}", None,
    ),
    "forever": ("pending", 6, None, None),
    "raises": ("done", 1, None, 5),
    "old": ("skipped", 0, None, 3),
    "gone": ("error", 0, "Ref data not found for: gone", None),
}


@pytest.fixture(scope="module")
def refs(spark):
    flat = [
        ("b", "0", "p", name, f"https://{HOST}/asset/A1", json.dumps({"url": "u", "n": 1}), json.dumps(s))
        for name, s in SCRIPTS.items()
    ]
    flat.append(("b", "0", "p", "old", "u", json.dumps({"url": "u", "ocr": "a\U0001f600"}), "[]"))
    flat.append(("b", "0", "p", "gone", "u", None, "[]"))
    columns = "batch_id string, chunk_id string, pi string, filename string, cdn_url string, ref_data_json string, script string"
    return spark.createDataFrame(flat, columns).repartition(3).cache()


def summary(df):
    got = df.select("filename", "status", "retry_count", "error", "ocr_text_length")
    return {r[0]: tuple(r[1:]) for r in got.collect()}


# one request per call: a raising model then fails that request only
def test_all_paths(spark, refs, tmp_path):
    policy = Policy(cdn_host=HOST, max_rounds=6, call_size=1, pause=None)
    done = enrich(refs, scripted, str(tmp_path), policy, payload="script").cache()
    assert summary(done) == EXPECTED
    docs = {r.filename: r.content for r in done.collect()}
    assert json.loads(docs["ok"]) == {"url": "u", "n": 1, "ocr": "hello"}
    assert json.loads(docs["empty"])["ocr"] == ""
    assert json.loads(docs["old"]) == {"url": "u", "ocr": "a\U0001f600"}
    assert docs["timeout"] is None
    log = read_log(spark, str(tmp_path))
    assert log.groupBy(*REF_KEYS, "seq").count().where("count > 1").count() == 0
    # the long form of the fold agrees with the loop's own bookkeeping
    folded = attempt_fold(log)
    assert {r.filename: r.status for r in folded.collect()} == {k: v[0] for k, v in EXPECTED.items()}


def test_a_killed_run_goes_on_where_it_stopped(spark, refs, tmp_path, monkeypatch):
    few = refs.where(F.col("filename").isin("ok", "limited", "timeout", "old"))
    write, stop_at = loop._write_slice, 2
    calls = []

    def failing(attempts, log_path, number, part=0):
        if number == stop_at:
            # part of the round is on disk, but the round is not flagged done
            attempts.limit(1).write.mode("overwrite").parquet(f"{log_path}/half")
            raise KeyboardInterrupt
        calls.append(number)
        write(attempts, log_path, number, part)

    monkeypatch.setattr(loop, "_write_slice", failing)
    with pytest.raises(KeyboardInterrupt):
        run_rounds(few, scripted, str(tmp_path), POLICY, payload="script")
    assert calls == [0, 1]
    stop_at = None
    done = enrich(few, scripted, str(tmp_path), POLICY, payload="script")
    assert summary(done) == {k: EXPECTED[k] for k in ("ok", "limited", "timeout", "old")}
    assert calls == [0, 1, 2, 3]
    waits = []
    patient = Policy(cdn_host=HOST, pause=waits.append)
    run_rounds(few, scripted, str(tmp_path), patient, payload="script")
    assert calls == [0, 1, 2, 3] and waits == []


def many(spark, tmp_path, n=40):
    path = str(tmp_path / "refs")
    spark.range(n).select(
        F.lit("b").alias("batch_id"), F.lit("0").alias("chunk_id"), F.lit("e").alias("pi"),
        F.concat(F.lit("f"), "id").alias("filename"), F.lit(f"https://{HOST}/asset/01AB/large").alias("cdn_url"),
        F.lit('{"url": "u"}').alias("ref_data_json"),
        F.concat(F.lit("f"), "id", F.when(F.col("id") % 4 == 0, " limited").otherwise("")).alias("script"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def noting(path):
    """Writes each call into a file; those marked are rate limited in rounds 1 and 2."""

    def load():
        def call(requests):
            out = []
            for r in requests:
                with open(path, "a") as log:
                    log.write(f"{r.seq} {r.payload.split()[0]}\n")
                limited = r.payload.endswith("limited") and r.seq < 3
                out.append(Result(error="429") if limited else Result(text="t", tokens=1))
            return out

        return call

    return load


def test_a_job_lost_late_in_a_round_repeats_only_open_slices(spark, tmp_path, monkeypatch):
    refs, notes = many(spark, tmp_path), str(tmp_path / "calls")
    policy = Policy(cdn_host=HOST, pause=None, slice_refs=8, concurrency=2, threads=1)
    write, lost, written = loop._write_slice, [(1, 3)], []

    def losing(attempts, log_path, number, part=0):
        if (number, part) in lost:
            attempts.count()  # the calls are made, but their results are lost
            raise KeyboardInterrupt
        written.append((number, part))
        write(attempts, log_path, number, part)

    monkeypatch.setattr(loop, "_write_slice", losing)
    log = str(tmp_path / "log")
    with pytest.raises(KeyboardInterrupt):
        run_rounds(refs, noting(notes), log, policy, payload="script")
    before = open(notes).read().split("\n")[:-1]
    kept = {r.filename for r in spark.read.schema("filename string").parquet(f"{log}/attempts/round=1/*").collect()}
    assert written == [(0, 0), (1, 0), (1, 1), (1, 2)] and 0 < len(kept) < 40
    lost.clear()
    assert run_rounds(refs, noting(notes), log, policy, payload="script").finished
    after = open(notes).read().split("\n")[:-1][len(before) :]
    # what was kept is not called again in round 1, all else is
    assert {c.split()[1] for c in after if c.startswith("1 ")} == {f"f{i}" for i in range(40)} - kept
    assert len(after) == len(set(after))
    limited = {f"f{i}" for i in range(0, 40, 4)}
    assert {c for c in after if c[0] in "23"} == {f"{n} {f}" for n in (2, 3) for f in limited}
    status = {r.filename: (r.status, r.retry_count) for r in loop.ref_status(spark, log).collect()}
    assert status == {f"f{i}": ("done", 0 if i % 4 else 2) for i in range(40)}


def test_later_rounds_read_the_last_round_alone(spark, tmp_path):
    """Without a payload the refs are not read again: they may even change."""
    refs, log = many(spark, tmp_path).drop("script"), str(tmp_path / "log")

    def model():
        return lambda requests: [Result(error="429") if r.seq < 2 else Result(text=r.url) for r in requests]

    assert not run_rounds(refs, model, log, Policy(cdn_host=HOST, pause=None, max_rounds=1)).finished
    other = refs.withColumn("cdn_url", F.lit("changed"))
    assert run_rounds(other, model, log, Policy(cdn_host=HOST, pause=None)).finished
    texts = {r.text for r in read_log(spark, log, 2).collect()}
    assert texts == {f"https://{HOST}/asset/01AB/medium"}


def test_pauses_grow_with_the_streak(spark, refs, tmp_path):
    waits = []
    policy = Policy(cdn_host=HOST, max_rounds=3, pause=waits.append)
    run_rounds(refs.where("filename = 'forever'"), scripted, str(tmp_path), policy, payload="script")
    assert [0.75 * b <= w <= 1.25 * b for w, b in zip(waits, (1, 2, 4), strict=True)] == [True] * 3


def test_a_failing_model_never_fails_the_task(spark):
    def broken():
        def call(requests):
            if len(requests) > 1:
                return []
            raise ValueError("no luck")

        return call

    todo = spark.range(3).select("id", F.lit("u").alias("primary"), F.lit(None).cast("string").alias("fallback"))
    got = extract_once(todo.coalesce(1), broken, ["id"], call_size=2, concurrency=1)
    assert {r.message for r in got.collect()} == {"OCR failed: no luck"}
    assert rows(got.select("seq", "outcome").distinct()) == [(1, "transient")]


def test_one_raising_request_fails_alone(spark):
    def picky():
        def call(requests):
            if any(r.url == "u7" for r in requests):
                raise ValueError("Invalid image format")
            return [Result(text=r.url) for r in requests]

        return call

    todo = spark.range(16).select(
        "id", F.concat(F.lit("u"), "id").alias("primary"), F.lit(None).cast("string").alias("fallback")
    )
    got = extract_once(todo, picky, ["id"], call_size=16, concurrency=1).collect()
    assert {r.id: r.outcome for r in got} == {i: "permanent" if i == 7 else "done" for i in range(16)}


def test_a_model_with_a_key_is_loaded_once_per_worker(spark, tmp_path):
    path = str(tmp_path / "loads")

    def counted():
        with open(path, "a") as log:
            log.write("x")
        return lambda requests: [Result(text="t") for _ in requests]

    todo = spark.range(64).select(
        "id", F.lit("u").alias("primary"), F.lit(None).cast("string").alias("fallback")
    )
    assert extract_once(todo, counted, ["id"], concurrency=32, model_key="m1").count() == 64
    with open(path) as log:
        assert 1 <= len(log.read()) < 32


def test_pending_refs_stay_pending_at_the_limit(spark, refs, tmp_path):
    few = refs.where(F.col("filename").isin("ok", "timeout", "forever"))
    policy = Policy(cdn_host=HOST, max_rounds=2, pause=None)
    assert run_rounds(few, scripted, str(tmp_path), policy, payload="script") == (2, False)
    got = summary(enriched_refs(few, str(tmp_path)))
    assert {k: v[:2] for k, v in got.items()} == {
        "ok": ("done", 0), "timeout": ("pending", 2), "forever": ("pending", 2)
    }
    some = few.where("filename != 'forever'")
    assert run_rounds(some, scripted, str(tmp_path), policy, payload="script").number >= 3


def test_slices_are_cut_into_few_files_and_all_run(spark, tmp_path):
    refs, log = many(spark, tmp_path), str(tmp_path / "log")
    policy = Policy(cdn_host=HOST, pause=None, slice_refs=8)
    refs.repartition(4).write.parquet(str(tmp_path / "dealt"))
    refs = spark.read.parquet(str(tmp_path / "dealt"))
    assert run_rounds(refs, noting(str(tmp_path / "calls")), log, policy, payload="script").finished
    cut = sorted((tmp_path / "log/todo/round=1/rows").glob("slice=*"))
    assert len(cut) > 1 and all(len(list(c.glob("*.parquet"))) == 1 for c in cut)
    status = {r.filename: (r.status, r.retry_count) for r in loop.ref_status(spark, log).collect()}
    assert status == {f"f{i}": ("done", 0 if i % 4 else 2) for i in range(40)}
    kept = read_log(spark, log, 1).select("filename")
    assert kept.count() == kept.distinct().count() == 40


def test_a_document_is_merged_once(spark, tmp_path):
    refs, log = many(spark, tmp_path), str(tmp_path / "log")
    run_rounds(refs, noting(str(tmp_path / "calls")), log, Policy(cdn_host=HOST, pause=None), payload="script")
    merged = enriched_refs(refs, log)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert all(len(r.result_cid) == 64 and json.loads(r.content)["ocr"] == "t" for r in merged.collect())
