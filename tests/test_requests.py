import json
import random

import pytest
from pyspark.sql import functions as F

from docflow.operators.ordered import dense_index
from docflow.operators.queue import claim_batch, kept_log, log_lines, log_tail, next_batch
from docflow.operators.requests import (
    admit,
    assign_chunks,
    chunk_requests,
    validate_requests,
    work_items,
)
from docflow.schema import KeyViolation, key_violations, require_unique, unexpected_values
from docflow.sources.tables import read_requests
from tests.conftest import rows


def test_validation_of_json_lines(spark, tmp_path):
    lines = [
        json.dumps({"batch_id": "b", "chunk_id": "0", "pis": ["p1", "p2"], "custom_prompt": "x"}),
        json.dumps({"batch_id": "b", "chunk_id": "1", "pis": []}),
        json.dumps({"batch_id": "", "chunk_id": "2", "pis": ["p"]}),
        json.dumps({"batch_id": "b", "pis": ["p"]}),
        json.dumps({"batch_id": "b", "chunk_id": "4"}),
        '{"batch_id": "b", "chunk_id"',
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    ok, rejected = validate_requests(read_requests(spark, str(tmp_path / "r.json")).cache())
    assert rows(ok.select("chunk_id", F.size("pis"))) == [("0", 2), ("1", 0)]
    assert sorted(r.reason for r in rejected.collect()) == ["Invalid request"] + [
        "Missing required fields: batch_id, chunk_id, pis"
    ] * 3
    assert rows(work_items(ok)) == [("b", "0", 0, "p1"), ("b", "0", 1, "p2")]


def test_admission(spark):
    status = spark.createDataFrame(
        [("b", "1", "DONE"), ("b", "2", "ERROR"), ("b", "3", "PROCESSING")],
        "batch_id string, chunk_id string, phase string",
    )
    requests = spark.createDataFrame(
        [("b", c, f"{c}{n}", n) for c in "0123" for n in (2, 1, 3)],
        "batch_id string, chunk_id string, request_id string, received_at long",
    )
    got = rows(admit(requests, status).select("request_id", "status", "phase"))
    want = []
    for chunk in "0123":
        for n in (1, 2, 3):
            if chunk == "3":
                want.append((f"{chunk}{n}", "already_processing", "PROCESSING"))
            elif n == 1:
                want.append((f"{chunk}{n}", "accepted", None))
            else:
                want.append((f"{chunk}{n}", "already_processing", "FETCHING"))
    assert got == want


def test_key_check(spark):
    df = spark.createDataFrame([("p", "f"), ("p", "g"), ("p", "f")], "pi string, filename string")
    assert rows(key_violations(df, ["pi", "filename"])) == [("p", "f", 2)]
    with pytest.raises(KeyViolation):
        require_unique(df, ["pi"])
    assert require_unique(df.distinct(), ["pi", "filename"]).count() == 2
    assert unexpected_values(df, "filename", ["f"]).count() == 1


def test_assign_chunks_over_many_partitions(spark):
    keys = [f"{n:07d}" for n in random.Random(1).sample(range(10**6), 5003)]
    df = spark.createDataFrame([(k,) for k in keys], "pi string").repartition(7)
    got = rows(assign_chunks(df, [F.col("pi")], 10), "pi")
    assert got == [(k, i // 10) for i, k in enumerate(sorted(keys))]


def test_chunks_per_batch_and_back_to_requests(spark):
    flat = [(f"b{n % 3 if n < 300 else 0}", f"{n:04d}") for n in range(700)]
    df = spark.createDataFrame(flat, "batch_id string, pi string").repartition(5)
    chunked = assign_chunks(df, [F.col("pi")], 7, ["batch_id"])
    want = []
    for batch in ("b0", "b1", "b2"):
        members = sorted(p for b, p in flat if b == batch)
        want += [(batch, p, i // 7) for i, p in enumerate(members)]
    assert rows(chunked.select("batch_id", "pi", "chunk_id")) == sorted(want)
    requests = chunk_requests(chunked)
    items = work_items(requests)
    assert rows(items.select("batch_id", "pi", "chunk_id")) == sorted(want)
    assert requests.agg(F.max(F.size("pis"))).first()[0] == 7


def test_dense_index_of_an_empty_table(spark):
    df = spark.createDataFrame([], "pi string")
    assert dense_index(df, [F.col("pi")], "n").count() == 0


def test_ordered_picks(spark):
    refs = spark.createDataFrame(
        [("b", str(c), "p", f"f{n}", "done" if n % 2 else "pending") for c in (0, 1) for n in range(8)],
        "batch_id string, chunk_id string, pi string, filename string, status string",
    )
    batch = next_batch(refs, n=3)
    assert [r[-1] for r in rows(batch.select("chunk_id", "filename"))] == ["f0", "f2", "f4"] * 2
    assert claim_batch(refs, batch).count() == 6

    log = spark.createDataFrame(
        [("b", "0", n // 2, n, f"m{n}") for n in range(130)],
        "batch_id string, chunk_id string, ts long, id long, message string",
    )
    tail = rows(log_tail(log).select("age", "id"))
    assert tail == [(age, 130 - age) for age in range(1, 51)]
    lines = log_lines(log, k=3).first().debug_log
    assert lines == ["63 m127", "64 m128", "64 m129"]
    assert kept_log(log).agg(F.min("id"), F.count("*")).first()[:] == (30, 100)
