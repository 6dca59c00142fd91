"""Plans and hot keys: what must hold when one key owns a third of a table."""

import re

import pytest
from pyspark.sql import functions as F

from docflow.suite.queries import QUERIES
from docflow.operators.contents import dedup_extract
from docflow.operators.discover import lookup_contents
from docflow.operators.fold import attempt_fold, chunk_fail_fold
from docflow.operators.queue import log_tail
from docflow.operators.requests import admit
from docflow.operators.versions import publish_plan
from docflow.plans.extract import extract_once
from docflow.suite.models import letter_model

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def small_partitions(spark):
    """Skew limits scaled down to test data."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_refs(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5000))
    return spark.range(0, 120000, 1, 12).select(F.col("id"), hot.alias("cid"))


def test_hot_content_id_is_split(spark, small_partitions, tmp_path):
    refs = hot_refs(spark)
    contents = refs.select("cid").distinct().withColumn("content", F.lit('{"url":"u"}'))
    contents.write.parquet(str(tmp_path / "contents"))
    contents = spark.read.parquet(str(tmp_path / "contents"))
    found = lookup_contents(refs, contents)
    assert found.where("cdn_url = 'u'").select("id", "cdn_url").distinct().count() == 120000
    found.collect()
    assert "skew=true" in plan(found)


def test_hot_chunk_is_split_in_admission(spark, small_partitions):
    requests = hot_refs(spark).select(
        F.lit("b").alias("batch_id"), F.col("cid").alias("chunk_id"),
        F.col("id").alias("request_id"), F.col("id").alias("received_at"),
    )
    known = spark.createDataFrame([("b", "hot", "DONE")], "batch_id string, chunk_id string, phase string")
    judged = admit(requests, known)
    taken = judged.where("status = 'accepted'").groupBy("chunk_id").count().where("count != 1")
    assert taken.count() == 0
    judged.collect()
    assert "skew=true" in plan(judged)


def test_hot_entity_is_split_where_counts_are_joined_back(spark, small_partitions):
    refs = hot_refs(spark).select(
        F.col("cid").alias("pi"),
        F.concat(F.lit("f"), F.col("id")).alias("filename"),
        F.lit("done").alias("status"),
        F.lit("c").alias("result_cid"),
    )
    notes = publish_plan(refs, ["pi"])
    assert notes.where("pi = 'hot' AND note = 'OCR: Updated 40000 refs'").count() == 40000
    notes.collect()
    assert "skew=true" in plan(notes)


def test_hot_text_is_split_when_results_go_back(spark, small_partitions):
    def extract(distinct):
        sent = distinct.select("cid", "text", F.lit("u").alias("primary"), F.lit(None).cast("string").alias("fallback"))
        return extract_once(sent, letter_model, ["cid"], payload="text")

    done = dedup_extract(hot_refs(spark).withColumnRenamed("cid", "text"), "text", extract)
    assert len(done.collect()) == 120000
    assert "skew=true" in plan(done)


def test_hot_ref_is_split_in_the_fold(spark, small_partitions):
    """A ref with a third of the rows, all within one hour."""
    log = spark.range(1, 240001, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id"))).alias("ref"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 100)").alias("ts"),
        F.col("id").alias("seq"),
        F.when(F.col("id") < 239990, "rate_limit").otherwise("done").alias("outcome"),
        F.lit("m").alias("message"),
    )
    folded = attempt_fold(log, ["ref"], ["ts", "seq"])
    found = folded.where("ref = 'hot'").select("status", "retry_count").first()[:]
    assert found == ("done", 79996)
    assert folded.where("status = 'pending'").count() + folded.where("status = 'done'").count() == 160001
    folded.collect()
    text = plan(folded)
    assert "skew=true" in text
    # picks are limited in the tasks before they are shuffled, and nothing orders whole logs
    assert text.count("WindowGroupLimit") >= 2 and "rowsBetween" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    log = hot_refs(spark).select(F.col("cid").alias("chunk"), F.col("id").alias("ts"), F.lit("m").alias("message"))
    for df in (log_tail(log, ["chunk"], ["ts"]), chunk_fail_fold(log, ["chunk"], ["ts"])):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("WindowGroupLimit") == 2
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


# queries that run jobs while they are built are covered by the suite test
EAGER = re.compile("stream|process|enrich|sink|assign|cas|append|apply")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not EAGER.search(n)))
def test_no_cross_join_and_no_global_window(spark, name):
    text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text
    # its only chunk is the whole table: one summary row per 65,536 steps is ordered there
    if name != "backoff_streaks":
        assert "SinglePartition" not in text
    assert "PythonUDF" not in text
    assert "BatchEvalPython" not in text


def test_scans_read_only_needed_columns(spark):
    text = QUERIES["attempt_fold"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    text = QUERIES["cost_rollup"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in text
