"""What the steps shared by publishing and processing send through shuffles."""

from docflow import fixtures
from docflow.operators.versions import chain_updates
from docflow.plans.enrich import enriched_refs
from docflow.sources.sinks import append_versions


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), (
        df._jdf.queryExecution().executedPlan().toString()
    )


def test_components_shuffle_each_side_once(spark, tmp_path):
    lines = "l_orderkey long, l_linenumber int, l_partkey long"
    spark.createDataFrame(
        [(1, 1, 5), (1, 1, 7), (1, 4, 9), (2, 1, 3), (None, 1, 8), (9, 1, 8)], lines
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, 10, "1996-01-01"), (1, 11, "1996-01-02"), (2, None, None), (None, 12, "1996-01-01")],
        "o_orderkey long, o_custkey long, o_orderdate string",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fixtures.components(spark, str(tmp_path))
        assert plan_of(found)[1].count("Exchange hashpartitioning") == 2
        got = sorted(
            (r.version_id, str(r.entity), r.filename, r.cid) for r in found.collect()
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [
        (1, "10", "img1.ref.json", "cid7"),
        (1, "10", "meta4.json", "cid9"),
        (1, "11", "img1.ref.json", "cid7"),
        (1, "11", "meta4.json", "cid9"),
        (2, "None", "img1.ref.json", "cid3"),
    ]


def test_chain_joins_keys_and_not_tips(spark):
    updates = spark.createDataFrame([(e, u) for e in (1, 2, 3) for u in (4, 5, 6)], "entity long, update_id long")
    tips = spark.createDataFrame([(1, "t1", 7), (2, "t2", 1)], "entity long, tip string, ver long")
    plan = chain_updates(updates, tips)
    joined = plan_of(plan)[0]
    assert "sha2" in joined.split("Join LeftOuter", 1)[0]
    assert "sha2" not in joined.split("Join LeftOuter", 1)[1]
    for entity, tip in ((1, "t1"), (2, "t2")):
        own = sorted((r.update_id, r.prev_tip, r.new_tip) for r in plan.collect() if r.entity == entity)
        assert [r[1] for r in own] == [tip, *[r[2] for r in own[:-1]]]
    assert {(r.prev_tip, r.new_tip) for r in plan.collect() if r.entity == 3} == {(None, None)}


def test_version_files_are_entropy_coded(spark, tmp_path):
    updates = spark.createDataFrame([(1, 4, "n", 1)], "entity long, update_id long, note string, n_components long")
    tips = spark.createDataFrame([(1, "t1", 7)], "entity long, tip string, ver long")
    files = spark.createDataFrame([(1, 4, "a", "c")], "entity long, update_id long, filename string, cid string")
    append_versions(chain_updates(updates, tips), files, str(tmp_path), "0")
    assert list(tmp_path.glob("versions/write=0/*.zstd.parquet"))
    assert spark.read.parquet(f"{tmp_path}/versions/write=0").first().prev_tip == "t1"


def test_enriched_refs_shuffles_refs_rows_and_texts_once(spark, tmp_path):
    """No text joins by another key before the documents, so nothing is dealt twice."""
    text = '{"url":"u"}'
    rows = [("b", "c", p, "f", "u", doc) for p, doc in (("1", text), ("2", text), ("3", '{"ocr":"o"}'), ("4", ""))]
    schema = "batch_id string, chunk_id string, pi string, filename string, cdn_url string, ref_data_json string"
    # the second ref comes twice
    refs = spark.createDataFrame([*rows, rows[1]], schema)

    def attempt(pi, seq, outcome, words=None, fails=0, message=None):
        return ("b", "c", pi, "f", seq, outcome, words, message, fails)

    log = spark.createDataFrame(
        [
            attempt("3", 0, "skipped"),
            attempt("4", 0, "permanent", message="gone"),
            attempt("1", 1, "transient", None, 1, "late"),
            attempt("1", 2, "done", "one", 1),
            attempt("2", 1, "rate_limit", None, 1, "429"),
            attempt("2", 1, "rate_limit", None, 1, "429"),
        ],
        "batch_id string, chunk_id string, pi string, filename string, seq long, outcome string, "
        "text string, message string, fails long",
    )
    log.write.parquet(f"{tmp_path}/attempts/round=0/slice=0")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = enriched_refs(refs, str(tmp_path))
        assert plan_of(found)[1].count("Exchange hashpartitioning") == 3
        got = sorted((r.pi, r.status, r.retry_count, r.error, r.seq, r.content) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [
        ("1", "done", 1, None, 2, '{"url":"u","ocr":"one"}'),
        ("2", "pending", 1, None, 1, None),
        ("2", "pending", 1, None, 1, None),
        ("3", "skipped", 0, None, 0, '{"ocr":"o"}'),
        ("4", "error", 0, "gone", 0, None),
    ]
