import random

from pyspark.sql import functions as F

from docflow.operators.fold import attempt_fold
from docflow.operators.queue import append_log
from docflow.sources.keyed import KeyedTable
from docflow.streaming.complete import open_chunks, publish_batches, write_complete_chunks
from docflow.streaming.fold import folded, state_table, write_fold
from tests.conftest import rows
from tests.test_fold import expected, frame, random_logs

SCHEMA = "ref long, seq long, outcome string, message string"


def test_streamed_fold_equals_batch(spark, tmp_path):
    logs = random_logs(21, 60, 9, [1, 1, 1, 3, 3])
    log = frame(spark, logs).cache()
    for n, (low, high) in enumerate([(0, 3), (3, 6), (6, 99)]):
        part = log.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1)
        part.write.parquet(str(tmp_path / "in" / f"part={n}"))

    def stream():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
        source = source.parquet(str(tmp_path / "in" / "part=*"))
        write_fold(source, str(tmp_path / "out"), str(tmp_path / "cp"), ["ref"]).awaitTermination()
        return folded(spark, state_table(source, str(tmp_path / "out"), ["ref"]))

    got = rows(stream(), "ref")
    assert got == expected(logs) == rows(attempt_fold(log, ["ref"]), "ref")
    # a restart has nothing left to do; a late row of an ended ref changes nothing
    ended = next(r for r in got if r[1] != "pending")[0]
    late = spark.createDataFrame([(ended, 99, "permanent", "late")], SCHEMA)
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "part=3"))
    assert rows(stream(), "ref") == got
    # that micro-batch rewrote the one bucket of its ref
    lists = spark.read.parquet(str(tmp_path / "out" / "state" / "lists" / "3"))
    assert lists.where("generation = 3").count() == 1
    # again, as after a crash before its commit was noted
    for name in ("3", ".3.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    assert rows(stream(), "ref") == got


def test_any_cut_into_micro_batches(spark, tmp_path):
    logs = random_logs(4, 40, 12, [1, 1, 1, 9, 9])
    flat = [(ref, *row) for ref, log in logs.items() for row in log]
    pick = random.Random(4)
    edges = [0, *sorted(pick.sample(range(1, 12), 4)), 12]
    for n, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = [r for r in flat if low < r[1] <= high]
        pick.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    write_fold(source, str(tmp_path / "out"), str(tmp_path / "cp"), ["ref"], buckets=3).awaitTermination()
    table = state_table(source, str(tmp_path / "out"), ["ref"], 3)
    assert rows(folded(spark, table), "ref") == expected(logs)


def test_chunks_complete_once(spark, tmp_path):
    schema = "batch_id string, chunk_id string"
    totals = spark.createDataFrame([("c", "0", 3), ("c", "1", 2), ("c", "2", 1)], f"{schema}, total_refs long")
    finals = [["0", "0", "1"], ["0", "1"], ["2"]]
    out = str(tmp_path / "out")

    def stream(n):
        df = spark.createDataFrame([("c", c) for c in finals[n]], schema)
        df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / f"part={n}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        write_complete_chunks(source, totals, out, str(tmp_path / "cp")).awaitTermination()
        state = open_chunks(source, out)
        newest = state.read(spark, state.newest(spark))
        emitted = spark.read.schema(f"{schema}, total_refs long").parquet(out)
        return rows(emitted.select("chunk_id", "total_refs")), rows(newest.select("chunk_id", "n_final"))

    assert stream(0) == ([], [("0", 2), ("1", 1)])
    assert stream(1) == ([("0", 3), ("1", 2)], [])
    assert stream(2) == ([("0", 3), ("1", 2), ("2", 1)], [])
    # the last micro-batch again, as after a crash before its commit was noted
    for name in ("2", ".2.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    write_complete_chunks(source, totals, out, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out).select("chunk_id")) == [("0",), ("1",), ("2",)]


def test_streamed_publishing_can_be_repeated(spark, tmp_path):
    base = spark.createDataFrame([("a", "t1", 1), ("b", "t2", 7)], "entity string, tip string, ver long")
    files = spark.createDataFrame(
        [("a", "u1", "f", "c1"), ("a", "u2", "f", "c2"), ("b", "u3", "g", "c3")],
        "entity string, update_id string, filename string, cid string",
    )
    schema = "entity string, update_id string, note string, n_components long"
    parts = [[("a", "u1")], [("a", "u2"), ("b", "u3")]]
    for n, part in enumerate(parts):
        df = spark.createDataFrame([(e, u, "n", 1) for e, u in part], schema)
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    def publish(checkpoint):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        publish_batches(
            source.parquet(str(tmp_path / "in" / "part=*")),
            lambda session: base,
            files,
            str(tmp_path / "out"),
            str(tmp_path / checkpoint),
        ).awaitTermination()
        read = spark.read.parquet(str(tmp_path / "out" / "versions" / "*"))
        return rows(read.select("entity", "ver", "tip", "prev_tip"), "entity", "ver")

    first = publish("cp")
    assert [(r[0], r[1]) for r in first] == [("a", 2), ("a", 3), ("b", 8)]
    assert first[1][3] == first[0][2]
    # the last micro-batch again, as after a crash before its commit was noted
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    assert publish("cp") == first
    comps = spark.read.parquet(str(tmp_path / "out" / "components" / "*"))
    assert rows(comps) == [("a", 2, "f", "c1"), ("a", 3, "f", "c2"), ("b", 8, "g", "c3")]


def test_streamed_publishing_reads_earlier_versions_once(spark, tmp_path):
    """An entity is looked up among the earlier versions when it is met first, then never again."""
    base = spark.createDataFrame([("a", "t1", 1), ("b", "t2", 7)], "entity string, tip string, ver long")
    schema = "entity string, update_id string, note string, n_components long"
    for n, part in enumerate([[("a", "u1"), ("x", "u0")], [("a", "u2")], [("a", "u3"), ("b", "u4")]]):
        df = spark.createDataFrame([(e, u, "n", 1) for e, u in part], schema)
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    looked_up = []

    def versions(session):
        looked_up.append(1)
        return base

    files = spark.createDataFrame([], "entity string, update_id string, filename string, cid string")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    publish_batches(
        source.parquet(str(tmp_path / "in" / "part=*")), versions, files, str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    read = spark.read.parquet(str(tmp_path / "out" / "versions" / "*"))
    assert rows(read.select("entity", "ver"), "entity", "ver") == [("a", 2), ("a", 3), ("a", 4), ("b", 8)]
    assert len(looked_up) == 2


def test_keyed_table_touches_only_what_it_must(spark, tmp_path):
    schema = "chunk string, ts long, id long"
    table = KeyedTable(str(tmp_path / "log"), ["chunk"], schema, buckets=8)
    first = [(f"c{c}", t, t) for c in range(30) for t in range(5)]
    append_log(table, spark.createDataFrame(first, schema), ["ts", "id"], k=3)
    assert append_log(table, spark.createDataFrame([("c1", 9, 9), ("c1", 0, 0)], schema), ["ts", "id"], k=3) == 1
    kept = sorted(tuple(r) for r in table.read(spark, 1).collect())
    want = [(f"c{c}", t, t) for c in range(30) for t in ((2, 3, 4) if c != 1 else (3, 4, 9))]
    assert kept == sorted(want)
    held = {r.bucket: r.generation for r in spark.read.parquet(str(tmp_path / "log" / "lists" / "1")).collect()}
    assert sorted(held.values()) == [0] * (len(held) - 1) + [1]
    part = table.read(spark, 1, spark.createDataFrame([("c1",)], "chunk string"))
    assert {r.chunk for r in part.collect()} < {f"c{c}" for c in range(30)}
    assert len(part.inputFiles()) == 1
    # superseded generations go, the newest and the one before it stay whole
    for t in (10, 11, 12):
        append_log(table, spark.createDataFrame([(f"c{c}", t, t) for c in range(30)], schema), ["ts", "id"], k=3)
    assert sorted(p.name for p in (tmp_path / "log" / "rows").iterdir() if p.is_dir()) == ["3", "4"]
    assert table.read(spark, 3).count() == table.read(spark, 4).count() == 90


def test_a_batch_joins_the_components_between_its_updates_only(spark):
    from docflow.streaming.complete import _of_updates

    plan = spark.createDataFrame([(3, True), (5, True), (9, False)], "update_id long, committed boolean")
    files = spark.range(20).select(F.col("id").alias("update_id"), F.lit("f").alias("filename"))
    files = files.unionByName(spark.createDataFrame([(None, "f")], "update_id long, filename string"))
    assert sorted(r.update_id for r in _of_updates(files, plan).collect()) == [3, 4, 5]
    assert _of_updates(files, plan.where("NOT committed")).count() == 0
