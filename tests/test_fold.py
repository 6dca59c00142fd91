import random

import pytest

from docflow.operators import fold
from tests.conftest import rows

OUTCOMES = ["done", "skipped", "permanent", "rate_limit", "transient"]


def one_by_one(log, max_retries=3):
    """The state of a ref, step by step."""
    count = 0
    for _, outcome, message in sorted(log):
        if outcome in ("done", "skipped"):
            return outcome, count, None
        if outcome == "permanent":
            return "error", count, message
        count += 1
        if outcome == "transient" and count >= max_retries:
            return "error", count, f"Failed after {max_retries} retries: {message}"
    return "pending", count, None


def random_logs(seed, n_refs, longest, weights):
    pick = random.Random(seed)
    logs = {}
    for ref in range(n_refs):
        length = pick.randint(1, longest)
        kinds = pick.choices(OUTCOMES, weights, k=length)
        logs[ref] = [(seq, kind, f"m{ref}-{seq}") for seq, kind in enumerate(kinds, 1)]
    return logs


def frame(spark, logs):
    flat = [(ref, *row) for ref, log in logs.items() for row in log]
    random.Random(7).shuffle(flat)
    return spark.createDataFrame(flat, "ref long, seq long, outcome string, message string")


def expected(logs, max_retries=3):
    return sorted((ref, *one_by_one(log, max_retries)) for ref, log in logs.items())


@pytest.mark.parametrize("max_retries", [1, 2, 3, 5])
def test_fold_equals_step_by_step(spark, max_retries):
    logs = random_logs(max_retries * 10, 400, 14, [1, 1, 1, 6, 6])
    got = fold.attempt_fold(frame(spark, logs), ["ref"], max_retries=max_retries)
    assert rows(got, "ref") == expected(logs, max_retries)


@pytest.mark.parametrize("max_retries", [1, 3, 5])
def test_fold_goes_on_from_any_cut(spark, max_retries):
    """Each ref's log cut at a place of its own: the failures before it are all that is kept."""
    logs = random_logs(max_retries, 400, 14, [1, 1, 1, 9, 9])
    pick = random.Random(max_retries)
    cuts = {ref: pick.randint(0, len(log)) for ref, log in logs.items()}
    early = fold.attempt_fold(frame(spark, {r: l[: cuts[r]] for r, l in logs.items()}), ["ref"], max_retries=max_retries)
    early = rows(early, "ref")
    pending = [(r[0], r[2]) for r in early if r[1] == "pending"]
    before = spark.createDataFrame(pending, "ref long, before long")
    ended = {r[0] for r in early if r[1] != "pending"}
    late = {r: l[cuts[r] :] for r, l in logs.items() if r not in ended}
    got = rows(fold.attempt_fold(frame(spark, late), ["ref"], max_retries=max_retries, before=before), "ref")
    seen = {r[0] for r in got}
    assert sorted([r for r in early if r[0] not in seen] + got) == expected(logs, max_retries)


def test_a_ref_that_owns_most_of_the_log(spark):
    logs = random_logs(5, 60, 6, [1, 1, 1, 3, 3])
    logs[999] = [(seq, "rate_limit", "m") for seq in range(1, 4000)]
    logs[999] += [(4000, "transient", "last"), (4001, "done", "late")]
    got = rows(fold.attempt_fold(frame(spark, logs), ["ref"]), "ref")
    assert got == expected(logs)
    assert got[-1] == (999, "error", 4000, "Failed after 3 retries: last")


def test_rate_limits_use_up_the_transient_budget(spark):
    logs = {1: [(1, "rate_limit", "a"), (2, "rate_limit", "b"), (3, "transient", "c")]}
    assert rows(fold.attempt_fold(frame(spark, logs), ["ref"])) == [
        (1, "error", 3, "Failed after 3 retries: c")
    ]


def test_rows_after_the_end_and_repeated_rows_change_nothing(spark):
    logs = random_logs(11, 80, 8, [2, 1, 1, 3, 3])
    before = rows(fold.attempt_fold(frame(spark, logs), ["ref"]), "ref")
    ended = {r[0] for r in before if r[1] != "pending"}
    longer = {
        ref: log + log[:2] + ([(50, "permanent", "late"), (51, "done", "l")] if ref in ended else [])
        for ref, log in logs.items()
    }
    assert rows(fold.attempt_fold(frame(spark, longer), ["ref"]), "ref") == before


def test_carried_columns_come_from_the_deciding_row(spark):
    logs = {1: [(1, "rate_limit", "a"), (2, "done", None), (3, "done", None)], 2: [(1, "transient", "x")]}
    got = fold.attempt_fold(frame(spark, logs), ["ref"], carry=["seq"])
    assert rows(got.select("ref", "status", "seq"), "ref") == [(1, "done", 2), (2, "pending", None)]


@pytest.mark.parametrize("seed", range(3))
def test_streaks_over_segments(spark, seed):
    pick = random.Random(seed)
    flags = {
        chunk: [pick.random() < share for _ in range(length)]
        for chunk, (share, length) in enumerate([(0.5, 40), (0.999, 3000), (1.0, 2500), (0.0, 10)])
    }
    df = spark.createDataFrame(
        [(c, i, f) for c, fs in flags.items() for i, f in enumerate(fs)],
        "chunk long, step long, rate_limited boolean",
    )
    got = rows(fold.backoff_streaks(df, ["chunk"], "step", segment_rows=100).select("chunk", "step", "streak"))
    want = []
    for chunk, fs in flags.items():
        streak = 0
        for i, f in enumerate(fs):
            streak = streak + 1 if f else 0
            want.append((chunk, i, streak))
    assert got == want


def test_steps_of_a_log(spark):
    df = spark.createDataFrame(
        [("b", "0", 1, "done"), ("b", "0", 1, "rate_limit"), ("b", "0", 2, "done"), ("b", "1", 1, "transient")],
        "batch_id string, chunk_id string, seq long, outcome string",
    )
    steps = fold.backoff_steps(df)
    assert rows(steps) == [("b", "0", 1, True), ("b", "0", 2, False), ("b", "1", 1, False)]
    streaks = fold.backoff_streaks(steps).select("chunk_id", "step", "streak", "delay_ms")
    assert rows(streaks) == [("0", 1, 1, 1000), ("0", 2, 0, None), ("1", 1, 0, None)]


def test_chunk_failures(spark):
    flat = [(c, s, f"e{c}-{s}") for c, n in ((1, 1), (2, 4), (3, 5), (4, 9)) for s in range(1, n + 1)]
    df = spark.createDataFrame(flat, "chunk long, seq long, message string")
    assert rows(fold.chunk_fail_fold(df, ["chunk"])) == [
        (1, None, None, 1, 2000),
        (2, None, None, 4, 16000),
        (3, "ERROR", "e3-5", 5, None),
        (4, "ERROR", "e4-5", 5, None),
    ]
