import random

import pytest
from pyspark.sql import functions as F

from docflow.operators.versions import (
    cas_plan,
    chain_updates,
    entity_tip,
    manifest_merge,
    publish_heads,
    publish_plan,
    version_rows,
)
from tests.conftest import rows


def rounds(updates, tips, tries=3):
    """Compare-and-swap played out round by round."""
    outcome = {}
    for entity, tip in tips.items():
        current = tip
        waiting = {u: expect for e, u, expect in sorted(updates) if e == entity}
        for number in range(1, tries + 1):
            match = [u for u in sorted(waiting) if waiting[u] == current]
            if match:
                outcome[match[0]] = number
                del waiting[match[0]]
                current = f"{tip}+{number}"
            waiting = dict.fromkeys(waiting, current)
    return outcome


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tries", [1, 3])
def test_cas_equals_rounds(spark, seed, tries):
    pick = random.Random(seed)
    tips = {e: f"tip{e}" for e in range(30)}
    updates = []
    for uid in range(300):
        # entity 0 takes a third of all updates
        entity = 0 if uid % 3 == 0 else pick.randint(0, 32)
        fresh = pick.random() < 0.4
        updates.append((entity, uid, tips.get(entity) if fresh else "stale"))
    df = spark.createDataFrame(updates, "entity long, update_id long, expect_tip string")
    current = spark.createDataFrame([(e, t, 5) for e, t in tips.items()], "entity long, tip string, ver long")
    plan = cas_plan(df, current, tries)
    got = plan.collect()
    assert len(got) == 300
    assert {r.update_id: r.round for r in got if r.committed} == rounds(updates, tips, tries)
    errors = {r.entity_error.split()[0] for r in got if not r.committed and r.entity in tips}
    assert errors <= {"CAS"}
    assert all(r.entity_error.startswith("Entity not found") for r in got if r.entity not in tips)

    chains = {}
    for r in sorted((r for r in got if r.committed), key=lambda r: r.round):
        chains.setdefault(r.entity, []).append(r)
    for entity, chain in chains.items():
        assert [r.new_version for r in chain] == list(range(6, 6 + len(chain)))
        assert [r.prev_tip for r in chain] == [tips[entity], *[r.new_tip for r in chain[:-1]]]


def test_version_rows_hold_commits_only(spark):
    df = spark.createDataFrame(
        [("IIa", "u1", "t", 2, "n"), ("b", "u2", "t", 1, "n"), ("gone", "u3", "t", 1, "n")],
        "entity string, update_id string, expect_tip string, n_components long, note string",
    )
    tips = spark.createDataFrame([("IIa", "t", 1), ("b", "t", 4)], "entity string, tip string, ver long")
    got = version_rows(cas_plan(df, tips)).select("entity", "ver", "prev_tip", "network")
    assert rows(got) == [("IIa", 2, "t", "test"), ("b", 5, "t", None)]


def test_tips_and_merge(spark):
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "entity string, ver long, tip string")
    assert rows(entity_tip(versions)) == [("a", "z", 3)]
    components = spark.createDataFrame(
        [("a", 1, "f", "c1"), ("a", 2, "f", "c2"), ("a", 1, "g", "c3")],
        "entity string, ver long, filename string, cid string",
    )
    assert rows(manifest_merge(components)) == [("a", "f", "c2"), ("a", "g", "c3")]


REFS = [
    ("p", "f1", "done", "c1"),
    ("p", "f2", "skipped", "c2"),
    ("p", "f3", "error", None),
    ("p", "f4", "done", None),
    ("p", "f5", "pending", "c5"),
    ("q", "f1", "error", None),
]


def test_publish_plan(spark):
    refs = spark.createDataFrame(REFS, "pi string, filename string, status string, result_cid string")
    note = "OCR: Updated 2 refs"
    assert rows(publish_plan(refs, ["pi"])) == [("p", "f1", "c1", note), ("p", "f2", "c2", note)]
    pis = spark.createDataFrame([("p",), ("q",), ("r",)], "pi string")
    assert rows(publish_heads(pis, refs, ["pi"])) == [
        ("p", 2, note),
        ("q", 0, None),
        ("r", 0, None),
    ]


def test_every_update_commits_in_order(spark):
    tips = spark.createDataFrame([("e", "t9", 9), ("f", "t1", 1)], "entity string, tip string, ver long")
    keys = ["batch_id", "chunk_id"]
    updates = [("e", "a:b", "c"), ("e", "a", "b:c"), ("e", "b", "9"), ("gone", "a", "0")]
    updates += [("f", "b", f"{i:03}") for i in range(200)]
    frame = spark.createDataFrame(updates, "entity string, batch_id string, chunk_id string")
    plan = chain_updates(frame.repartition(4), tips, keys).collect()
    assert len(plan) == len(updates)
    assert [r.entity for r in plan if not r.committed] == ["gone"]
    assert next(r.entity_error for r in plan if not r.committed) == "Entity not found: gone"
    for entity, (tip, ver) in {"e": ("t9", 9), "f": ("t1", 1)}.items():
        own = sorted((r.batch_id, r.chunk_id, r.new_version, r.prev_tip, r.new_tip) for r in plan if r.entity == entity)
        assert [r[2] for r in own] == list(range(ver + 1, ver + 1 + len(own)))
        assert [r[3] for r in own] == [tip, *[r[4] for r in own[:-1]]]
        assert len({r[4] for r in own}) == len(own)
