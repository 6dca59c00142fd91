import itertools

import pytest
from pyspark.sql import functions as F

from docflow.functions.classify import (
    PERMANENT_PATTERNS,
    RATE_LIMIT_PATTERNS,
    classify_error,
    earns_fallback,
    fallback_eligible,
    normalise_message,
)
from tests.conftest import rows

DOWNLOAD = "400 Bad Request: Failed to Download image"


def judge(spark, messages, has_fallback=True):
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    return {
        r[0]: (r[1], r[2])
        for r in df.select(
            "m", classify_error(F.col("m")), fallback_eligible(F.col("m"), F.lit(has_fallback))
        ).collect()
    }


def test_every_pattern_alone_and_in_upper_case(spark):
    cases = {p: "rate_limit" for p in RATE_LIMIT_PATTERNS}
    cases |= {p: "permanent" for p in PERMANENT_PATTERNS}
    cases |= {f"x {p.upper()} y": c for p, c in cases.items()}
    got = judge(spark, list(cases))
    assert {m: g[0] for m, g in got.items()} == cases
    assert not any(g[1] for g in got.values())


def test_rate_limit_wins_over_permanent_and_both_over_fallback(spark):
    mixed = [f"{p} {r}" for p, r in itertools.product(PERMANENT_PATTERNS, RATE_LIMIT_PATTERNS)]
    assert {g[0] for g in judge(spark, mixed).values()} == {"rate_limit"}
    barred = [f"{DOWNLOAD} {p}" for p in PERMANENT_PATTERNS]
    assert set(judge(spark, barred).values()) == {("permanent", False)}


def test_a_429_inside_an_id_is_a_rate_limit(spark):
    assert judge(spark, ["Invalid Image Format: item 14293"]) == {
        "Invalid Image Format: item 14293": ("rate_limit", False)
    }


def test_underscore_is_literal(spark):
    assert judge(spark, ["rateXlimitXexceeded"])["rateXlimitXexceeded"][0] == "transient"


def test_fallback_needs_all_three_conditions(spark):
    got = judge(spark, [DOWNLOAD, "failed to download", "400", "503", None])
    assert got[DOWNLOAD] == ("transient", True)
    assert [got[m][1] for m in ("failed to download", "400", "503", None)] == [False] * 4
    assert got[None][0] is None
    assert judge(spark, [DOWNLOAD], has_fallback=False)[DOWNLOAD][1] is False


@pytest.mark.parametrize("message", [DOWNLOAD, "400 failed to download 429", "400", "", "Invalid URL"])
def test_python_rule_equals_column_rule(spark, message):
    assert judge(spark, [message])[message][1] == earns_fallback(message)


def test_message_prefixes(spark):
    df = spark.createDataFrame(
        [(o, f) for o in ("rate_limit", "permanent", "transient", "done") for f in (False, True)],
        "o string, f boolean",
    )
    text = normalise_message(F.lit("m"), F.col("o"), F.col("f"))
    assert rows(df.select("o", "f", text.alias("t"))) == [
        ("done", False, None),
        ("done", True, None),
        ("permanent", False, "Permanent OCR failure: m"),
        ("permanent", True, "Permanent OCR failure on fallback: m"),
        ("rate_limit", False, "Rate limited: m"),
        ("rate_limit", True, "Rate limited on fallback: m"),
        ("transient", False, "OCR failed: m"),
        ("transient", True, "OCR fallback failed: m"),
    ]
