import json

import pytest
from pyspark.sql import functions as F

from docflow.functions import jsondoc
from docflow.functions.jsondoc import field_text, has_value, is_null_doc, is_truthy, merge_ocr, parse_doc, render_doc
from docflow.functions.scalars import (
    backoff_ms,
    backoff_remaining,
    chunk_label,
    elapsed_ms,
    falsy_to,
    global_retry_delay,
    in_backoff,
    network_tag,
    status_of_phase,
    utf16_length,
    version_note,
)
from docflow.functions.urls import url_variants
from tests.conftest import values

HOST = "cdn.example.org"


@pytest.mark.parametrize(
    ("url", "asset"),
    [
        ("https://cdn.example.org/asset/01AB", "01AB"),
        ("https://cdn.example.org/asset/01AB/large", "01AB"),
        ("http://cdn.example.org/asset/01AB?w=1&h=2", "01AB"),
        ("https://x.test/?u=cdn.example.org/asset/9Z/medium", "9Z"),
        ("https://cdn.example.org/asset/01abC", "01"),
        ("https://cdn.example.org/asset/lower", None),
        ("https://cdn.example.org/other/01AB", None),
        ("https://elsewhere.test/asset/01AB", None),
        ("https://cdnXexample.org/asset/01AB", None),
    ],
)
def test_url_variants(spark, url, asset):
    got = values(spark, url_variants(F.lit(url), HOST))
    if asset is None:
        assert tuple(got) == (url, None)
    else:
        base = f"https://{HOST}/asset/{asset}"
        assert tuple(got) == (f"{base}/medium", base)


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abc", 3), ("é", 1), ("a\U0001f600", 3), (None, None)])
def test_utf16_length(spark, text, n):
    assert values(spark, utf16_length(F.lit(text).cast("string"))) == n


def test_backoff_doubles_up_to_32_seconds(spark):
    df = spark.range(0, 10).select(backoff_ms(F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [
        None, 1000, 2000, 4000, 8000, 16000, 32000, 32000, 32000, 32000,
    ]


@pytest.mark.parametrize(("jitter", "delay"), [(1.0, 40000), (-1.0, 24000), (0.5, 36000)])
def test_backoff_jitter(spark, jitter, delay):
    assert values(spark, backoff_ms(F.lit(9), F.lit(jitter))) == delay


def test_backoff_window(spark):
    at = F.lit(1000).cast("long")
    assert values(spark, backoff_remaining(F.lit(1500).cast("long"), at)) == 500
    assert values(spark, backoff_remaining(F.lit(900).cast("long"), at)) == 0
    assert values(spark, backoff_remaining(F.lit(None).cast("long"), at)) == 0
    assert values(spark, in_backoff(F.lit(1000).cast("long"), at)) is False
    assert values(spark, in_backoff(F.lit(1001).cast("long"), at)) is True


def test_global_retry_delay(spark):
    df = spark.range(1, 9).select(global_retry_delay(F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [2000, 4000, 8000, 16000, 32000, 60000, 60000, 60000]


def test_small_helpers(spark):
    assert values(spark, network_tag(F.lit("II01"))) == "test"
    assert values(spark, network_tag(F.lit("ii01"))) is None
    assert values(spark, falsy_to(F.lit(""), F.lit("d"))) == "d"
    assert values(spark, falsy_to(F.lit("x"), F.lit("d"))) == "x"
    assert values(spark, version_note(F.lit(3))) == "OCR: Updated 3 refs"
    assert values(spark, chunk_label(F.lit("b"), F.lit("0"))) == "b:0"
    phases = {"DONE": "done", "ERROR": "error", "FETCHING": "processing", "PUBLISHING": "processing"}
    for phase, status in phases.items():
        assert values(spark, status_of_phase(F.lit(phase))) == status
    at = lambda s: F.lit(s).cast("timestamp")
    open_end = elapsed_ms(at("2024-01-01 00:00:00"), at(None), at("2024-01-01 00:00:02.5"))
    assert values(spark, open_end) == 2500


@pytest.mark.parametrize(
    "text", ["{bad", "", "{'a':1}", '{"a":01}', '{"a":1} x', '{"a":1},{"b":2}', '{"a":NaN}']
)
def test_bad_json_is_null(spark, text):
    assert values(spark, parse_doc(F.lit(text)).isNull())


@pytest.mark.parametrize(
    ("text", "truthy"),
    [
        ('{"url":"u"}', True),
        ('{"url":"0"}', True),
        ('{"url":{}}', True),
        ('{"url":[]}', True),
        ('{"url":7}', True),
        ('{"url":true}', True),
        ('{"url":""}', False),
        ('{"url":0}', False),
        ('{"url":0.0}', False),
        ('{"url":false}', False),
        ('{"url":null}', False),
        ('{"other":"u"}', False),
        ("[1]", False),
        ('"text"', False),
    ],
)
def test_truthiness(spark, text, truthy):
    assert values(spark, is_truthy(parse_doc(F.lit(text)), "url")) is truthy


def test_null_document_and_last_duplicate_wins(spark):
    assert values(spark, is_null_doc(parse_doc(F.lit("null")))) is True
    assert values(spark, is_null_doc(parse_doc(F.lit("{}")))) is False
    assert values(spark, field_text(parse_doc(F.lit('{"url":"a","url":"b"}')), "url")) == "b"


DOCS = [
    {"url": "u", "size": 12, "ratio": 1.5, "flag": True, "none": None, "type": "image/jpeg"},
    {"ocr": "", "url": "u"},
    {"url": "u", "ocr": "old", "zz": 'quote " \\ \n tab\t é \U0001f600'},
    {"url": "u", "nested": {"b": [1, {"c": None}], "a": "x"}},
]
TEXTS = ["plain", "", 'multi\nline "quoted" \\ back  é \U0001f600 \x07', "x" * 70000]


@pytest.mark.parametrize("doc", DOCS)
@pytest.mark.parametrize("text", TEXTS)
def test_merge_keeps_every_other_key(spark, doc, text):
    df = spark.createDataFrame([(json.dumps(doc), text)], "j string, t string")
    merged = df.select(merge_ocr(F.col("j"), F.col("t"))).first()[0]
    expected = {**doc, "ocr": text}
    assert json.loads(merged) == expected
    assert list(json.loads(merged)) == list(expected)


def test_flat_documents_have_two_space_indent(spark):
    doc = {"url": "u", "size": 12, "flag": False}
    df = spark.createDataFrame([(json.dumps(doc),), ("{}",)], "j string")
    got = [r[0] for r in df.select(render_doc(F.col("j"))).collect()]
    assert got == [json.dumps(doc, indent=2), "{}"]
    merged = df.select(merge_ocr(F.col("j"), F.lit(None).cast("string"))).collect()
    assert [json.loads(r[0])["ocr"] for r in merged] == ["", ""]


@pytest.mark.parametrize(
    ("text", "merged"),
    [
        ('{"b":1,"a":[1,{"z":1,"y":2.0}]}', '{"b":1,"a":[1,{"z":1,"y":2.0}],"ocr":"t"}'),
        ('{"n": 1e3, "m": 1.0}', '{"n": 1e3, "m": 1.0,"ocr":"t"}'),
        ('{\n  "a": 1,\n  "b": {}\n}\n', '{\n  "a": 1,\n  "b": {},\n  "ocr": "t"\n}\n'),
        ('{"ocr": null, "x": "ocr"}', '{"ocr": "t", "x": "ocr"}'),
        ('{"ocr" : [1, {"ocr": 2}] ,"x":{"ocr":3}}', '{"ocr" : "t" ,"x":{"ocr":3}}'),
        ('{"x":{"ocr":3},"y":["ocr"]}', '{"x":{"ocr":3},"y":["ocr"],"ocr":"t"}'),
        ('{"a":1,"ocr":1,"a":2,"ocr": 5}', '{"a":1,"ocr":1,"a":2,"ocr": "t"}'),
        ('{"\\u006fcr":"old"}', '{"\\u006fcr":"t"}'),
        ('{"k":"a\\"b,}{:ocr","\\\\":"ocr"}', '{"k":"a\\"b,}{:ocr","\\\\":"ocr","ocr":"t"}'),
        ("{ }", '{"ocr":"t"}'),
        ('{"é😀":"ß","ocr":"😀"}', '{"é😀":"ß","ocr":"t"}'),
        ("[1]", None),
        ("{", None),
        (None, None),
    ],
)
def test_merge_leaves_all_other_characters(spark, text, merged):
    df = spark.createDataFrame([(text,)], "j string")
    got = df.select(merge_ocr(F.col("j"), F.lit("t"))).first()[0]
    assert got == merged
    if merged:
        assert json.loads(got) == {**json.loads(text), "ocr": "t"}


def test_merge_into_a_long_document(spark):
    old = json.dumps({"a": ["x\n" * 50_000, *range(2000)], "ocr": "\\" * 10_000, "b": "y" * 200_000})
    df = spark.createDataFrame([(old,)], "j string")
    got = df.select(merge_ocr(F.col("j"), F.lit("t"))).first()[0]
    assert json.loads(got) == {**json.loads(old), "ocr": "t"}


@pytest.mark.parametrize(
    "text",
    ['{"ocr":"t"}', '{"ocr":""}', '{"a":"ocr"}', '{"\\u006fcr":"t"}', '{"a":1}', '{"a":"\\n"}', "{", "", None, '["ocr"]', '{"x":{"ocr":1}}'],
)
def test_a_value_is_found_without_a_needless_parse(spark, text):
    df = spark.createDataFrame([(text,)], "j string")
    short, parsed = df.select(has_value(F.col("j"), "ocr"), is_truthy(parse_doc(F.col("j")), "ocr")).first()
    assert short is parsed


@pytest.mark.parametrize(
    ("text", "merged"),
    [
        (' {"a": [1, 2] } ', ' {"a": [1, 2],"ocr":"t" } '),
        ('\n{\n\t"a": "x y "\n}\n', '\n{\n\t"a": "x y ",\n\t"ocr": "t"\n}\n'),
        (" {\n} ", '{"ocr":"t"}'),
        ('{"a":"é😀"}', '{"a":"é😀","ocr":"t"}'),
        ('{"a":"}"}', '{"a":"}","ocr":"t"}'),
        ('{"a":{}}', '{"a":{},"ocr":"t"}'),
    ],
)
def test_flat_documents_are_merged_like_all_others(spark, text, merged):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(merge_ocr(F.col("j"), F.lit("t"))).first()[0] == merged


@pytest.mark.parametrize(
    ("text", "compact"),
    [
        ('{"url":"u","part":1}', True),
        ('{"n": 1e3, "m": "ä💡"}', True),
        ('{"a":[1,2]}', True),
        ('{ "a":1}', False),
        ('{"a":1 }', False),
        ('{"a":1}\n', False),
        (' {"a":1}', False),
        ("{}", False),
        ('{"a":{}}', False),
        ('{"ocr":""}', False),
        ('{"a":"\\n"}', False),
    ],
)
def test_compact_documents_take_the_short_path(spark, text, compact):
    """It gives what the scan for the place of the text gives."""
    assert values(spark, jsondoc._is_compact(F.lit(text))) is compact
    df = spark.createDataFrame([(text, 't"x')], "j string, t string")
    merged = df.select(merge_ocr(F.col("j"), F.col("t"))).first()[0]
    assert json.loads(merged) == {**json.loads(text), "ocr": 't"x'}
    if compact:
        appended = df.select(jsondoc._appended(F.col("j"), F.lit('"t\\"x"'))).first()[0]
        assert merged == appended
