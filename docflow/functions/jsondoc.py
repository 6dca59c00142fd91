"""Open JSON documents: strict parse, truthiness, merge.

Everything stays in the JVM: documents are read as VARIANT, so unknown keys and
their types survive, and the top-level key order of the text is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts that count as false.
FALSY_JSON = ['""', "0", "0.0", "-0.0", "false", "null"]


def parse_doc(text: Column) -> Column:
    """VARIANT of a JSON text, null when it is not exactly one JSON value.

    The parser alone would accept trailing text, hence the one-element array.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def field_json(doc: Column, name: str) -> Column:
    return F.to_json(F.try_variant_get(doc, f"$.{name}", "variant"))


def field_text(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "string")


def is_truthy(doc: Column, name: str) -> Column:
    """Present and neither empty, zero, false nor null."""
    raw = field_json(doc, name)
    return F.coalesce(~raw.isin(FALSY_JSON), F.lit(False))


def has_value(text: Column, name: str) -> Column:
    """``is_truthy`` of a text. A text that holds neither the name nor an escape, which could
    spell it, has no such key and is not parsed."""
    may_have = F.contains(text, F.lit(name)) | F.contains(text, F.lit("\\"))
    return F.when(may_have, is_truthy(parse_doc(text), name)).otherwise(F.lit(False))


def is_null_doc(doc: Column) -> Column:
    return F.coalesce(F.to_json(doc) == "null", F.lit(False))


def _json_string(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def render_doc(text: Column, ocr: Column | None = None) -> Column:
    """Document text with two-space indent and, if given, ``ocr`` set.

    An existing ``ocr`` keeps its place, a new one goes last.
    """
    keys = F.json_object_keys(text)
    if ocr is None:
        keys = F.array_distinct(keys)
    else:
        keys = F.array_union(keys, F.array(F.lit("ocr")))
        new_value = _json_string(F.coalesce(ocr, F.lit("")))
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")

    def line(values: Column, key: Column) -> Column:
        value = F.to_json(F.element_at(values, key))
        if ocr is not None:
            value = F.when(key == "ocr", new_value).otherwise(value)
        return F.concat(F.lit("  "), _json_string(key), F.lit(": "), value)

    def body(doc: Column) -> Column:
        lines = F.transform(doc["keys"], lambda key: line(doc["fields"], key))
        joined = F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
        return F.when(F.size(doc["keys"]) == 0, F.lit("{}")).otherwise(joined)

    # one-element transform: binds keys and fields, so the text is parsed once
    # for each and not once per line
    parsed = F.array(F.struct(keys.alias("keys"), fields.alias("fields")))
    return F.get(F.transform(parsed, body), F.lit(0))


# Every character of a JSON text is in exactly one of these tokens: strings,
# structure, white space, other scalars.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|\s++|[^\s{}\[\],:"]++'
_PLACE = (
    "struct<at:int,depth:int,key:string,inside:boolean,start:int,stop:int,last:int,body:int,gap:string>"
)


def _is_ocr(token: Column) -> Column:
    escaped = F.contains(token, F.lit("\\"))
    spelled = F.try_variant_get(F.try_parse_json(F.when(escaped, token)), "$", "string")
    return (token == '"ocr"') | F.coalesce(spelled == "ocr", F.lit(False))


def _ocr_place(tokens: Column) -> Column:
    """Where the value of the last top-level ``ocr`` starts and stops (-1 without one), where the
    last member ends (``body``, -1 for an empty object) and the white space after the brace."""
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("depth"),
        F.lit("").alias("key"),
        F.lit(False).alias("inside"),
        F.lit(-1).alias("start"),
        F.lit(-1).alias("stop"),
        F.lit(-1).alias("last"),
        F.lit(-1).alias("body"),
        F.lit(None).cast("string").alias("gap"),
    ).cast(_PLACE)

    def step(acc: Column, token: Column) -> Column:
        after = acc["at"] + F.length(token)
        blank = F.regexp_like(token, F.lit(r"^\s"))
        top = acc["depth"] == 1
        colon, ends = top & (token == ":"), top & token.isin(",", "}")
        names = colon & _is_ocr(acc["key"])
        value = acc["inside"] & ~ends & ~blank
        depth = (
            acc["depth"]
            + F.when(token.isin("{", "["), 1).otherwise(0)
            - F.when(token.isin("}", "]"), 1).otherwise(0)
        )
        member = ~blank & (acc["depth"] >= 1) & ~(top & (token == "}"))
        return F.struct(
            after.alias("at"),
            depth.alias("depth"),
            F.when(top & ~blank, token).otherwise(acc["key"]).alias("key"),
            F.when(colon, names).otherwise(acc["inside"] & ~ends).alias("inside"),
            F.when(names, -1)
            .when(value & (acc["start"] < 0), acc["at"])
            .otherwise(acc["start"])
            .alias("start"),
            F.when(value, after).otherwise(acc["stop"]).alias("stop"),
            F.when(member, after).otherwise(acc["last"]).alias("last"),
            F.when(top & (token == "}"), acc["last"]).otherwise(acc["body"]).alias("body"),
            F.when(acc["gap"].isNull() & top, F.when(blank, token).otherwise(""))
            .otherwise(acc["gap"])
            .alias("gap"),
        ).cast(_PLACE)

    return F.aggregate(tokens, start, step)


# One object without objects inside, and no brace in any string.
_FLAT = r"^\s*+\{[^{}]*+\}\s*+$"
_BLANK = " \t\n\r"
# The same with a member right behind the first brace and right before the last one, and
# nothing around: what to_json writes.
_COMPACT = r"^\{(?![ \t\n\r])[^{}]++(?<![ \t\n\r])\}\z"


def _no_ocr(text: Column) -> Column:
    """Neither the name nor an escape, which could spell it, occurs in the text."""
    return ~(F.contains(text, F.lit("ocr")) | F.contains(text, F.lit("\\")))


def _is_plain(text: Column) -> Column:
    """A flat object that has no ``ocr``: neither the name nor an escape occurs in it."""
    return _no_ocr(text) & F.regexp_like(text, F.lit(_FLAT))


def _is_compact(text: Column) -> Column:
    """A plain object that ``to_json`` could have written: ``ocr`` goes before its last brace."""
    return _no_ocr(text) & F.regexp_like(text, F.lit(_COMPACT))


def _appended(text: Column, value: Column) -> Column:
    """A plain object with ``ocr`` behind its last member."""
    closed = F.rtrim(text, F.lit(_BLANK))
    body = F.rtrim(F.substring(closed, F.lit(1), F.length(closed) - 1), F.lit(_BLANK))
    inner = F.substring(F.ltrim(text, F.lit(_BLANK)), F.lit(2), F.length(text))
    gap = F.substring(inner, F.lit(1), F.length(inner) - F.length(F.ltrim(inner, F.lit(_BLANK))))
    colon = F.when(gap == "", F.lit('"ocr":')).otherwise(F.lit('"ocr": '))
    rest = F.substring(text, F.length(body) + 1, F.length(text))
    return F.when(F.endswith(body, F.lit("{")), F.concat(F.lit('{"ocr":'), value, F.lit("}"))).otherwise(
        F.concat(body, F.lit(","), gap, colon, value, rest)
    )


def merge_ocr(text: Column, ocr: Column) -> Column:
    """The document's own text with ``ocr`` set; all other characters stay as they are.

    The value of an existing top-level ``ocr`` is replaced (of several the last, which is
    the one that counts), a new one goes behind the last member, laid out like the first.
    A null ``ocr`` is the empty text. The result is null when the text is no object.
    """
    value = _json_string(F.coalesce(ocr, F.lit("")))
    place = _ocr_place(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)))

    def spliced(p: Column) -> Column:
        gap = F.coalesce(p["gap"], F.lit(""))
        colon = F.when(gap == "", F.lit(":")).otherwise(F.lit(": "))
        new = F.concat(gap, F.lit('"ocr"'), colon, value)
        return (
            F.when(
                p["start"] >= 0,
                F.concat(F.substring(text, F.lit(1), p["start"]), value, F.substring(text, p["stop"] + 1, F.length(text))),
            )
            .when(
                p["body"] >= 0,
                F.concat(
                    F.substring(text, F.lit(1), p["body"]),
                    F.lit(","),
                    new,
                    F.substring(text, p["body"] + 1, F.length(text)),
                ),
            )
            .otherwise(F.concat(F.lit('{"ocr":'), value, F.lit("}")))
        )

    # one-element transform: the text is scanned once and not once per use of a place
    merged = F.get(F.transform(F.array(place), spliced), F.lit(0))
    front = F.substring(text, F.lit(1), F.length(text) - 1)
    merged = (
        F.when(_is_compact(text), F.concat(front, F.lit(',"ocr":'), value, F.lit("}")))
        .when(_is_plain(text), _appended(text, value))
        .otherwise(merged)
    )
    return F.when(F.json_object_keys(text).isNotNull(), merged)
