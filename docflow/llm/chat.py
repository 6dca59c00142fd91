"""Chat formatting with a grammar round trip.

A conversation becomes ``<s>`` and its turns:

    user       [INST] text [/INST]
    assistant  [OUT] text </s>
    others     [ROLE] role [TEXT] text [/ROLE]

The parser cuts the result at control strings and reads the turns back. If they are
not the source's, roles and texts are escaped and the conversation is rendered
again: first only control strings and ``&``, then each ``<``, ``[`` and ``&``. Escaped
conversations start with ``<s>[ESC]``, so the parser knows whether to undo it. The
last form holds no control string inside a text, so it always comes back identical.
All steps are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]", "[ESC]")
_ENTITIES = {"<": "&lt;", "[": "&#91;"}
_ANY = "|".join(c.replace("[", "\\[").replace("]", "\\]") for c in CONTROLS)
_CUT = f"(?={_ANY})|(?<={_ANY})"
LEVELS = 3


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _escaped(text: Column, level: int) -> Column:
    if level == 0:
        return text
    strings = CONTROLS if level == 1 else tuple(_ENTITIES)
    return _replaced(text, [("&", "&amp;")] + [(s, _ENTITIES[s[0]] + s[1:]) for s in strings])


def _unescaped(text: Column) -> Column:
    return _replaced(text, [(v, k) for k, v in _ENTITIES.items()] + [("&amp;", "&")])


def _render(turns: Column, level: int) -> Column:
    def one(turn: Column) -> Column:
        role, text = _escaped(turn["role"], level), _escaped(turn["text"], level)
        return (
            F.when(turn["role"] == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(turn["role"] == "assistant", F.concat(F.lit("[OUT] "), text, F.lit(" </s>")))
            .otherwise(
                F.concat(
                    F.lit("[ROLE] "), role, F.lit(" [TEXT] "), text, F.lit(" [/ROLE]")
                )
            )
        )

    head = "<s>[ESC]" if level else "<s>"
    return F.concat(F.lit(head), F.array_join(F.transform(turns, one), ""))


def parts(formatted: Column) -> Column:
    """The formatted text cut at control strings, which stay as parts."""
    return F.filter(F.split(formatted, _CUT), lambda part: part != "")


def _is_escaped(cut: Column) -> Column:
    return F.coalesce(F.try_element_at(cut, F.lit(2)) == "[ESC]", F.lit(False))


def _inner(part: Column) -> Column:
    """A part without the blank on either side."""
    return F.substring(part, F.lit(2), F.length(part) - 2)


def parsed(cut: Column) -> Column:
    """Turns (role, text) of a conversation cut by ``parts``; null if it has no such form."""
    places = F.filter(
        F.sequence(F.lit(1), F.size(cut)),
        lambda i: F.element_at(cut, i).isin("[INST]", "[OUT]", "[ROLE]"),
    )
    undo = _is_escaped(cut)

    def read(i: Column, ahead: int) -> Column:
        text = _inner(F.coalesce(F.try_element_at(cut, i + ahead), F.lit("")))
        return F.when(undo, _unescaped(text)).otherwise(text)

    def one(i: Column) -> Column:
        mark = F.element_at(cut, i)
        role = (
            F.when(mark == "[INST]", F.lit("user"))
            .when(mark == "[OUT]", F.lit("assistant"))
            .otherwise(read(i, 1))
        )
        text = F.when(mark == "[ROLE]", read(i, 3)).otherwise(read(i, 1))
        return F.struct(role.alias("role"), text.alias("text"))

    wanted = F.aggregate(
        places,
        F.when(undo, F.lit(2)).otherwise(F.lit(1)),
        lambda n, i: n + F.when(F.element_at(cut, i) == "[ROLE]", 5).otherwise(3),
    )
    return F.when(F.size(cut) == wanted, F.transform(places, one))


def loss_spans(cut: Column) -> Column:
    """[start, stop) code points of the assistant texts in the formatted text."""
    kind = "struct<at:int,open:boolean,spans:array<struct<start:int,stop:int>>>"
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(False).alias("open"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("spans"),
    ).cast(kind)

    def step(acc: Column, part: Column) -> Column:
        after = acc["at"] + F.length(part)
        span = F.struct((acc["at"] + 1).alias("start"), (after - 1).alias("stop"))
        return F.struct(
            after.alias("at"),
            (part == "[OUT]").alias("open"),
            F.when(acc["open"], F.array_append(acc["spans"], span))
            .otherwise(acc["spans"])
            .alias("spans"),
        ).cast(kind)

    return F.aggregate(cut, start, step, lambda acc: acc["spans"])


def loss_text(formatted: Column, cut: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone."""
    masked = F.transform(
        spans, lambda s: F.substring(formatted, s["start"] + 1, s["stop"] - s["start"])
    )
    undo = _is_escaped(cut)
    return F.array_join(
        F.transform(masked, lambda t: F.when(undo, _unescaped(t)).otherwise(t)), ""
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, escape_level) of each conversation.

    ``rows`` has conv_id, turn, role and text. Turns are ordered by turn, role and
    text, missing turn numbers first; repeated rows are repeated turns. A null role
    or text is empty. Rows without conv_id form one conversation. A conversation is
    one result row, so all its turns meet there; different conversations do not.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    source = gathered.select(
        "conv_id",
        F.transform(
            "_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
        ).alias("turns"),
    )
    tried = source
    for level in range(LEVELS - 1):
        done = F.col("formatted").isNotNull() if level else F.lit(False)
        tried = tried.withColumn(
            "attempt", F.when(~done, _render(F.col("turns"), level))
        ).withColumn("cut", parts(F.col("attempt")))
        same = F.coalesce(parsed(F.col("cut")) == F.col("turns"), F.lit(False))
        before = F.col("formatted") if level else F.lit(None).cast("string")
        before_level = F.col("escape_level") if level else F.lit(None).cast("int")
        tried = (
            tried.withColumn("same", same)
            .withColumn("formatted", F.coalesce(before, F.when(F.col("same"), F.col("attempt"))))
            .withColumn("escape_level", F.coalesce(before_level, F.when(F.col("same"), level)))
        )
    last = F.coalesce("formatted", _render(F.col("turns"), LEVELS - 1))
    return (
        tried.select(
            "conv_id",
            last.alias("formatted"),
            F.coalesce("escape_level", F.lit(LEVELS - 1)).alias("escape_level"),
        )
        .withColumn("cut", parts(F.col("formatted")))
        .select("conv_id", "formatted", loss_spans(F.col("cut")).alias("loss_mask"), "escape_level")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from formatted texts and their masks alone."""
    opened = formatted.withColumn("cut", parts(F.col("formatted"))).select(
        "conv_id",
        "formatted",
        "escape_level",
        parsed(F.col("cut")).alias("turns"),
        loss_text(F.col("formatted"), F.col("cut"), F.col("loss_mask")).alias("loss"),
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return opened.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escape_level",
    )
