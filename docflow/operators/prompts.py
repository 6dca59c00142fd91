"""Prompt texts from ordered content items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.session import spread


def item_text(kind: Column, source: Column, content: Column) -> Column:
    return F.concat(
        F.lit("## "), F.upper(kind), F.lit(": "), source.cast("string"), F.lit("\n"), content
    )


def head_line(name: Column, depth: Column) -> Column:
    return F.concat(
        F.lit("Directory: "), name.cast("string"), F.lit(" (depth "), depth.cast("string"), F.lit(")")
    )


def prompt_lines(
    items: DataFrame, keys: list[str], ord_col: str, name: Column, depth: Column
) -> DataFrame:
    """Prompts as one row per piece: keys, ``piece`` and ``line``.

    Piece 0 of a group is its head line, whatever its items' numbers start with;
    the items follow in the order of ``ord_col``. Pieces joined by blank lines are the
    prompt. The form is the same for a group of any size, and no task has to
    hold a group. ``name`` and ``depth`` must be the same for all rows of a group.
    """
    groups = items.groupBy(*keys).agg(
        F.min(ord_col).alias("_first"), F.first(head_line(name, depth)).alias("line")
    )
    heads = groups.select(*keys, F.lit(0).cast("long").alias("piece"), "line")
    placed = items.join(spread(groups.select(*keys, "_first")), keys)
    piece = (F.col(ord_col) - F.col("_first") + 1).cast("long")
    return heads.unionByName(placed.select(*keys, piece.alias("piece"), F.col("item").alias("line")))
