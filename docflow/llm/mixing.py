"""Mixing sources to target weights by temperature.

Source shares p of all tokens are raised to an exponent a between 0 (uniform) and 1
(as they are) and normalised. The exponent is bisected on a fixed grid: the largest
whose entropy still reaches a target, raised as far as a repetition limit asks. Weights are then
realised: a source of weight w and budget B gives w * B tokens as whole passes and one part
of a pass over its documents. Each pass is a permutation of its own (the order of a
hash of document and pass); the part pass is cut at the hash where the budget ends. A row's
place in its source's stream, between 0 and 1, is read off pass and hash, and
the output is dealt into blocks of equal budget by that place, so each block has
the target weights. No text is shuffled: what decides is one small row per source.
All steps are DataFrame operations; the bisection asks Spark for sums over sources.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import saved, shielded

GRID_BITS = 20
#: Levels of the bisection that one job settles.
LEVELS_PER_JOB = 5
HASH_BITS = 60
#: Tokens of a cell, the unit in which the end of a part pass is looked for.
CELL_TOKENS = 1_000_000
#: Sources up to which their plan is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 100_000
WORDS = "[^ \\t-\\r]+"


@dataclass(frozen=True)
class Recipe:
    """Target of a mixture.

    ``entropy``: wanted share of the largest possible entropy (None: no target).
    ``max_passes``: no source is read more often (None: no limit). With a limit alone the
    mixture is as even as the limit lets it be; with neither, shares stay as they are.
    ``budget``: tokens to give out (None: as many as there are; ``"cover"``: as many as it
    takes to read each source at least once).
    ``block_tokens``: tokens of an output block.
    """

    entropy: float | None = 0.95
    max_passes: float | None = 4.0
    budget: int | str | None = None
    block_tokens: int = 1_000_000
    seed: str = "mix"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _hash(key: Column, turn: Column, seed: str) -> Column:
    """A number below 2**60 for a document and a pass."""
    text = F.concat_ws("|", F.lit(seed), turn.cast("string"), key)
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _first_true(shares: DataFrame, test: Column) -> int:
    """Smallest grid number for which ``test`` of the sums holds; it holds from there on.

    ``test`` uses columns z, s (sums of p^a and of p^a ln p), low and high (least and
    largest p^(a-1)) of each exponent.
    """
    low, high = 0, (1 << GRID_BITS) + 1  # the last stands for none
    while low < high:
        width = max(1, (high - low) >> LEVELS_PER_JOB)
        marks = list(range(low, high, width))
        grid = F.array(*[F.lit(m).cast("long") for m in marks])  # at most 33 exponents
        a = F.col("mark") / (1 << GRID_BITS)
        tested = (
            shares.select("p", F.explode(grid).alias("mark"))
            .groupBy("mark")
            .agg(
                F.sum(F.pow("p", a)).alias("z"),
                F.sum(F.pow("p", a) * F.log("p")).alias("s"),
                F.max(F.pow("p", a - 1)).alias("high"),
                F.min(F.pow("p", a - 1)).alias("low"),
            )
            .where(test)
            .agg(F.min("mark"))
            .first()[0]
        )
        if tested is None:
            low = marks[-1] + 1
        else:
            high, low = tested, max(low, tested - width + 1)
    return low


def exponent(shares: DataFrame, recipe: Recipe) -> float:
    """The exponent for source shares ``p`` (all above zero)."""
    top = 1 << GRID_BITS
    known = shares.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    if not known.n:
        return 1.0
    a = F.col("mark") / top
    chosen = top if recipe.max_passes is None else 0
    if recipe.entropy is not None:
        entropy = F.log("z") - a * F.col("s") / F.col("z")
        chosen = _first_true(shares, entropy < recipe.entropy * math.log(max(known.n, 1))) - 1
        chosen = max(0, min(top, chosen))
    if recipe.max_passes is not None:
        if recipe.budget == "cover":
            passes = F.col("high") / F.col("low")
        else:
            times = (known.t if recipe.budget is None else recipe.budget) / known.t
            passes = times * F.col("high") / F.col("z")
        least = _first_true(shares, passes <= recipe.max_passes * (1 + 1e-12))
        chosen = max(chosen, min(top, least))
    return chosen / top


def _plans(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per source: weight, whole passes, and where its part pass ends."""
    sizes = saved(rows.groupBy("mix_source").agg(F.sum("n_tokens").alias("tokens")), "mix-sizes")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    shares = sizes.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(max(total, 1)))
    a = exponent(shares, recipe)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    if recipe.budget == "cover":
        budget = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        budget = float(total if recipe.budget is None else recipe.budget)
    quota = F.floor(F.col("weight") * F.lit(budget) * (1 + 1e-12) + 1e-6)
    cells = F.greatest(F.lit(1), F.ceil(F.col("tokens") / CELL_TOKENS)).cast("long")
    plans = weighted.select(
        "mix_source",
        "weight",
        F.floor(quota / F.col("tokens")).cast("long").alias("whole"),
        (quota % F.col("tokens")).cast("long").alias("part"),
        (quota / F.col("tokens")).alias("passes"),
        cells.alias("cells"),
        F.lit(float(budget)).alias("budget"),
    )
    plans = saved(plans, "mix-plans")
    cut = saved(_cuts(rows, plans), "mix-cuts")
    # sources without tokens cost nothing and pass once
    free = sizes.where("tokens = 0").select(
        "mix_source",
        F.lit(0.0).alias("weight"),
        F.lit(1).cast("long").alias("whole"),
        F.lit(1.0).alias("passes"),
        F.lit(float(budget)).alias("budget"),
        F.lit(None).cast("long").alias("last_hash"),
    )
    kept = plans.join(cut, "mix_source", "left").select(
        "mix_source", "weight", "whole", "passes", "budget", "last_hash"
    )
    return saved(kept.unionByName(free), "mix-plan")


def _cuts(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix_source, last_hash): the part pass takes documents up to this hash.

    Tokens are summed per cell of the hash range; only documents of the cell in
    which the budget ends are put in order. Equal hashes stay together.
    """
    wanted = plans.where("part > 0").select("mix_source", "whole", "part", "cells")
    placed = (
        rows.select("mix_source", "mix_key", "n_tokens")
        .join(_small(wanted), "mix_source")
        .withColumn("h", _hash(F.col("mix_key"), F.col("whole") + 1, "pass"))
        .withColumn(
            "cell",
            F.shiftright(F.shiftright("h", HASH_BITS - 30) * F.col("cells"), 30),
        )
    )
    sums = placed.groupBy("mix_source", "cell").agg(
        F.sum("n_tokens").alias("n"), F.first("part").alias("part")
    )
    order = Window.partitionBy("mix_source").orderBy("cell")
    ends = (
        sums.withColumn("until", F.sum("n").over(order))
        .withColumn("left", F.col("part") - F.col("until") + F.col("n"))
        .where((F.col("until") > F.col("part")) & (F.col("left") >= 0))
        .select("mix_source", "cell", "left")
    )
    ends = saved(ends, "mix-ends")
    inside = placed.join(_small(ends), ["mix_source", "cell"]).select(
        "mix_source", "cell", "cells", "left", "h", "n_tokens"
    )
    running = Window.partitionBy("mix_source").orderBy("h").rangeBetween(
        Window.unboundedPreceding, 0
    )
    fits = (F.col("until") <= F.col("left")) & (F.col("left") > 0)
    below = F.shiftleft(F.ceil(F.col("cell") * F.lit(float(1 << 30)) / F.col("cells")), 30) - 1
    return (
        inside.withColumn("until", F.sum("n_tokens").over(running))
        .groupBy("mix_source")
        .agg(F.max(F.when(fits, F.col("h"))).alias("fit"), F.max(below).alias("below"))
        .select("mix_source", F.coalesce("fit", "below").alias("last_hash"))
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if it is short; else let Spark choose."""
    short = df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return F.broadcast(df) if short else df


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``mix_key``, by which they are placed: the id, if one row has it.

    Rows that share an id, or have none, are told apart by their text and a number.
    They are written once, so that every branch reads the same numbers.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.withColumn("mix_key", key)
    sizes = docs.groupBy("mix_key").agg(F.count(F.lit(1)).alias("n"))
    again = saved(sizes.where("n > 1").select("mix_key"), "mix-again")
    if again.isEmpty():
        return docs
    number = F.monotonically_increasing_id().cast("string")
    told = F.concat_ws("|", "mix_key", F.xxhash64("text").cast("string"), number)
    several = docs.join(again, "mix_key", "left_semi").withColumn("mix_key", told)
    return docs.join(again, "mix_key", "left_anti").unionByName(saved(several, "mix-several"))


def mixed(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """The rows of the mixture: all columns of ``docs`` and mix_source, mix_pass, mix_weight,
    mix_tokens, mix_block. A document that is read twice is in two rows.

    Documents need doc_id, text and source. A null source is the source with
    the empty name; null texts have no tokens. Rows with the same doc_id, or
    without one, have places of their own. Columns of the new names are replaced. No
    rows: no result.
    """
    recipe = recipe or Recipe()
    docs, names = shielded(docs.drop(*NEW), ("doc_id", "text", "source"))
    docs = _keyed(docs)
    key = F.col("mix_key")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    slim = saved(
        docs.select(
            key.alias("mix_key"), source.alias("mix_source"), n_words(F.col("text")).alias("n_tokens")
        ),
        "mix-rows",
    )
    plan = _plans(slim, recipe)
    budget = plan.agg(F.max("budget")).first()[0] or 0.0
    blocks = max(1, math.ceil(budget / recipe.block_tokens))
    planned = docs.withColumn("mix_source", source)
    planned = planned.join(_small(plan), "mix_source")
    last = _hash(key, F.col("whole") + 1, "pass")
    taken = F.col("whole") + F.when(last <= F.col("last_hash"), 1).otherwise(0)
    turns = F.when(taken > 0, F.sequence(F.lit(1).cast("long"), taken))
    place = (
        F.col("mix_pass") - 1 + _hash(key, F.col("mix_pass"), "pass") / float(1 << HASH_BITS)
    ) / F.greatest(F.col("passes"), F.col("whole").cast("double"))
    return (
        planned.withColumn("mix_pass", F.explode(turns))
        .withColumn("mix_block", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("long"))
        .withColumn("mix_tokens", n_words(F.col("text")))
        .select(
            *[F.col(inner).alias(c) for c, inner in names.items()],
            "mix_source",
            "mix_pass",
            F.col("weight").alias("mix_weight"),
            "mix_tokens",
            "mix_block",
        )
    )


NEW = ("mix_source", "mix_pass", "mix_weight", "mix_tokens", "mix_block")


def schedule(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """(doc_id, source, mix_pass, mix_tokens, mix_block, mix_rank): who goes where.

    Ranks order the documents of a block by another hash; a block holds about
    ``block_tokens`` tokens of all sources together.
    """
    rows = mixed(docs, recipe)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    order = Window.partitionBy("mix_block").orderBy("h", "doc_id", "mix_pass", "source", "mix_tokens")
    return (
        rows.withColumn("h", _hash(key, F.col("mix_pass"), "rank"))
        .withColumn("mix_rank", F.row_number().over(order).cast("long"))
        .select("doc_id", "source", "mix_pass", "mix_tokens", "mix_block", "mix_rank")
    )
