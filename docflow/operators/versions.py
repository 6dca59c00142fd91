"""Entity versions: tips, manifest merge, publish plan, compare-and-swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.scalars import network_tag, version_note
from docflow.operators.ordered import dense_index
from docflow.session import durable, spread

CAS_TRIES = 3


def entity_tip(
    versions: DataFrame, order: Column | str = "ver", ver: Column | None = None
) -> DataFrame:
    """Latest tip and version number of each entity.

    Where versions carry no number, give their ``order`` and the aggregate that
    yields the latest number (such as a count).
    """
    order = F.col(order) if isinstance(order, str) else order
    ver = F.max("ver") if ver is None else ver
    return versions.groupBy("entity").agg(F.max_by("tip", order).alias("tip"), ver.alias("ver"))


def only_entities(df: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the entities that ``items`` names, before anything is aggregated:
    a small batch of requests then costs no shuffle of the whole table."""
    wanted = items.select(F.col("pi").alias("entity")).distinct()
    return df.join(spread(wanted), "entity", "left_semi")


def manifest_merge(components: DataFrame, order: Column | str = "ver") -> DataFrame:
    """Latest content per entity and file name over all versions.

    Long form: no map per entity has to fit in memory, and the maximum is
    combined before the shuffle.
    """
    order = F.col(order) if isinstance(order, str) else order
    return components.groupBy("entity", "filename").agg(F.max_by("cid", order).alias("cid"))


def publishable(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("status").isin("done", "skipped") & F.col("result_cid").isNotNull())


def publish_heads(pis: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entity: component count and note; no note, no new version."""
    counts = publishable(refs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_components"))
    return (
        pis.select(*keys)
        .join(counts, keys, "left")
        .withColumn("note", version_note(F.col("n_components")))
        .fillna(0, ["n_components"])
    )


def publish_plan(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Components to publish in long form, each with its entity's note."""
    parts = publishable(refs).select(*keys, "filename", "result_cid")
    notes = parts.groupBy(*keys).agg(version_note(F.count(F.lit(1))).alias("note"))
    return parts.join(spread(notes), keys)


def next_tip(entity: Column, ver: Column, *update_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in (entity, ver, *update_id)]), 256)


def cas_plan(updates: DataFrame, tips: DataFrame, tries: int = CAS_TRIES) -> DataFrame:
    """Which updates commit, in which round, and which end as conflicts.

    The tries are for tips that another writer moved; updates planned on
    current tips go through ``chain_updates``, which has no such limit.

    Each round one update per entity commits: in round 1 the first by
    ``update_id`` whose ``expect_tip`` is the current tip, afterwards the first
    of the rest, since all others then hold a refreshed tip. An update not
    committed after ``tries`` rounds is a conflict.

    No iteration is needed: only the first ``tries`` updates of an entity and
    its round-1 winner can commit. Both are found with map-side reduction, and
    the decision goes back to the rows on (entity, update_id), a key that is
    spread evenly even if one entity gets a third of all updates. The updates
    with their current tips are checkpointed, because three branches read them.
    """
    current = tips.select("entity", F.col("tip").alias("cur_tip"), F.col("ver").alias("cur_ver"))
    base = durable(updates.join(spread(current), "entity", "left"))
    known = base.where(F.col("cur_tip").isNotNull())
    slim = known.select("entity", "update_id", "cur_tip", "cur_ver")
    fresh = (
        known.where(F.col("expect_tip") == F.col("cur_tip"))
        .groupBy("entity", "cur_tip", "cur_ver")
        .agg(F.min("update_id").alias("update_id"))
        .withColumn("direct", F.lit(True))
    )
    by_id = Window.partitionBy("entity").orderBy("update_id")
    head = slim.withColumn("_rank", F.row_number().over(by_id)).where(F.col("_rank") <= tries)

    # at most tries + 1 rows per entity from here to the join back
    candidates = (
        head.drop("_rank")
        .withColumn("direct", F.lit(False))
        .unionByName(fresh)
        .groupBy("entity", "update_id", "cur_tip", "cur_ver")
        .agg(F.max("direct").alias("direct"))
    )
    turn = Window.partitionBy("entity").orderBy(F.col("direct").desc(), "update_id")
    late = F.when(F.max("direct").over(Window.partitionBy("entity")), 0).otherwise(1)
    won = (
        candidates.withColumn("nth", F.row_number().over(turn).cast("long"))
        .withColumn("round", (F.col("nth") + late).cast("long"))
        .where(F.col("round") <= tries)
        .withColumn("new_version", F.col("cur_ver") + F.col("nth"))
        .withColumn("new_tip", next_tip(F.col("entity"), F.col("new_version"), F.col("update_id")))
    )
    last_tip = F.lag("new_tip").over(Window.partitionBy("entity").orderBy("nth"))
    won = won.withColumn("prev_tip", F.coalesce(last_tip, "cur_tip")).select(
        "entity", "update_id", "round", "new_version", "new_tip", "prev_tip"
    )

    committed = F.col("round").isNotNull()
    name = F.col("entity").cast("string")
    return (
        base.join(won, ["entity", "update_id"], "left")
        .withColumn("committed", committed)
        .withColumn(
            "entity_error",
            F.when(committed, F.lit(None).cast("string"))
            .when(F.col("cur_tip").isNotNull(), F.concat(F.lit("CAS failure for "), name))
            .otherwise(F.concat(F.lit("Entity not found: "), name)),
        )
        .drop("cur_tip", "cur_ver")
    )


def chain_updates(
    updates: DataFrame, tips: DataFrame, update_keys: list[str] | None = None
) -> DataFrame:
    """Versions for updates that are planned on the current tips: all commit.

    The updates of an entity follow each other in the order of ``update_keys``
    (default ``update_id``), each on top of the one before. Only an entity without
    a tip fails. The version is the tip's plus the rank among the entity's
    updates: a global rank minus the entity's first one, so an entity with a third of all
    updates is spread over many tasks.
    """
    update_keys = update_keys or ["update_id"]
    order = [F.col(c) for c in ("entity", *update_keys)]
    ranked = durable(dense_index(updates, order, "_rank"))
    first = ranked.groupBy("entity").agg(F.min("_rank").alias("_first"))
    current = tips.select("entity", F.col("tip").alias("cur_tip"), F.col("ver").alias("cur_ver"))
    heads = durable(first.join(current, "entity", "left"))
    base = ranked.join(spread(heads), "entity")
    committed = F.col("cur_tip").isNotNull()
    version = F.col("cur_ver") + F.col("_rank") - F.col("_first") + 1
    # the row before it in the global order is the entity's version before; its keys
    # are joined, and its tip is made again from them, as tips are long and do not compress
    before = {c: f"_before_{i}" for i, c in enumerate(update_keys)}
    last = base.select(
        (F.col("_rank") + 1).alias("_rank"), *[F.col(c).alias(b) for c, b in before.items()]
    )
    last_tip = next_tip(
        F.col("entity"), F.col("new_version") - 1, *[F.col(b) for b in before.values()]
    )
    tip = next_tip(F.col("entity"), F.col("new_version"), *[F.col(c) for c in update_keys])
    name = F.col("entity").cast("string")
    return (
        base.join(last, "_rank", "left")
        .withColumn("new_version", F.when(committed, version))
        .withColumn("new_tip", F.when(committed, tip))
        .withColumn("committed", committed)
        .withColumn(
            "prev_tip",
            F.when(F.col("_rank") == F.col("_first"), F.col("cur_tip")).when(committed, last_tip),
        )
        .withColumn(
            "entity_error",
            F.when(~committed, F.concat(F.lit("Entity not found: "), name)),
        )
        .drop("cur_tip", "cur_ver", "_rank", "_first", *before.values())
    )


def version_rows(plan: DataFrame) -> DataFrame:
    """Rows to append to the versions table for the committed part of a plan."""
    return plan.where("committed").select(
        "entity",
        F.col("new_version").alias("ver"),
        F.col("new_tip").alias("tip"),
        "prev_tip",
        "note",
        network_tag(F.col("entity").cast("string")).alias("network"),
        "n_components",
    )
