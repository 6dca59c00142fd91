"""From work items to refs: manifest lookup, component filter, content lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsondoc import field_text, is_null_doc, is_truthy, parse_doc
from docflow.functions.scalars import is_ref
from docflow.operators.contents import only_wanted
from docflow.session import spread


def load_manifests(items: DataFrame, tips: DataFrame) -> DataFrame:
    """Work items with the latest version of their entity.

    An entity that does not exist stays in the result with ``fetch_error`` set
    and, further on, no refs.
    """
    latest = tips.withColumnRenamed("entity", "pi")
    return items.join(spread(latest), "pi", "left").withColumn(
        "fetch_error",
        F.when(
            F.col("tip").isNull(),
            F.concat(F.lit("Entity "), F.col("pi").cast("string"), F.lit(" not found")),
        ),
    )


def explode_components(manifests: DataFrame) -> DataFrame:
    """Map-shaped manifests in long form: one row per file."""
    rest = [c for c in manifests.columns if c != "components"]
    return manifests.select(*rest, F.explode("components").alias("filename", "cid"))


def ref_components(components: DataFrame) -> DataFrame:
    """Only files that are ref documents; the test is case-sensitive."""
    return components.where(is_ref(F.col("filename")))


def lookup_contents(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """Join ref documents by content id and judge them.

    ``drop_reason`` is not_found, bad_json or no_url; null means the ref goes
    on, with ``cdn_url`` set. A content id shared by very many refs sits on the
    many-rows side of the join, where adaptive skew splitting applies. Of contents that
    are laid out by id only the folders of these refs are read. A content is parsed and judged
    once, before the join, and not once per ref and use.
    """
    contents = _judged(only_wanted(contents, refs))
    missing = F.when(F.col("content").isNull(), "not_found")
    return (
        refs.join(contents, "cid", "left")
        .withColumn("drop_reason", missing.otherwise(F.col("_reason")))
        .withColumn("cdn_url", F.when(F.col("drop_reason").isNull(), F.col("_url")))
        .drop("_reason", "_url")
    )


def _judged(contents: DataFrame) -> DataFrame:
    """Contents with the reason to drop them and their address.

    The one-element arrays bind the parsed document; they are exploded, as a filter on the
    reason would otherwise be moved below and parse the text once more.
    """

    def judge(doc: Column) -> Column:
        reason = F.when(doc.isNull() | is_null_doc(doc), "bad_json").when(
            ~is_truthy(doc, "url"), "no_url"
        )
        return F.struct(reason.alias("_reason"), field_text(doc, "url").alias("_url"))

    found = F.transform(F.array(parse_doc(F.col("content"))), judge)
    return contents.select("*", F.inline(found))


def wanted_files(items: DataFrame, components: DataFrame) -> DataFrame:
    """Ref files of the items. ``components`` is the latest manifest in long form
    (entity, filename, cid)."""
    return ref_components(components).withColumnRenamed("entity", "pi").join(items, "pi")


def discover_refs(items: DataFrame, components: DataFrame, contents: DataFrame) -> DataFrame:
    """Refs to work on."""
    return refs_of(wanted_files(items, components), contents)


def refs_of(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Files whose documents can be worked on, with the documents."""
    found = lookup_contents(files, contents)
    return (
        found.where(F.col("drop_reason").isNull())
        .drop("drop_reason")
        .withColumnRenamed("cid", "original_cid")
        .withColumnRenamed("content", "ref_data_json")
    )


def discovery_totals(items: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk: entities, refs found, entities without any ref."""
    per_pi = refs.groupBy("pi").agg(F.count(F.lit(1)).alias("n"))
    return (
        items.join(spread(per_pi), "pi", "left")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_pis"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_refs"),
            F.count_if(F.col("n").isNull()).alias("pis_without_refs"),
        )
    )


def split_enriched(refs: DataFrame, doc: str = "ref_data_json") -> tuple[DataFrame, DataFrame]:
    """(refs whose document has a non-empty ``ocr``, refs still to do)."""
    has_text = is_truthy(parse_doc(F.col(doc)), "ocr")
    return refs.where(has_text), refs.where(~has_text)
