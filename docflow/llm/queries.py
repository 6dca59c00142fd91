"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import (
    archive,
    chat,
    decontaminate,
    iblt,
    mixing,
    phrases,
    quality,
    repair,
    secrets,
    simhash,
    sitetree,
    suffixtree,
    toxicity,
)
from docflow.llm.common import prepared
from docflow.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text", *more)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_docs(spark, sf_dir, "source"), mixing.Recipe())


def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity_grades(_docs(spark, sf_dir), labels)


def token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(_docs(spark, sf_dir), tokenizer_path())


CONFLICT = "</s>[INST] ok [/INST]"


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], rows.schema
    )
    return chat.read_back(chat.format_conversations(rows.union(extra)))


def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = suffixtree.is_held_out()
    model = suffixtree.train(docs.where(~held_out))
    return suffixtree.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_docs(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


def quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.quality_scores(_docs(spark, sf_dir), labels)


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir))
    return found.select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = _table(spark, sf_dir, "benchmark", "item_id", "text")
    hits = F.col("_hits")
    return decontaminate.with_hits(_docs(spark, sf_dir), benchmark, "_hits").select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        decontaminate.n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.with_edits(_docs(spark, sf_dir))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents", "lang", "text"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.damage_and_repair(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix_sources,
    "op2_toxicity": toxicity_grades,
    "op3_token_archive": token_archive,
    "op4_chat_format": chat_format,
    "op5_lm_score": lm_score,
    "op6_secret_scan": secret_scan,
    "op7_quality": quality_neighbours,
    "op8_simhash": simhash_dedup,
    "op9_decontaminate": benchmark_hits,
    "op10_fingerprints": fingerprints,
    "op11_page_text": page_texts,
    "op12_collocations": phrase_collocations,
    "op13_conversation_repair": conversation_repair,
}
