"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavebook.llm import decontaminate, exact_dedup, fill_in_middle, hard_negatives, language, mixing, near_dedup
from wavebook.llm import quality, resharding, secret_scan, sql, suffix_dedup, suffix_tree_lm, url_filter
from wavebook.llm.common import table
from wavebook.plans.registry import Registry

registry = Registry()

NEW_SHARDS = 40
OLD_SHARDS = 32

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def old_shard(column: str):
    """The layout before resharding: a shard per hash of the source, so sizes differ much."""
    return F.pmod(F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")


@registry.query()
def op1_near_dedup_icws(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.near_dedup(documents, carry=["doc_id"])


@registry.query()
def op2_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language.fold("doc_id", 7) == 2
    rows = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("train"))
    return suffix_tree_lm.score(rows, "train", carry=["doc_id", "held_out"])


@registry.query()
def op3_reshard_min_cost_flow(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return resharding.reshard(
        documents.withColumn("was", old_shard("source")), NEW_SHARDS, "was", carry=["doc_id"]
    )


@registry.query(sql.MIX)
def op4_mix_low_discrepancy(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents, carry=["doc_id"])


@registry.query()
def op5_suffix_dedup_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(documents, carry=["doc_id"])


@registry.query()
def op6_quality_lsa_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(language.fold("doc_id", 5) != 0)
    model = quality.train(documents, labels)
    rows = documents.select("doc_id", "text", (language.fold("doc_id", 5) == 0).alias("held_out"))
    return quality.classify(rows, model, carry=["doc_id", "held_out"])


@registry.query()
def op7_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = (language.fold("doc_id", 5) == 0).alias("held_out")
    model = language.train(documents.where(~held_out))
    rows = documents.select("doc_id", "text", held_out)
    return language.identify(rows, model, carry=["doc_id", "held_out"])


@registry.query(sql.DECONTAMINATE)
def op8_decontaminate_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    benchmark = table(spark, folder, "benchmark")
    found = decontaminate.decontaminate(documents, benchmark, carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@registry.query(sql.URL_FILTER)
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    listed = [
        F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(action).alias("action"))
        for host, path, action in RULES
    ]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@registry.query(sql.EXACT_DEDUP)
def op10_exact_dedup_bloom(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(documents, carry=["doc_id"])


@registry.query(sql.HARD_NEGATIVES)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", own.alias("label"))
    return hard_negatives.hard_negatives(vectors, every=50)


@registry.query()
def op12_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return secret_scan.secret_scan(documents, carry=["doc_id"])


@registry.query(sql.FILL_IN_MIDDLE)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return fill_in_middle.fill_in_middle(documents, carry=["doc_id"])
