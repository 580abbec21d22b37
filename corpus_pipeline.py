"""A corpus pipeline of five stages over ``documents``.

Every stage takes what its predecessor kept, written as Parquet and read again:
language identification drops texts without letters, near dedup keeps one document
of a class, decontamination drops documents with benchmark passages, mixing repeats
or drops documents so that sources come near their targets, and sharding places the
rows in forty shards of nearly equal bytes. All but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavebook.llm import decontaminate, language, mixing, near_dedup, resharding
from wavebook.llm.common import store, table
from wavebook.llm.queries import NEW_SHARDS, old_shard
from wavebook.session import scratch_path

# The number of a row: the hash of its file's path, and its place in the file.
ROW = ["file", "place"]


class _Docs:
    """Documents under column names that no operator uses, so that columns of any name come through."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*self.hidden)

    @property
    def hidden(self) -> list[str]:
        return [f"_doc_{i}" for i in range(len(self.names))]

    def column(self, name: str) -> str:
        lowered = [c.lower() for c in self.names]
        return f"_doc_{self.names.index(name) if name in self.names else lowered.index(name)}"

    def back(self, found: DataFrame, **more: str) -> DataFrame:
        """Rows of ``found`` with the columns under their own names, and ``more``, which replace those of one name."""
        own = [F.col(h).alias(c) for h, c in zip(self.hidden, self.names) if c.lower() not in more]
        return found.select(*own, *[F.col(c).alias(name) for name, c in more.items()])


class _Numbered(_Docs):
    """Documents with a number for each row that is the same on every read.

    A row of a Parquet file is known by the file and its place there, however the reads are
    split, so nothing is stored. Rows that come from elsewhere are stored once with a number.
    """

    def __init__(self, docs: DataFrame):
        super().__init__(docs)
        own = [F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, self.hidden)]
        try:
            at = docs.metadataColumn("_metadata")
            self.rows = docs.select(
                *own, F.xxhash64(at.getField("file_path")).alias("file"), at.getField("row_index").alias("place")
            )
        except AnalysisException:
            self.rows = store(self.rows.withColumns({"file": F.lit(0).cast("bigint"), "place": F.monotonically_increasing_id()}))

    def select(self, *names: str) -> DataFrame:
        """Row numbers and the columns that an operator needs, under the names it knows."""
        return self.rows.select(*ROW, *[F.col(self.column(n)).alias(n) for n in names])

    def join(self, decided: DataFrame) -> DataFrame:
        """Rows with what was decided for their numbers."""
        return self.rows.join(decided, ROW)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told. The model learns from all rows with a ``lang``.

    Null texts and texts without letters go. Without any ``lang`` nothing can be
    learned and all documents go.
    """
    own = _Docs(docs)
    text = own.column("text")
    model = language.train(own.rows, text=text, lang=own.column("lang"))
    found = language.identify(own.rows, model, text=text)
    return own.back(found.where(F.col("lang_pred") != language.UNKNOWN))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class: the one with the smallest id."""
    own = _Numbered(docs)
    found = near_dedup.near_dedup(own.select("doc_id", "text"), carry=ROW)
    return own.back(own.join(found.where("kept").select(*ROW)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    own = _Docs(docs)
    found = decontaminate.decontaminate(own.rows, table(spark, sf_dir, "benchmark"), text=own.column("text"))
    return own.back(found.where(~F.col("contaminated")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes the block with their first word."""
    own = _Numbered(docs)
    found = mixing.mix(own.select("doc_id", "text", "source"), carry=ROW)
    taken = own.join(found.where("copies > 0").select(*ROW, "copies"))
    return own.back(taken.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the ``shard`` and ``slot`` they move to, from shards by source.

    ``size``, ``shard`` and ``slot`` replace input columns of the same name.
    """
    own = _Numbered(docs)
    rows = own.select("doc_id", "text", "source").withColumn("was", old_shard("source"))
    found = resharding.reshard(rows, NEW_SHARDS, "was", carry=ROW)
    return own.back(own.join(found.select(*ROW, "size", "shard", "slot")), size="size", shard="shard", slot="slot")


STAGES = [
    ("language identification", identify_language),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Expectation-maximisation and sampling are not for SQL; the tests hold the rows
# against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``, tables between stages in the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{n}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
