"""From raw documents to training tokens: five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with
the columns of documents, the last one with token ids. run() writes each stage's result to the
shared folder and starts the next one from there, so that a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from trackmill.llm.common import release, store, stored_so_far, table
from trackmill.llm.registry import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stage before left in the shared folder, for each thread.
_left: ContextVar = ContextVar("left", default=())


def stage(f: Stage) -> Stage:
    """Before a stage begins, the tables that the stage before it left in the shared folder go: its result has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, list(_left.get()), docs)
        before = len(stored_so_far())
        out = f(spark, docs, sf_dir)
        _left.set(tuple(stored_so_far()[before:]))
        return out

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior of the rules' votes accept."""
    return quality_rules.judge(docs).where("quality.kept").select(*docs.columns)


@stage
def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; a document of which nothing is left goes, n_chars follows the text."""
    found = line_dedup.dedup(docs).where("dedup.n_deleted = 0 or text <> ''")
    return found.withColumn("n_chars", F.when(F.col("dedup.n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    stamped = store(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    first = jaccard_join.near_duplicates(stamped, row="__row").where("first").select(F.col("__uid").alias("__row"))
    return stamped.join(first, "__row", "left_semi").select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the sources' schedule: written files, in order of name, and their rows follow it."""
    return mixing.interleave(docs).orderBy("mix.slot", "mix.stream", "mix.place").select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """docs with where each row stands: `shard`, its file in order of name, and `place` within; without files, by partitions."""
    if docs.inputFiles():
        return docs.select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("place"))
    return docs.select("*", F.lpad(F.spark_partition_id().cast("string"), 9, "0").alias("shard"), F.monotonically_increasing_id().alias("place"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it; ordered by (shard, place), the rows follow the mixing schedule."""
    decoded = bpe.encode_column(placed(docs).select("doc_id", "lang", "source", "shard", "place", "text"), "text", VOCABULARY, decoded="decoded")
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "shard", "place",
    )


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", delete_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can't express the votes' expectation-maximisation nor BPE; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage{k}")
    return docs
