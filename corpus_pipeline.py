"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate join, passage dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes what a stage returns as Parquet in the shared folder and reads it as the next one's
docs, so a lost executor costs no more than its stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.common import remove, shared_dir, tracked, written
from deltaweave.llm.jaccard import jaccard_components
from deltaweave.llm.langid import identify
from deltaweave.llm.linededup import drop_common_lines
from deltaweave.llm.packing import pack
from deltaweave.llm.suffixdedup import drop_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids, of 8 bytes, that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_left: list[str] = []


def _stage(function: Callable) -> Callable:
    """A stage that begins by deleting what the stage before wrote for itself: that one's result is written by then.

    What ``docs`` still reads stays.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            files = docs.inputFiles()
            gone = [path for path in _left if not any(path in f for f in files)]
            remove(spark, gone)
            _left[:] = [path for path in _left if path not in gone]
        with tracked() as made:
            out = function(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``; n_chars follows the text."""
    return df.select("doc_id", "text", "lang", "source", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, row by row, repeated rows and null ids too; texts without letters go."""
    return identify(docs, keep=COLUMNS).where("accepted").select("kept.*")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; a document of which nothing stays goes too."""
    return _documents(drop_common_lines(docs).where("text <> ''"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the Jaccard join links, on shingles of five words from 0.8 on, one document stays, that of the least id.

    Of repeated rows (same id, same text) one stays. Rows without id link with nothing and stay, and so do texts without words.
    """
    ids = written(jaccard_components(docs, k=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("rows")), "near-ids")
    named = ids.withColumnRenamed("doc_id", "__id")
    apart = _small(named.where("gone or rows > 1").select("__id"))
    kept = docs.join(apart, docs["doc_id"] == apart["__id"], "left_anti")  # only ids that go or repeat are looked up, so texts stay where they are
    repeated = named.where("not gone and rows > 1").select("__id")
    if not repeated.isEmpty():
        repeated = _small(repeated)
        one = docs.join(repeated, docs["doc_id"] == repeated["__id"], "left_semi").withColumn("__seal", F.xxhash64("text"))
        kept = kept.unionByName(one.dropDuplicates(["doc_id", "__seal"]).drop("__seal"))
    return kept.select(*COLUMNS)


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they come first; a document of which nothing stays goes."""
    return _documents(drop_repeats(docs).where("trim(text) <> ''"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Neither trigram likelihoods nor components nor packing can be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/deltaweave-stage-{name}-{uuid.uuid4().hex}"
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
