"""Corpus pipeline: five stages from raw documents to shards, each an operator of ``shiftframe.llm``.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns the columns of ``documents``; the last adds size, shard and slot.
``run`` writes each stage's rows as Parquet below the session's
``spark.checkpoint.dir`` and reads them again as the next one's documents. When a
stage's rows are written, its checkpoints and its predecessor's rows are deleted;
if a stage fails, all that the run wrote is.

Null and empty texts, which have no letter, go in the first stage; texts of any
length pass whole. Of equal and of nearly equal texts the one with the smallest id
stays, null last, and of rows alike in id and text all. A row goes in the third stage for its own text,
whatever its id. Draws and shards are by hashes of id and text, so that ties need no order. Columns may have any
names; the last stage's size, shard and slot take the place of columns of theirs.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.llm.common import apart, remove, scratch, shared_folder
from shiftframe.llm.decontamination import decontaminated
from shiftframe.llm.language_id import in_fold, predict, train
from shiftframe.llm.mixing import cells_of, mixed, tempered, topic
from shiftframe.llm.near_duplicates import deduplicated
from shiftframe.llm.sharding import assign_shards

#: A language is accepted from this posterior on.
SURE = 0.5
#: Sources, languages and topics are mixed by their token share to this power.
POWER = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, or whose best language's posterior is below ``SURE``."""
    import public_tokenizers  # only this stage needs it

    model = train(docs.where(~in_fold(F.col("doc_id"), 4, 2)), public_tokenizers.path("piece_bpe_32k.model"))
    lang, sure = f"{apart(docs)}lang", f"{apart(docs)}sure"
    kept = predict(docs, model, keep=tuple(docs.columns), out=(lang, sure))
    return kept.where((F.col(lang) != "und") & (F.col(sure) >= SURE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics approach their tempered shares."""
    dimensions = {"source": docs["source"], "lang": docs["lang"], "topic": topic(docs["text"])}
    cells = cells_of(docs, dimensions)
    found = mixed(docs, tempered(cells, POWER), dimensions, cells, prefix=(p := apart(docs)))
    return found.where(F.col(f"{p}sampled")).select(*(F.col(f"`{c}`") for c in docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to 40 shards of near equal bytes."""
    return assign_shards(docs, shards=40)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL expresses neither the language model nor the fingerprints; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs, at, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    try:
        for k, (name, stage) in enumerate(STAGES):
            folder = f"{at}/{k}-{name}"
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(folder)
            if before is not None:
                remove(spark, before)
            docs, before = spark.read.parquet(folder), folder
    except BaseException:
        remove(spark, at)
        raise
    return docs
