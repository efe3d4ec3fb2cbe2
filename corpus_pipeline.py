"""A corpus pipeline: toxic documents go, lines that spread over sites go, near copies go, secrets are hidden, the rest is packed.

The stages that call Python do so inside, in small batches, as five stages of one job share the executors' memory; those of
which Python gives the result write it to the shared folder, the first one as a checkpoint, which goes with its table.

Nulls, empty and long texts, ties and repeated rows go through each stage as its operator says. An empty table gives an empty
result. All but the last stage return the columns of the documents, extra and clashing ones included.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evokeline.functions.session import forget, scratch
from evokeline.llm import line_dedup, near_copies, packing, secret_scan, toxicity
from evokeline.llm.common import checkpoint, documents, give_back, small_batches


#: Bytes of words whose ids a packing task keeps. Workers stay between the stages, beside a heap that is full by then.
WORDS = 12 << 20


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, as a table in the shared folder. What the driver needed for a model goes back to the system before."""
    path = scratch(spark, name)
    give_back()
    with small_batches(spark):
        make().write.parquet(path)
    return spark.read.parquet(path)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of their language."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    give_back()
    with small_batches(spark):
        return checkpoint(toxicity.clean(docs, model))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of lines that stand on many sites."""
    return line_dedup.without_boilerplate(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: operator 3's links over five words, and all others of 0.8 or more."""
    give_back()
    with small_batches(spark):
        return near_copies.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return settled(spark, "secrets", lambda: secret_scan.redact(docs, secret_scan.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids in two bytes each and their place in the training sequences."""
    with small_batches(spark):
        return packing.pack(packing.pieces(docs, with_ids=2, words=WORDS))


STAGES = [("toxicity", without_toxic), ("line_dedup", without_boilerplate), ("simhash_near_dedup", without_near_copies), ("secret_scans", without_secrets), ("best_fit_packing", packed)]

#: Stages that give a table of their own.
SETTLED = (without_secrets,)

#: Learned models and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage applied to what the one before it kept, as Parquet in the shared folder.

    A stage's table is deleted once the next one's is written; the last one stays, as the result may depend on it.
    """
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, kept = docs, stage(spark, docs, sf_dir)
        docs = kept if stage in SETTLED else settled(spark, name, lambda kept=kept: kept)
        if k:
            forget(spark, posixpath.dirname(before.inputFiles()[0]))
    return STAGES[-1][1](spark, docs, sf_dir)
