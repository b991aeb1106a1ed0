"""A training-corpus pipeline of the library's operators, run stage by stage over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet into the shared folder and reads them back for the
next one. All stages but the last return the columns of ``documents``.

1. language ID: documents without letters or far from every learnt language go;
2. line dedup: lines found in ten documents or more stay in the first of them only
   (so a text that was copied ten times is not lost), every document stays;
3. SimHash near-dedup: one document of each component stays;
4. benchmark decontamination: documents that hold a test item go;
5. mixing: the documents the mix takes, with how often it takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetally.llm import decontaminate, language, linededup, mixing, simhash
from casetally.llm.common import held_out, store, table
from casetally.llm.queries import quality_weights

#: A document further than this from every profile is not in a known language.
MIN_LANGUAGE_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language.fit_profiles(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify(docs, profiles)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(known).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(docs, min_docs=10, keep_first=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, quality_weights(spark, sf_dir), ratio=1.5, weights=(5, 2, 1), max_epochs=2.0, seed=1)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_near_dedup", simhash_stage),
          ("benchmark_decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: SQL cannot express the language, line and SimHash stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
