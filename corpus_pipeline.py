"""The corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
docs of the next one. All stages but the last return the columns of ``documents``:

* toxicity: documents with P(severity >= 1) of at least one half go;
* line_dedup: of every group of near-equal lines the first stays (texts get shorter, no document goes);
* near_dedup: of every group of near duplicates (5-word shingles, similarity 0.8) one document stays;
* decontaminate: documents with at least a twentieth of their words in benchmark windows go;
* pack: what is left as pieces of token sequences.

``ORACLE_SQL`` is None: models, sketches and tokenizers are beyond SQL. tests/llm holds the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelmill.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from panelmill.llm.common import Scratch, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_once), ("near_dedup", near_once),
          ("decontaminate", uncontaminated), ("pack", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a written table."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
