"""From the documents table to token files, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator
of ``tasklane.llm``. Its rows are written as Parquet to the shared folder and
read again as the next stage's documents, so a stage starts from files, not
from a long plan, and a lost executor costs work of one stage.

1. quality: documents that the counting rules or the classifier reject go.
2. dedup: one document of each group of near copies stays.
3. decontaminate: documents that hold a benchmark item go.
4. mix: documents are repeated or left out by their source's target, in
   training order.
5. tokens: token files in that order; a row for each document in them.

Null or empty texts have no words and go in stage 1; so an empty table stays
empty through all stages. Repeated rows are near copies. A null source is a
source. Columns beyond those of documents are carried through stage 4.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.llm.common import prepare, table
from tasklane.llm.decontaminate import decontaminated
from tasklane.llm.mixing import mix_sources
from tasklane.llm.quality_rules import quality_filter, train
from tasklane.llm.simhash import near_dedup
from tasklane.llm.token_output import token_output
from tasklane.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_filter(docs, train(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str
                  ) -> DataFrame:
    prepare(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mix_sources(docs)


def _file_order(docs: DataFrame) -> list[Column | str]:
    """The order of rows in the files of the stage before; by id if ``docs``
    isn't read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return ["doc_id"]
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).cast("long"), name,
            F.col("_metadata.row_index")]


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_output(docs, order=_file_order(docs))


STAGES = [("quality", quality), ("dedup", dedup),
          ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

# Trained weights, alignment, hashing and encoding have no SQL form; the
# tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
