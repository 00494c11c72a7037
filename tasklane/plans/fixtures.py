"""Derived inputs built from the supplied tables (see FIXTURES.md).

The supplied tables share no exact text and contain no full-width text,
runs, emotes, emoji or tabs, so those cases are derived here by Spark from
the whole tables. The same definitions appear as SQL in
``tasklane.plans.oracle_sql``; both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.functions.text import to_full_width
from tasklane.sources.tables import read_table

BENCH_SHIFT = 10 ** 9
SEED = 606


def corpus(spark: SparkSession, sf_dir: str, spread: bool = True
           ) -> DataFrame:
    """Four overlapping sources of priority 0..3 (prio int, pos long, text).

    0 = benchmark (pos shifted by 10^9) + documents with doc_id % 7 = 0;
    1 = doc_id % 3 = 0, made full-width where doc_id % 6 = 0;
    2 = doc_id % 2 = 0; 3 = all documents.
    One scan of documents: each document emits one row per source that
    holds it (``inline`` of its membership list). ``spread=False`` where the
    rows are dealt out anew anyway.
    """
    docs = read_table(spark, sf_dir, "documents", spread=spread).select(
        F.col("doc_id").alias("pos"), "text")
    pos, text = F.col("pos"), F.col("text")

    def member(prio, cond, t=text):
        return F.when(cond, F.struct(F.lit(prio).alias("prio"),
                                     t.alias("text")))

    rows = F.array(
        member(0, pos % 7 == 0),
        member(1, pos % 3 == 0,
               F.when(pos % 6 == 0, to_full_width(text)).otherwise(text)),
        member(2, pos % 2 == 0),
        member(3, F.lit(True)))
    from_docs = docs.select("pos", F.inline(F.filter(rows, lambda r: r.isNotNull())))
    bench = read_table(spark, sf_dir, "benchmark").select(
        F.lit(0).alias("prio"), (F.col("item_id") + BENCH_SHIFT).alias("pos"),
        "text")
    return bench.unionByName(from_docs.select("prio", "pos", "text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples: id, task_id, n_classes, target, logits, batch_id.

    task_id = vec_id % 3, C = [3, 7, 10][task], target = label % C,
    logits = first C embedding dimensions, batch_id = vec_id div 32.
    """
    e = read_table(spark, sf_dir, "embeddings")
    task = (F.col("vec_id") % 3).cast("int")
    n_cls = F.element_at(F.array(F.lit(3), F.lit(7), F.lit(10)), task + 1)
    return e.select(
        F.col("vec_id").alias("id"), task.alias("task_id"),
        n_cls.alias("n_classes"),
        (F.col("label") % n_cls).cast("int").alias("target"),
        F.transform(F.slice("embedding", 1, n_cls), lambda x: x.cast("double"))
        .alias("logits"),
        (F.col("vec_id") / 32).cast("long").alias("batch_id"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors: id = vec_id div 8, pos = vec_id % 8, mask = pos < 1 + id % 8."""
    e = read_table(spark, sf_dir, "embeddings")
    seq = F.floor(F.col("vec_id") / 8).cast("long")
    pos = (F.col("vec_id") % 8).cast("int")
    return e.select(seq.alias("id"), pos.alias("pos"),
                    F.transform("embedding", lambda x: x.cast("double"))
                    .alias("vec"),
                    (pos < F.lit(1) + (seq % 8)).alias("mask"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-token states per layer: id = vec_id div 4, layer = vec_id % 4."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).cast("long").alias("id"),
                    (F.col("vec_id") % 4).cast("int").alias("layer"),
                    F.transform("embedding", lambda x: x.cast("double"))
                    .alias("vec"))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked parameter table (model_id, ord, name, chunk, vals).

    Every embeddings row is one chunk of one tensor, so tensors grow with
    the table: model_id = ord = vec_id % 3, r = vec_id div 3, chunk = r div 20;
    name by r % 20: 0 -> 'head.<model_id>' (seen once, copied),
    1 -> 'emb.position_ids' (last model wins), else 'shared.<r % 20>'
    (averaged). (model_id, name, chunk) is unique.
    """
    e = read_table(spark, sf_dir, "embeddings")
    m = (F.col("vec_id") % 3).cast("int")
    r = F.floor(F.col("vec_id") / 3)
    k = r % 20
    name = (F.when(k == 0, F.concat(F.lit("head."), m.cast("string")))
            .when(k == 1, F.lit("emb.position_ids"))
            .otherwise(F.concat(F.lit("shared."), k.cast("string"))))
    return e.select(m.alias("model_id"), m.alias("ord"), name.alias("name"),
                    F.floor(r / 20).cast("int").alias("chunk"),
                    F.transform("embedding", lambda x: x.cast("double"))
                    .alias("vals"))
