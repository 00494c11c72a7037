"""Exact histogram of encoded document lengths.

Documents are aggregated by their length in tokens, whole table and each
source. Sums over the lengths from the longest down then answer, for every
context limit at once: how many documents are longer, how many tokens a cut
at the limit keeps, and (from the other end) every quantile.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm import tokens
from tasklane.llm.common import arrow_map, prepare, table
from tasklane.session import cut_lineage

VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKET = 4096       # lengths that share a row in the first level of sums


def _length_batches(path: str | None, keep: list[str]):
    def run(batches, schema):
        own = tokens.ChunkEncoder(tokens.bpe_ranks(
            path or tokens.vocabulary(VOCABULARY)))
        for batch in K.byte_slices(batches, "text", tokens.SLICE_BYTES):
            n = own.lengths(*K.flat(batch.column("text")))
            yield K.with_columns(batch, keep, {"n_tokens": pa.array(n)},
                                 schema)
    return run


def token_lengths(documents: DataFrame, keep: list[str],
                  vocabulary: str | None = None) -> DataFrame:
    """The columns in ``keep`` and ``n_tokens``, for each row. Null and empty
    texts have 0 tokens. ``vocabulary``: path of a rank file, on every
    worker; by default the installed one."""
    fields = [f for c in keep for f in documents.schema if f.name == c]
    need = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(documents.select(*need),
                     _length_batches(vocabulary, keep),
                     T.StructType([*fields,
                                   T.StructField("n_tokens", T.LongType())]))


def length_histogram(lengths: DataFrame, by: str = "source") -> DataFrame:
    """``(scope, source, n_tokens, n_docs)``: documents of each length, over
    all rows (scope ``all``, null source) and in each source (scope
    ``source``; a null source is a source). Combined before the shuffle, so
    a hot source or length costs one row per task."""
    counts = lengths.groupBy(by, "n_tokens").agg(
        F.count("*").alias("n_docs"))
    return counts.select(
        F.explode(F.array(
            F.struct(F.lit("all").alias("scope"),
                     F.lit(None).cast("string").alias("source")),
            F.struct(F.lit("source").alias("scope"),
                     F.col(by).cast("string").alias("source")))).alias("k"),
        "n_tokens", "n_docs").groupBy(
            "k.scope", "k.source", "n_tokens").agg(
                F.sum("n_docs").alias("n_docs"))


def _longer(value: str) -> tuple[Column, Column]:
    """Sum of ``value`` over longer lengths: those in the same bucket, and
    the buckets above (two levels, so no window holds a whole scope)."""
    inner = W.partitionBy("scope", "source", "bucket").orderBy(
        F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("scope", "source").orderBy(
        F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    return (F.coalesce(F.sum(value).over(inner), F.lit(0)),
            F.coalesce(F.sum(value).over(outer), F.lit(0)))


def suffix_sums(histogram: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each row of the histogram, that is for each length as a limit:
    ``longer_docs`` and ``longer_tokens`` over greater lengths, ``truncated``
    (tokens left when every text is cut to the limit), the scope's totals,
    and ``quantile`` (share of documents not longer than the limit)."""
    h = histogram.withColumns({
        "bucket": F.floor(F.col("n_tokens") / bucket),
        "tokens": F.col("n_tokens") * F.col("n_docs")})
    docs, docs_above = _longer("n_docs")
    toks, toks_above = _longer("tokens")
    whole = W.partitionBy("scope", "source")
    sums = (h.groupBy("scope", "source", "bucket")
            .agg(F.sum("n_docs").alias("n_docs"),
                 F.sum("tokens").alias("tokens"))
            .select("scope", "source", "bucket",
                    docs_above.alias("above_docs"),
                    toks_above.alias("above_tokens"),
                    F.sum("n_docs").over(whole).alias("total_docs"),
                    F.sum("tokens").over(whole).alias("total_tokens")))
    inner = h.withColumns({"in_docs": docs, "in_tokens": toks})
    on = (inner["scope"] == sums["scope"]) & inner["source"].eqNullSafe(
        sums["source"]) & (inner["bucket"] == sums["bucket"])
    j = inner.join(sums, on).select(
        inner["scope"], inner["source"], "n_tokens", inner["n_docs"],
        (F.col("in_docs") + F.col("above_docs")).alias("longer_docs"),
        (F.col("in_tokens") + F.col("above_tokens")).alias("longer_tokens"),
        "total_docs", "total_tokens")
    return j.withColumns({
        "truncated": F.col("total_tokens") - F.col("longer_tokens")
        + F.col("longer_docs") * F.col("n_tokens"),
        "quantile": (F.col("total_docs") - F.col("longer_docs"))
        / F.col("total_docs")})


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Truncated total of each scope at any limit, also one that is no
    document's length: from the greatest length below it and what is
    longer."""
    kept = F.sum(F.when(F.col("n_tokens") <= limit,
                        F.col("n_docs") * F.col("n_tokens")).otherwise(
                            F.col("n_docs") * limit))
    return sums.groupBy("scope", "source").agg(kept.alias("truncated"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """Smallest length of each scope that a share ``q`` of its documents
    doesn't exceed."""
    return sums.where(F.col("quantile") >= q).groupBy(
        "scope", "source").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, vocabulary: str | None = None
                 ) -> DataFrame:
    """Histogram with its sums, for all documents and each source.

    Null and empty texts are documents of length 0; repeated rows count each;
    other columns aren't read; an empty table gives no rows."""
    prepare(documents.sparkSession)
    counts = cut_lineage(length_histogram(
        token_lengths(documents, ["source"], vocabulary)))
    return suffix_sums(counts)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram and every limit's answers over all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
