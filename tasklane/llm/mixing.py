"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Each source's target comes from its weight, limited to a few
epochs of the source, the excess given to the others by weight. A source's
documents stand in a fixed hash order; its demand is the target number of
words of that order, repeated, and a document is taken once for each epoch
in which its middle word is demanded. The source's weight schedule over the
training run is integrated; inverting that cumulative demand gives each taken
copy its training position in [0, 1), and copies are range-sorted by it.

Offsets within a source are running sums in two levels (hash bucket, then
within the bucket), so a source of any size is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm.common import arrow_map, prepare, table
from tasklane.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Weight over the run at equally spaced times, for the sources of each
# weight: the first fade out, the second stay level, the third come in.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUCKET_DIGITS = 4      # hex digits: 65,536 buckets of each source


def _size_batches(keep: list[str]):
    def run(batches, schema):
        for batch in K.byte_slices(batches, "text"):
            _, _, ptr = K.word_spans(*K.flat(batch.column("text")))
            size = ptr[1:] - ptr[:-1]
            yield K.with_columns(batch, keep, {"size": pa.array(size)},
                                 schema)
    return run


def sized(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``size``, the words of the text."""
    fields = [f for c in keep for f in documents.schema if f.name == c]
    need = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(documents.select(*need), _size_batches(keep),
                     T.StructType([*fields,
                                   T.StructField("size", T.LongType())]))


def targets(source_sizes: DataFrame, weights: tuple = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> with ``kind`` (place in ``weights``) and
    ``target``. One row for each source; the windows hold sources, not
    documents.

    Sources by code point, null last, take the weights in turn. All shares
    add to the total size. With the sources in ascending order of
    limit / weight, a source is at its limit if the total isn't used up when
    everyone's share has grown to that ratio; the rest share what is left."""
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    rows = source_sizes.withColumn("kind", (
        (F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          F.col("kind") + 1)
    rows = rows.withColumns({
        "w": weight, "most": F.col("source_size") * float(max_epochs)})
    rows = rows.withColumn("ratio", F.col("most") / F.col("w"))
    rising = W.partitionBy().orderBy("ratio").rangeBetween(
        W.unboundedPreceding, 0)
    everyone = W.partitionBy()
    rows = rows.withColumns({
        "below": F.sum("most").over(rising),
        "w_above": F.sum("w").over(everyone) - F.sum("w").over(rising),
        "total": F.sum("source_size").over(everyone)})
    rows = rows.withColumn("full", F.col("below") + F.col("ratio")
                           * F.col("w_above") <= F.col("total"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("most"))
                                  .otherwise(0.0)).over(everyone)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(
        F.col("w"))).over(everyone)
    return rows.select("source", "source_size", "kind", F.when(
        F.col("full"), F.col("most")).otherwise(
            left * F.col("w") / open_w).alias("target"))


def _invert(share: Column, knots: tuple) -> Column:
    """Time at which the integral of the piecewise linear schedule reaches
    ``share`` of the whole."""
    step = 1.0 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:],
                                                strict=False)]
    whole = sum(areas)
    if whole <= 0 or min(knots) < 0:
        raise ValueError("a schedule needs weights of at least 0, not all 0")
    out, done = None, 0.0
    for k, area in enumerate(areas):
        a, slope = knots[k], (knots[k + 1] - knots[k]) / step
        need = share * whole - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(a * a) + need * (2 * slope),
                                 F.lit(0.0)))
        # need = a t + slope t^2 / 2, in the form that is stable at slope 0
        t = F.when(need <= 0, F.lit(0.0)).otherwise(
            need * 2.0 / (root + F.lit(a)))
        here = F.lit(k * step) + F.least(t, F.lit(step))
        done += area
        out = (F.when(share * whole <= done, here) if out is None
               else out.when(share * whole <= done, here))
    return F.least(out.otherwise(F.lit(1.0)), F.lit(1.0))


def plan(documents: DataFrame, keep: list[str] | None = None,
         weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
         schedules: tuple = SCHEDULES) -> DataFrame:
    """Each row of ``documents`` with ``size``, ``source_size``, ``target``,
    ``taken`` (its words in the mix, repeats counted) and ``positions``, the
    training position of each of its copies.

    A row's place in its source is the order of the MD5 of ``doc_id``, then
    ``doc_id`` and size, so reruns agree; equal rows are interchangeable and
    each counts. A null id sorts first. Null or empty texts have size 0 and
    are never taken. A source without words has target 0; an empty table
    gives no rows. ``keep`` must hold ``doc_id`` and ``source``; its columns
    may not be named like the results."""
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    prepare(documents.sparkSession)
    keep = ["doc_id", "source"] if keep is None else keep
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # A source's key has no null, so that joins and windows share a
    # partitioning: the texts are shuffled once here.
    key = ["_named", "_name", "_bucket"]
    rows = sized(documents, keep).withColumns({
        "_md5": digest, "_bucket": F.substring(digest, 1, BUCKET_DIGITS),
        "_named": F.col("source").isNotNull(),
        "_name": F.coalesce("source", F.lit(""))})
    # Small: a row for each source and bucket that occurs.
    sums = cut_lineage(rows.groupBy(*key).agg(
        F.sum("size").alias("bucket_size")))
    above = F.coalesce(F.sum("bucket_size").over(
        W.partitionBy("_named", "_name").orderBy("_bucket").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0))
    source = F.when(F.col("_named"), F.col("_name")).alias("source")
    goal = targets(sums.groupBy("_named", "_name").agg(
        F.sum("bucket_size").alias("source_size")).select(
            source, "source_size"), weights, max_epochs)
    goal = goal.select(F.col("source").isNotNull().alias("_named"),
                       F.coalesce("source", F.lit("")).alias("_name"),
                       "source_size", "kind", "target")
    placed = sums.select(*key, above.alias("above")).join(
        goal, ["_named", "_name"])
    within = W.partitionBy(*key).orderBy(
        "_md5", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(placed, key).withColumn("_in", F.coalesce(
        F.sum("size").over(within), F.lit(0)))
    middle = (F.col("above") + F.col("_in")).cast("double") + F.col(
        "size") / 2.0
    epochs = F.when((F.col("size") > 0) & (middle < F.col("target")), F.least(
        F.ceil((F.col("target") - middle) / F.col("source_size")),
        F.lit(max_epochs))).otherwise(0).cast("int")
    rows = rows.withColumns({"_middle": middle, "_epochs": epochs})

    def position(e: Column) -> Column:
        share = (F.col("_middle") + e * F.col("source_size")) / F.col(
            "target")
        times = [F.when(F.col("kind") == k, _invert(share, s))
                 for k, s in enumerate(schedules)]
        return reduce(lambda a, b: F.coalesce(a, b), times)
    each = F.transform(F.sequence(F.lit(0), F.col("_epochs") - 1), position)
    return rows.select(
        *keep, "size", "source_size", "target",
        (F.col("size") * F.col("_epochs")).alias("taken"),
        F.when(F.col("_epochs") > 0, each).otherwise(
            F.array().cast("array<double>")).alias("positions"))


def mix_sources(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken copy of a document as a row with the
    columns of ``documents``, range-sorted by training position (ties by
    id), so that the partitions in order, and the rows in each, are the
    training order."""
    names = documents.columns
    plain = documents.toDF(*[n if n in ("doc_id", "source", "text")
                             else f"_c{i}" for i, n in enumerate(names)])
    found = plan(plain, plain.columns, **options)
    copies = found.select(*plain.columns, F.explode("positions").alias("_p"))
    return (copies.repartitionByRange("_p", "doc_id")
            .sortWithinPartitions("_p", "doc_id")
            .drop("_p").toDF(*names))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document, in the order of its
    first training position; documents that aren't taken come last."""
    found = plan(table(spark, sf_dir, "documents"))
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    return (found.withColumn("_first", first)
            .repartitionByRange("_first", "doc_id")
            .sortWithinPartitions("_first", "doc_id")
            .select("doc_id", "source", "size", "source_size", "target",
                    "taken", "positions"))


def _invert_sql(share: str, knots: tuple) -> str:
    """``_invert`` as SQL."""
    step = 1.0 / (len(knots) - 1)
    whole = sum((a + b) / 2 * step for a, b in zip(knots, knots[1:],
                                                   strict=False))
    out, done = "CASE", 0.0
    for k, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        slope, need = (b - a) / step, f"({share} * {whole}::DOUBLE - {done}::DOUBLE)"
        t = (f"CASE WHEN {need} <= 0 THEN 0.0::DOUBLE ELSE {need} * 2.0::DOUBLE / "
             f"(sqrt(greatest({a * a}::DOUBLE + {need} * {slope * 2}::DOUBLE, "
             f"0.0::DOUBLE)) + {a}::DOUBLE) END")
        done += (a + b) / 2 * step
        out += (f" WHEN {share} * {whole}::DOUBLE <= {done}::DOUBLE THEN "
                f"{k * step}::DOUBLE + least({t}, {step}::DOUBLE)")
    return f"least({out} ELSE 1.0::DOUBLE END, 1.0::DOUBLE)"


def oracle_sql() -> str:
    """The query in DuckDB."""
    share = "((middle + e * source_size) / target)"
    place = " ".join(f"WHEN {k} THEN {_invert_sql(share, s)}"
                     for k, s in enumerate(SCHEDULES))
    rising = "OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} AS kind
  FROM d GROUP BY source),
w AS (SELECT *, [{weights}][kind + 1] AS w,
    source_size * {float(MAX_EPOCHS)}::DOUBLE AS most FROM s),
r AS (SELECT *, most / w AS ratio FROM w),
f AS (SELECT *, sum(most) {rising} + ratio * (sum(w) OVER () - sum(w) {rising})
    <= sum(source_size) OVER () AS full_ FROM r),
t AS (SELECT source, source_size, kind, CASE WHEN full_ THEN most ELSE
    ((sum(source_size) OVER ())::DOUBLE
      - sum(CASE WHEN full_ THEN most ELSE 0.0::DOUBLE END) OVER ()) * w
    / sum(CASE WHEN full_ THEN 0.0::DOUBLE ELSE w END) OVER () END AS target FROM f),
m AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.kind, t.target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ASC NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE
    AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 AND middle < target THEN
    least(ceil((target - middle) / source_size), {MAX_EPOCHS})::INTEGER ELSE 0 END AS times
  FROM m)
SELECT doc_id, source, size, source_size, target, size * times AS taken,
  list_transform(range(times), lambda e: CASE kind {place} END) AS positions
FROM n"""
