"""Registered queries: inventory id -> (Spark plan builder, DuckDB oracle).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole supplied tables (or tables Spark derives from them). Oracle SQL runs on
the same parquet files as views. Column names, order and types agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.functions import text as T
from tasklane.operators import dedup
from tasklane.plans import fixtures as fx
from tasklane.plans import oracle_sql as osql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------
# D3 priority dedup (+ P7 dense ids per source)

def _d3(spark, sf, folded: bool):
    c = fx.corpus(spark, sf)
    key = T.fold_width("text") if folded else F.col("text")
    best = dedup.priority_dedup(c, key, "prio", "pos", key_name="text")
    return dedup.dense_ids_per_source(best).select("prio", "pos", "id", "text")


def _d3_sql(key: str) -> str:
    return osql.with_(osql.CORPUS, f"""
w AS (SELECT prio, pos, {key} AS text,
             row_number() OVER (PARTITION BY {key} ORDER BY prio, pos) AS rn
      FROM corpus)""") + """
SELECT prio, pos,
       CAST(row_number() OVER (PARTITION BY prio ORDER BY pos) - 1 AS BIGINT) AS id,
       text
FROM w WHERE rn = 1"""


_FOLD = f"translate(text, {osql.FULL}, {osql.HALF})"


@register("d3_priority_dedup_raw", _d3_sql("text"))
def q_d3_raw(spark, sf):
    return _d3(spark, sf, folded=False)


@register("d3_priority_dedup_folded", _d3_sql(_FOLD))
def q_d3_folded(spark, sf):
    return _d3(spark, sf, folded=True)


@register("d3_late_texts", _d3_sql(_FOLD))
def q_d3_late(spark, sf):
    """D3 on digests; texts are read where they lie."""
    from tasklane.operators.bitmaps import dedup_late_texts
    return dedup_late_texts(
        fx.corpus(spark, sf), T.fold_width("text"), key_name="text").select(
            "prio", "pos", "id", "text")
