"""Label and task operators.

Label dictionaries are tiny and fixed, so they travel as map literals inside
the expression (no join, no shuffle). A data-derived label table goes
through ``encode_with_table``; AQE decides broadcast from its measured size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklane.plans.rank import position_buckets, two_level_rank

# Fixed values (task ids and label dictionaries; must equal the reference's).
TASKS = {"ocnli": 0, "ocemotion": 1, "tnews": 2}
PAIR_LABELS = {"entailment": 0, "neutral": 1, "contradiction": 2}
EMOTION_LABELS = {"sadness": 0, "happiness": 1, "disgust": 2, "like": 3,
                  "anger": 4, "surprise": 5, "fear": 6}
HEADLINE_LABELS = {109: 0, 104: 1, 102: 2, 113: 3, 107: 4, 101: 5, 103: 6,
                   110: 7, 108: 8, 112: 9, 116: 10, 115: 11, 106: 12, 100: 13,
                   114: 14}
TASK_LABELS = {0: PAIR_LABELS, 1: EMOTION_LABELS, 2: HEADLINE_LABELS}
N_CLASSES = {t: len(d) for t, d in TASK_LABELS.items()}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _map(d: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def drop_unlabelled(df: DataFrame, label: str = "label",
                    marker: str = "-") -> DataFrame:
    """Drop rows whose label is the marker; NULL labels are kept."""
    return df.where(~F.col(label).eqNullSafe(F.lit(marker)))


def strict_int(col) -> Column:
    """Integer cast that fails the job on a bad value (ANSI cast)."""
    c = _c(col)
    return F.when(c.isNull(), F.raise_error(F.lit("label is missing"))) \
        .otherwise(c.cast("string").cast("int"))


def try_int(col) -> Column:
    """P4 quarantine variant: NULL on a bad value."""
    return _c(col).cast("string").try_cast("int")


def encode_label(col, mapping: Mapping) -> Column:
    """P5: raw label -> class index via a map literal; a miss gives NULL."""
    return F.try_element_at(_map(mapping), _c(col))


def encode_task_label(label_col, task_col,
                      dictionaries: Mapping[int, Mapping] = None) -> Column:
    """P5 for a joint table: each row uses its own task's dictionary."""
    dictionaries = dictionaries or TASK_LABELS
    out = None
    for t, d in dictionaries.items():
        keys = {str(k): v for k, v in d.items()}
        e = F.try_element_at(_map(keys), _c(label_col).cast("string"))
        out = (F.when(_c(task_col) == t, e) if out is None
               else out.when(_c(task_col) == t, e))
    return out


def encode_with_table(df: DataFrame, label: str, table: DataFrame,
                      raw: str = "raw", idx: str = "idx",
                      out: str = "target") -> DataFrame:
    """P5 with a label table (raw, idx): left join, miss -> NULL."""
    t = table.select(F.col(raw).alias("_el_raw"), F.col(idx).alias(out))
    return df.join(t, df[label] == t["_el_raw"], "left").drop("_el_raw")


def decode_label(col, mapping: Mapping, what: str = "class index") -> Column:
    """Class index -> raw label as string; an unknown index fails."""
    inv = _map({v: str(k) for k, v in mapping.items()})
    c = _c(col)
    return F.coalesce(F.try_element_at(inv, c),
                      F.raise_error(F.concat(F.lit(f"unknown {what}: "),
                                             c.cast("string"))))


# Predictions of the pair task are exported as class numbers.
EXPORT_LABELS = {0: {v: v for v in PAIR_LABELS.values()}, 1: EMOTION_LABELS,
                 2: HEADLINE_LABELS}


def decode_task_label(idx_col, task_col,
                      dictionaries: Mapping[int, Mapping] = None) -> Column:
    """P6 for predictions of all tasks: the label text that is exported
    (``EXPORT_LABELS``); an unknown task or class fails."""
    dictionaries = dictionaries or EXPORT_LABELS
    out = None
    for t, d in dictionaries.items():
        e = decode_label(idx_col, d)
        out = (F.when(_c(task_col) == t, e) if out is None
               else out.when(_c(task_col) == t, e))
    return out.otherwise(F.raise_error(F.lit("unknown task")))


def tag_task(df: DataFrame, task, col: str = "task_id") -> DataFrame:
    """Constant task id (name or number)."""
    tid = TASKS[task] if isinstance(task, str) else int(task)
    return df.withColumn(col, F.lit(tid))


def head_per_task(df: DataFrame, k: int = 4, task: str = "task_id",
                  order: str = "id") -> DataFrame:
    """First ``k`` rows of every task (the debug/overfit sample).

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before
    the shuffle, so each map task forwards at most ``k`` rows per task.
    """
    w = Window.partitionBy(task).orderBy(order)
    return (df.withColumn("_hp_rn", F.row_number().over(w))
            .where(F.col("_hp_rn") <= k).drop("_hp_rn"))


def positional_split(df: DataFrame, n: int, pos: str = "pos",
                     groups=()) -> tuple[DataFrame, DataFrame]:
    """P10: rows [:n] and [n:] in ``pos`` order (via the two-level rank)."""
    r = two_level_rank(df, order=[pos], buckets=position_buckets(pos),
                       groups=groups, out="_ps_rank")
    return (r.where(F.col("_ps_rank") < n).drop("_ps_rank"),
            r.where(F.col("_ps_rank") >= n).drop("_ps_rank"))


def task_mask(df: DataFrame, task, col: str = "task_id") -> DataFrame:
    """Rows of one task."""
    tid = TASKS[task] if isinstance(task, str) else int(task)
    return df.where(F.col(col) == tid)
