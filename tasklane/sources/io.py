"""Sources and sinks.

Every reader declares its schema; nothing is inferred. Paths may be globs
or folders, so one call reads many files in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.functions.text import clean
from tasklane.session import checkpoint_dir
from tasklane.operators import labels as L
from tasklane.operators.splits import N_FOLDS, fold_select, stratified_folds
from tasklane.sources.quoted import read_quoted

PAIR_JSON = "sentence1 string, sentence2 string, label string"
SINGLE_JSON = "sentence string, label string"
PAIR_TSV = "id long, sentence1 string, sentence2 string, label string"
PAIR_TEST_TSV = "id long, sentence1 string, sentence2 string"
SINGLE_TSV = "id long, sentence string, label string"
SINGLE_TEST_TSV = "id long, sentence string"
PARAMS = "model_id int, ord int, name string, vals array<double>"


def _with_pos(df: DataFrame) -> DataFrame:
    """Input order key taken directly above the scan: (file, block start,
    row id); ``monotonically_increasing_id`` grows with the row inside a
    block."""
    return (df.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_row", F.monotonically_increasing_id()))


def with_position(df: DataFrame) -> DataFrame:
    return _with_pos(df)


def number_rows(df: DataFrame, out: str = "id", groups=()) -> DataFrame:
    """P7 over file order: dense 0..n-1 by (groups, file, block, row). The
    rows of a block, also those of an unsplittable file, are ranked in
    windows of 65,536 (the low 33 bits of the row id count them)."""
    from tasklane.plans.rank import two_level_rank
    r = two_level_rank(df, order=["_file", "_block", "_row"],
                       buckets=[F.col("_file"), F.col("_block"),
                                F.shiftright(F.col("_row"), 16)],
                       groups=groups, out=out)
    return r.drop("_file", "_block", "_row")


def number_scanned(df: DataFrame, out: str = "id") -> DataFrame:
    """As ``number_rows``, for all rows of ``with_position`` directly above a
    scan, which count up by one in a block: no row is shuffled or sorted."""
    from tasklane.plans.rank import block_rank
    return block_rank(df, ["_file", "_block"], "_row", out=out).drop(
        "_file", "_block", "_row")


def read_jsonl(spark: SparkSession, path: str, schema: str = PAIR_JSON,
               keep_corrupt: bool = False) -> DataFrame:
    """One JSON object per line; malformed lines kept in
    ``_corrupt_record`` when ``keep_corrupt``."""
    r = spark.read.option("mode", "PERMISSIVE")
    if keep_corrupt:
        schema = schema + ", _corrupt_record string"
        r = r.option("columnNameOfCorruptRecord", "_corrupt_record")
    return r.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str = SINGLE_TSV,
             quoted: bool = False, parallel: bool = True) -> DataFrame:
    """S2 (``quoted=False``: quotes are plain characters) and S2b
    (``quoted=True``: double quotes honoured). No header. Quoted files are
    read by blocks; ``parallel=False`` takes each file whole, for those with
    quotes inside of unquoted fields."""
    if quoted and parallel:
        return read_quoted(spark, path, schema, sep="\t")
    r = spark.read.schema(schema).option("sep", "\t").option("header", False)
    if quoted:
        r = (r.option("quote", '"').option("escape", '"')
             .option("multiLine", True))
    else:
        r = r.option("quote", "")
    return r.option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str,
             parallel: bool = True) -> DataFrame:
    """S3: CSV with header, quoted fields may hold newlines; ``parallel`` as
    in ``read_tsv``."""
    if parallel:
        return read_quoted(spark, path, schema, header=True)
    return (spark.read.schema(schema).option("header", True)
            .option("multiLine", True).option("escape", '"')
            .option("nullValue", "").csv(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (``value``)."""
    return spark.read.text(path)


def parse_delimited_lines(lines: DataFrame, line_no: str = "line_no",
                          value: str = "value", sep: str = "_!_",
                          keep: Sequence[str] = ()) -> DataFrame:
    """Split each line on ``sep``: field 1 = class code, field 3 = title.
    Missing fields give NULL. ``keep``: other columns to carry."""
    parts = F.split(F.col(value), "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return lines.select(line_no, *keep,
                        F.try_element_at(parts, F.lit(2)).alias("code"),
                        F.try_element_at(parts, F.lit(4)).alias("sentence"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """S4 from files: the line number is the position of the line in its
    file order (file path, offset)."""
    raw = number_scanned(_with_pos(spark.read.text(path)), out="line_no")
    return parse_delimited_lines(raw)


def read_params(spark: SparkSession, path: str,
                chunked: bool = False) -> DataFrame:
    """Parameter table (model_id, ord, name, [chunk,] vals) from parquet
    (a folder of checkpoints, e.g. one sub-folder per model)."""
    return spark.read.schema(PARAMS + (", chunk int" if chunked else "")
                             ).parquet(path)


# ---------------------------------------------------------------- S6

# Tasks whose own file for a split is a CSV with header and raw labels.
_EXPLICIT = {0: ("train", "val"), 1: ("train",), 2: ("train", "val")}


def load_split(spark: SparkSession, spec: Mapping, task: str,
               split: str) -> DataFrame:
    """(task, split, spec) -> labelled frame with ``task_id`` and
    ``target``.

    * ``<task>_<split>_path`` (train, and but for the emotion task val): CSV
      with header and raw labels; it wins over folds.
    * ``<task>_trainval_path``: TSV without header. ``trainval`` is all of
      it; train and val are its folds (``n_folds``, ``fold``). The pair
      task's labels are class numbers there, the others' are raw.
    * ``<task>_test_path``: TSV without header and labels.

    Quoted fields may hold tabs and line ends, as ``write_tsv`` and
    ``write_csv`` write them. A raw label that isn't in the task's dictionary
    has no target.
    """
    if split not in ("train", "val", "trainval", "test"):
        raise ValueError(f"unknown split {split!r}")
    tid = L.TASKS[task]
    schema = PAIR_TSV if tid == 0 else SINGLE_TSV
    if split == "test":
        return read_tsv(spark, spec[f"{task}_test_path"],
                        PAIR_TEST_TSV if tid == 0 else SINGLE_TEST_TSV,
                        quoted=True).withColumn("task_id", F.lit(tid))
    own = spec.get(f"{task}_{split}_path") if split in _EXPLICIT[tid] else None
    if own:
        df = read_csv(spark, own, schema)
    else:
        df = read_tsv(spark, spec[f"{task}_trainval_path"], schema,
                      quoted=True)
        k = int(spec.get("n_folds", N_FOLDS))
        if split != "trainval" and k >= 2:
            df = stratified_folds(df, "id", "label", k)
            df = fold_select(df, int(spec.get("fold", 0)), split).drop("fold")
        else:
            df = fold_select(df, 0, "trainval")
    numbered = tid == 0 and not own
    df = df.withColumn("task_id", F.lit(tid))
    return df.withColumn("target", F.col("label").cast("int") if numbered
                         else L.encode_task_label("label", "task_id")
                         .cast("int"))


# ---------------------------------------------------------------- sinks

def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session
    (never a machine-local temporary folder)."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again:
    compressed, and later scans read only the columns they need."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None,
              mode: str = "overwrite") -> None:
    """CSV with header; text is written as is (no whitespace trim)."""
    (df.select(*(columns or df.columns)).write.mode(mode)
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """TSV without header; text is written as is (no whitespace trim)."""
    (df.write.mode(mode).option("sep", "\t").option("header", False)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_predictions(df: DataFrame, path: str, task: str = "task",
                      mode: str = "overwrite") -> None:
    """``{"id","label"}`` JSON lines, one folder per task."""
    (df.select(F.col("id").cast("string").alias("id"),
               F.col("label").cast("string").alias("label"), task)
     .write.mode(mode).partitionBy(task).json(path))


METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("value", T.DoubleType())])


def append_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """Append (run_id, tag, step, value) rows from a wide frame with a
    ``step`` column (each other numeric column becomes a tag)."""
    tags = [c for c, t in df.dtypes if c != "step" and t in
            ("double", "float", "int", "bigint")]
    stacked = df.select(F.col("step").cast("long").alias("step"), F.explode(
        F.array(*[F.struct(F.lit(c).alias("tag"),
                           F.col(c).cast("double").alias("value"))
                  for c in tags])).alias("_m"))
    out = stacked.select(F.lit(run_id).alias("run_id"), "_m.tag", "step",
                         "_m.value")
    out.write.mode("append").parquet(path)


def clean_column(df: DataFrame, col: str, recipe) -> DataFrame:
    return df.withColumn(col, clean(col, recipe))
