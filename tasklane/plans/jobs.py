"""End-to-end jobs (J1-J6): file in, file out, one lazy plan per output.

Each job composes the operators. An intermediate that feeds several
outputs is kept once in the shared checkpoint folder (``cut_lineage``,
``staged``) rather than recomputed per output. Row order of an input file is kept through (file, block, row) keys
taken right above the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.functions import text as T
from tasklane.functions.metrics import argmax
from tasklane.operators import dedup, labels as L, metrics as M
from tasklane.operators import heads as H
from tasklane.operators import vocab as V
from tasklane.plans.rank import (block_rank, position_buckets,
                                 two_level_rank)
from tasklane.session import cut_lineage
from tasklane.sources import io


def _numbered(df: DataFrame, src: int) -> DataFrame:
    """(src, pos): pos = dense position of the row in its input."""
    return io.number_scanned(io.with_position(df), out="pos").withColumn(
        "src", F.lit(src))


# ---------------------------------------------------------------- J1

def pair_task_preparation(spark: SparkSession, train_path: str,
                          dev_path: str, out_dir: str) -> dict[str, DataFrame]:
    """JSON lines -> drop unlabelled -> dense id -> width fold ->
    CSV per split, and the train-then-dev union as CSV (ids renumbered)."""
    outs = {}
    parts = []
    for i, (name, path) in enumerate((("train", train_path),
                                      ("dev", dev_path))):
        raw = _numbered(io.read_jsonl(spark, path, io.PAIR_JSON), i)
        kept = L.drop_unlabelled(raw)
        kept = _renumber(kept, "pos", "id")
        clean = kept.select("id", "src", "pos",
                            T.fold_width("sentence1").alias("sentence1"),
                            T.fold_width("sentence2").alias("sentence2"),
                            "label")
        # Feeds the split's CSV and the union: checkpoint once into the
        # shared folder instead of recomputing the ranks per output.
        clean = cut_lineage(clean)
        outs[name] = clean.select("id", "sentence1", "sentence2", "label")
        io.write_csv(outs[name], f"{out_dir}/{name}.csv")
        parts.append(clean.drop("id"))
    u = dedup.ordered_union(parts, pos="pos", src="src", id_col="id")
    outs["trainval"] = u.select("id", "sentence1", "sentence2", "label")
    io.write_csv(outs["trainval"], f"{out_dir}/trainval.csv")
    return outs


def _renumber(df: DataFrame, pos: str, out: str, groups=()) -> DataFrame:
    return two_level_rank(df, order=[pos], buckets=position_buckets(pos),
                          groups=groups, out=out)


# ---------------------------------------------------------------- J2

def headline_preparation(spark: SparkSession, test_path: str, dev_path: str,
                         train_path: str, extra_path: str, out_dir: str,
                         fold_keys: bool = True) -> dict[str, DataFrame]:
    """Sources by priority test(0) < dev(1) < train(2) < extra(3);
    priority dedup on the (folded) sentence; integer labels; dense ids per
    source; CSV per source (test read, not written); train+dev as TSV."""
    test = _numbered(io.read_tsv(spark, test_path, io.SINGLE_TSV), 0)
    dev = _numbered(io.read_jsonl(spark, dev_path, io.SINGLE_JSON), 1)
    train = _numbered(io.read_jsonl(spark, train_path, io.SINGLE_JSON), 2)
    extra_raw = io.read_delimited(spark, extra_path)
    extra = extra_raw.select(F.col("line_no").alias("pos"), "sentence",
                             F.col("code").alias("label")).withColumn(
        "src", F.lit(3))
    cols = ["src", "pos", "sentence", "label"]
    allsrc = test.select(*cols).unionByName(dev.select(*cols)).unionByName(
        train.select(*cols)).unionByName(extra)
    allsrc = allsrc.withColumn("sentence", T.clean("sentence", "headline")
                               if fold_keys else F.col("sentence"))
    best = dedup.priority_dedup(allsrc, F.col("sentence"), "src", "pos",
                                payload=["label"], key_name="sentence")
    best = best.where(F.col("src") > 0).withColumn(
        "label", L.strict_int("label"))
    # Four outputs read the deduplicated table: sort it once into the shared
    # folder (survives executor loss, no recomputation per output). There rows
    # count up in each sorted partition, so ids need no further shuffle.
    best = best.orderBy("src", "pos").withColumn(
        "_row", F.monotonically_increasing_id())
    best = io.staged(best, "j2-best").withColumn(
        "_part", F.shiftright("_row", 33))
    ided = block_rank(best, ["_part"], "_row", groups=["src"], out="id")
    outs = {}
    for name, s in (("dev", 1), ("train", 2), ("extra", 3)):
        outs[name] = ided.where(F.col("src") == s).select(
            "id", "sentence", "label")
        io.write_csv(outs[name], f"{out_dir}/{name}.csv")
    both = best.where(F.col("src").isin(1, 2)).withColumn("_last", -F.col("src"))
    tv = block_rank(both, ["_last", "_part"], "_row", out="id")
    outs["trainval"] = tv.select("id", "sentence", "label")
    io.write_tsv(outs["trainval"], f"{out_dir}/trainval.tsv")
    return outs


# ---------------------------------------------------------------- J3

def emotion_cleaning(spark: SparkSession, train_path: str,
                     vocab: DataFrame, lexicon: Mapping[str, str],
                     out_dir: str, emote_keep: int = 30
                     ) -> dict[str, DataFrame]:
    """OOV character report, then runs/emotes/Latin squeeze on the
    sentence and emoji naming, in one pass (no per-character rewrite)."""
    df = io.read_tsv(spark, train_path, io.SINGLE_TSV)
    report = V.oov_counts(df, "sentence", vocab)
    # Only characters that the vocabulary lacks are named. What it knows of
    # the lexicon is at most the lexicon.
    keys = spark.createDataFrame([(k,) for k in lexicon], "token string")
    known = {r[0] for r in keys.join(vocab.select("token"), "token",
                                     "left_semi").collect()}
    lexicon = {k: v for k, v in lexicon.items() if k not in known}
    cleaned = df.withColumn("sentence", T.clean(
        "sentence", ["squeeze_runs"]))
    cleaned = cleaned.withColumn("sentence", T.squeeze_emotes(
        "sentence", keep=emote_keep))
    cleaned = cleaned.withColumn("sentence", T.strip_latin("sentence"))
    cleaned = cleaned.withColumn("sentence", T.replace_chars(
        "sentence", lexicon))
    io.write_tsv(cleaned, f"{out_dir}/train_clean.tsv")
    return {"oov": report, "clean": cleaned}


# ---------------------------------------------------------------- J4

def test_conversion(spark: SparkSession, in_path: str, out_path: str,
                    schema: str = io.SINGLE_TEST_TSV) -> DataFrame:
    """Quoted TSV -> width fold on every text column -> TSV."""
    df = io.read_tsv(spark, in_path, schema, quoted=True)
    for c, t in df.dtypes:
        if t == "string":
            df = df.withColumn(c, T.fold_width(c))
    io.write_tsv(df, out_path)
    return df


# ---------------------------------------------------------------- J5 / J6

def labelled_features(split: DataFrame, features: DataFrame) -> DataFrame:
    """The rows of a resolved split (S6) with their feature vectors, which
    the encoder outside of Spark left as (id, task_id, feature). A row
    without a vector is an error."""
    have = features.select("id", "task_id", "feature")
    return split.join(have, ["id", "task_id"], "left").withColumn(
        "feature", F.when(F.col("feature").isNull(), F.raise_error(F.concat(
            F.lit("no feature for id "), F.col("id").cast("string")))
            .cast(have.schema["feature"].dataType)).otherwise(
                F.col("feature")))


def evaluate_model(features: DataFrame, heads: DataFrame | None = None,
                   arch: str = "hard", hidden: DataFrame | None = None,
                   model: Mapping | None = None, **loss) -> DataFrame:
    """Score each row with its task's head, then losses + report
    (``features``: id, task_id, target, feature). ``arch`` and its weights
    as in H7, ``loss`` as in M16."""
    scored = H.score(features, arch, heads, hidden, model)
    return M.evaluate(scored, **loss)


def predictions(features: DataFrame, heads: DataFrame | None = None,
                tasks: Mapping[str, int] | None = None, arch: str = "hard",
                hidden: DataFrame | None = None,
                model: Mapping | None = None) -> DataFrame:
    """J6 plan: score (H7), argmax, label text of the export
    -> (id string, task, label string)."""
    tasks = tasks or L.TASKS
    names = F.create_map(*[F.lit(x) for kv in
                           ((v, k) for k, v in tasks.items()) for x in kv])
    scored = H.score(features, arch, heads, hidden, model)
    return scored.select(
        F.col("id").cast("string").alias("id"),
        F.element_at(names, F.col("task_id")).alias("task"),
        L.decode_task_label(argmax("logits"), "task_id").alias("label"))


def predict_and_export(features: DataFrame, heads: DataFrame, out_dir: str,
                       tasks: Mapping[str, int] | None = None,
                       **weights) -> DataFrame:
    """Predictions written as ``{"id","label"}`` JSON lines per task."""
    pred = predictions(features, heads, tasks, **weights)
    io.write_predictions(pred, out_dir)
    return pred


__all__: Sequence[str] = [
    "pair_task_preparation", "headline_preparation", "emotion_cleaning",
    "test_conversion", "evaluate_model", "predict_and_export"]
