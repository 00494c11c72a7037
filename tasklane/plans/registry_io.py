"""File jobs and sinks as registered queries (J1, J4, W3, W4 with S1-S3).

Each query writes data Spark derives from the supplied tables into a fresh
folder under the shared checkpoint folder, runs the job or sink on it, and
returns what the matching reader gets back, so a reader/writer pair is
checked end to end against the oracle. Inputs are written in position
order (range-partitioned, part files named in order), which the readers'
file-order numbering relies on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklane.functions import text as T
from tasklane.operators import labels as L
from tasklane.plans import jobs
from tasklane.plans import oracle_sql as osql
from tasklane.plans.catalog import register
from tasklane.plans.registry_model import (_j6_sql, features_table,
                                           heads_table, q_j5)
from tasklane.plans.registry_prep import _PAIRS_SQL, conversation_pairs
from tasklane.sources import commits, io
from tasklane.sources.tables import read_table

HALF, FULL = osql.HALF, osql.FULL


def _write_jsonl(df, path):
    df.orderBy("pos").drop("pos").write.mode("overwrite").json(path)


def _j1(spark, sf):
    root = io.scratch_dir(spark, "j1")
    p = conversation_pairs(spark, sf)
    cols = ["pos", "sentence1", "sentence2", "label"]
    _write_jsonl(p.where(F.col("conv_id") % 5 != 0).select(*cols),
                 f"{root}/train.jsonl")
    _write_jsonl(p.where(F.col("conv_id") % 5 == 0).select(*cols),
                 f"{root}/dev.jsonl")
    jobs.pair_task_preparation(spark, f"{root}/train.jsonl",
                               f"{root}/dev.jsonl", f"{root}/out")
    return root + "/out"


_J1_KEPT = osql.with_(_PAIRS_SQL, """
kept AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS src
         FROM pairs WHERE label IS DISTINCT FROM '-')""")


@register("j1_pair_trainval_csv", _J1_KEPT + f"""
SELECT CAST(row_number() OVER (ORDER BY src, pos) - 1 AS BIGINT) AS id,
       translate(sentence1, {FULL}, {HALF}) AS sentence1,
       translate(sentence2, {FULL}, {HALF}) AS sentence2, label
FROM kept""")
def q_j1_trainval(spark, sf):
    """J1 (S1 JSON lines in, W1 CSV out) read back with S3."""
    out = _j1(spark, sf)
    return io.read_csv(spark, f"{out}/trainval.csv", io.PAIR_TSV)


@register("j1_pair_train_csv", _J1_KEPT + f"""
SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS id,
       translate(sentence1, {FULL}, {HALF}) AS sentence1,
       translate(sentence2, {FULL}, {HALF}) AS sentence2, label
FROM kept WHERE src = 0""")
def q_j1_train(spark, sf):
    """J1 train output (W1 CSV with header) read back with S3."""
    out = _j1(spark, sf)
    return io.read_csv(spark, f"{out}/train.csv", io.PAIR_TSV)


@register("j4_test_conversion", f"""
SELECT doc_id AS id, translate(translate(text, {HALF}, {FULL}), {FULL}, {HALF}) AS sentence
FROM documents""")
def q_j4(spark, sf):
    """A full-width test file (W2 TSV) -> S2b -> T1 -> W2, read back."""
    root = io.scratch_dir(spark, "j4")
    d = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), T.to_full_width("text").alias("sentence"))
    io.write_tsv(d.orderBy("id"), f"{root}/test.tsv")
    jobs.test_conversion(spark, f"{root}/test.tsv", f"{root}/out.tsv")
    return io.read_tsv(spark, f"{root}/out.tsv", io.SINGLE_TEST_TSV,
                       quoted=True)


@register("s3_parallel_csv", """
SELECT doc_id AS id, '"' || text || chr(10) || lang AS sentence,
       CASE WHEN source = '' THEN NULL ELSE source || '",' END AS label
FROM documents""")
def q_s3_parallel(spark, sf):
    """S3 by blocks: all documents as quoted fields with line ends, quotes
    and separators (W1), cut into records by quote parity."""
    root = io.scratch_dir(spark, "s3")
    io.write_csv(read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(
            F.lit('"'), "text", F.lit("\n"), "lang").alias("sentence"),
        F.concat("source", F.lit('",')).alias("label")), root)
    return io.read_csv(spark, root, io.SINGLE_TSV)


@register("w3_predictions_jsonl", _j6_sql())
def q_w3(spark, sf):
    """J6 export (W3: one JSON-lines folder per task) read back with S1."""
    root = io.scratch_dir(spark, "w3")
    jobs.predict_and_export(features_table(spark, sf), heads_table(spark, sf),
                            root)
    back = spark.read.schema("id string, label string, task string").json(root)
    return back.select("id", "task", "label")


@register("w3_committed_predictions", _j6_sql())
def q_w3_committed(spark, sf):
    """J6's predictions behind a manifest, after an export of other labels
    and one that was staged but never published."""
    root = io.scratch_dir(spark, "w3c")
    pred = jobs.predictions(features_table(spark, sf), heads_table(spark, sf))
    other = pred.withColumn("label", F.lit("old"))
    commits.commit_predictions(other, root)
    commits.stage(other, root, io.write_predictions)
    commits.commit_predictions(pred, root)
    return commits.read_predictions(spark, root).select("id", "task", "label")


_W4_TAGS = ["loss_ocnli", "loss_ocemotion", "loss_tnews", "val_loss",
            "f1_ocnli", "f1_ocemotion", "f1_tnews", "competition_score"]


def _w4_sql() -> str:
    from tasklane.plans.registry_model import ORACLES_J5
    body = "\nUNION ALL ".join(
        f"SELECT 'eval' AS run_id, '{t}' AS tag, CAST(0 AS BIGINT) AS step, "
        f"CAST({t} AS DOUBLE) AS value FROM j5" for t in _W4_TAGS)
    return f"WITH j5 AS ({ORACLES_J5})\n{body}"


@register("w4_metrics_log", _w4_sql())
def q_w4(spark, sf):
    """The J5 evaluation appended as (run_id, tag, step, value) rows,
    read back."""
    root = io.scratch_dir(spark, "w4")
    io.append_metrics(q_j5(spark, sf).withColumn("step", F.lit(0)), root,
                      "eval")
    return spark.read.schema(io.METRICS_SCHEMA).parquet(root)


@register("w4_committed_metrics", _w4_sql())
def q_w4_committed(spark, sf):
    """W4 behind a manifest: the J5 evaluation written, staged once more
    without a commit, and repeated."""
    root = io.scratch_dir(spark, "w4c")
    wide = q_j5(spark, sf)
    commits.commit_metrics(wide, root, "eval", 0)
    commits.stage(wide.withColumn("step", F.lit(0)), root,
                  lambda d, p: io.append_metrics(d, p, "eval"))
    commits.commit_metrics(wide, root, "eval", 0)
    return commits.read_metrics(spark, root)


# ---------------------------------------------------------------- S5 / S6 / S7

@register("s5_line_scan", """
SELECT unnest(string_split(text, chr(10))) AS value FROM documents""")
def q_s5(spark, sf):
    """Documents written as plain text, scanned line by line."""
    root = io.scratch_dir(spark, "s5")
    read_table(spark, sf, "documents").select("text").write.text(root)
    return io.read_lines(spark, root)


# Pair samples as S6's files: raw labels for a split's own CSV, their class
# numbers for the trainval TSV; a quote is put into every text, and turns
# hold line ends.
_S6_PAIRS = osql.with_(_PAIRS_SQL, """
tv AS (SELECT pos AS id, '"' || sentence1 AS sentence1, sentence2 || '"x' AS sentence2,
              CASE label WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2
                END AS n FROM pairs)""", """
named AS (SELECT *, CASE n WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral'
                           WHEN 2 THEN 'contradiction' END AS name FROM tv)""", """
f AS (SELECT *, (row_number() OVER (PARTITION BY n ORDER BY md5('606:' || id), id) - 1) % 5
                  AS fold FROM tv)""")


def _s6_pairs(spark, sf, numbered: bool):
    p = conversation_pairs(spark, sf)
    lab = None
    for raw, name, n in (("user", "entailment", 0),
                         ("assistant", "neutral", 1),
                         ("system", "contradiction", 2)):
        value = F.lit(str(n) if numbered else name)
        lab = (F.when(F.col("label") == raw, value) if lab is None
               else lab.when(F.col("label") == raw, value))
    return p.select(F.col("pos").alias("id"),
                    F.concat(F.lit('"'), "sentence1").alias("sentence1"),
                    F.concat("sentence2", F.lit('"x')).alias("sentence2"),
                    lab.alias("label"))


def _s6(spark, sf, split, explicit):
    root = io.scratch_dir(spark, "s6")
    df = _s6_pairs(spark, sf, not explicit)
    if explicit:
        io.write_csv(df, f"{root}/own.csv")
        spec = {f"ocnli_{split}_path": f"{root}/own.csv"}
    else:
        io.write_tsv(df, f"{root}/trainval.tsv")
        spec = {"ocnli_trainval_path": f"{root}/trainval.tsv", "n_folds": 5,
                "fold": 0}
    return io.load_split(spark, spec, "ocnli", split).select(
        "id", "sentence1", "sentence2", "label", "task_id", "target")


_S6_NUMBERED = """
SELECT id, sentence1, sentence2, CAST(n AS VARCHAR) AS label, 0 AS task_id, n AS target FROM """


@register("s6_load_split_train", _S6_PAIRS + _S6_NUMBERED + "f WHERE fold <> 0")
def q_s6(spark, sf):
    """Train split of fold 0 of the pair task's trainval TSV."""
    return _s6(spark, sf, "train", False)


@register("s6_load_split_trainval", _S6_PAIRS + _S6_NUMBERED + "tv")
def q_s6_trainval(spark, sf):
    """All rows of the pair task's trainval TSV."""
    return _s6(spark, sf, "trainval", False)


@register("s6_load_split_explicit_csv", _S6_PAIRS + """
SELECT id, sentence1, sentence2, name AS label, 0 AS task_id, n AS target FROM named""")
def q_s6_csv(spark, sf):
    """The pair task's own validation CSV, raw labels."""
    return _s6(spark, sf, "val", True)


def _s6_single(task, values):
    tid = L.TASKS[task]
    names = list(values.items())
    cases = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(names))
    target = " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(names))
    n = len(names)
    sql = f"""
SELECT doc_id AS id, '"' || text || chr(10) || 'z' AS sentence,
       CASE doc_id % {n} {cases} END AS label, {tid} AS task_id,
       CAST(CASE doc_id % {n} {target} END AS INTEGER) AS target FROM documents"""

    def q(spark, sf):
        root = io.scratch_dir(spark, "s6")
        label = F.element_at(F.array(*[F.lit(str(k)) for k, _ in names]),
                             (F.col("doc_id") % n + 1).cast("int"))
        io.write_tsv(read_table(spark, sf, "documents").select(
            F.col("doc_id").alias("id"), F.concat(
                F.lit('"'), "text", F.lit("\nz")).alias("sentence"),
            label.alias("label")), f"{root}/trainval.tsv")
        spec = {f"{task}_trainval_path": f"{root}/trainval.tsv"}
        return io.load_split(spark, spec, task, "trainval").select(
            "id", "sentence", "label", "task_id", "target")
    q.__doc__ = f"S6 and K3: the trainval TSV of {task}."
    register(f"s6_load_split_trainval_{task}", sql)(q)


_s6_single("ocemotion", L.EMOTION_LABELS)
_s6_single("tnews", L.HEADLINE_LABELS)


@register("s6_from_j1_csv", _J1_KEPT + f"""
SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS id,
       translate(sentence1, {FULL}, {HALF}) AS sentence1,
       translate(sentence2, {FULL}, {HALF}) AS sentence2, label,
       0 AS task_id, CAST(NULL AS INTEGER) AS target
FROM kept WHERE src = 0""")
def q_s6_j1(spark, sf):
    """The prepared train CSV as the pair task's own file. The
    turns' labels are roles, so none is in the dictionary."""
    out = _j1(spark, sf)
    return io.load_split(spark, {"ocnli_train_path": f"{out}/train.csv"},
                         "ocnli", "train").select(
        "id", "sentence1", "sentence2", "label", "task_id", "target")


def _a1_sql() -> str:
    from tasklane.plans.catalog import ORACLES
    return ORACLES["a1_average_params"]


@register("s7_param_scan_average", _a1_sql())
def q_s7(spark, sf):
    """S7 + A1: one checkpoint folder per model (parquet), scanned and
    averaged by name and chunk."""
    from tasklane.operators import params as A
    from tasklane.plans import fixtures as fx
    from tasklane.plans.registry_model import _ra
    root = io.scratch_dir(spark, "s7")
    fx.params(spark, sf).write.partitionBy("model_id").parquet(root)
    a = A.average_params(io.read_params(spark, root, chunked=True),
                         chunked=True)
    return a.select("name", "chunk", _ra("vals").alias("vals"), "n_models")


# ---------------------------------------------------------------- J2

def _j2(spark, sf):
    """The four corpus sources as the job's inputs: priority 0 as a TSV
    test file, 1 and 2 as JSON lines (dev, train), 3 as ``_!_`` lines
    (extra); label = 100 + pos % 17; newlines folded to spaces so every
    record is one line. Each file is written in position order."""
    from tasklane.plans import fixtures as fx
    root = io.scratch_dir(spark, "j2")
    # Each file's sort deals the rows out, so the scan needn't.
    c = fx.corpus(spark, sf, spread=False).select(
        "prio", "pos",
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"),
        (F.lit(100) + F.col("pos") % 17).cast("string").alias("label"))
    p = F.col("prio")
    (c.where(p == 0).orderBy("pos")
     .select(F.concat_ws("\t", F.col("pos").cast("string"), "t", "label"))
     .write.text(f"{root}/test"))
    for prio, name in ((1, "dev"), (2, "train")):
        (c.where(p == prio).orderBy("pos")
         .select(F.col("t").alias("sentence"), "label")
         .write.json(f"{root}/{name}"))
    (c.where(p == 3).orderBy("pos")
     .select(F.concat(F.col("pos").cast("string"), F.lit("_!_"), "label",
                      F.lit("_!_name_!_"), "t", F.lit("_!_")))
     .write.text(f"{root}/extra"))
    jobs.headline_preparation(spark, f"{root}/test", f"{root}/dev",
                              f"{root}/train", f"{root}/extra", f"{root}/out")
    return root + "/out"


_J2_IDED = osql.with_(osql.CORPUS, """
src AS (SELECT prio, pos, replace(text, chr(10), ' ') AS t,
               CAST(100 + pos % 17 AS VARCHAR) AS label FROM corpus)""", """
src2 AS (SELECT prio, pos, label,
                CASE WHEN prio = 3
                     THEN string_split(CAST(pos AS VARCHAR) || '_!_' || label || '_!_name_!_'
                                       || t || '_!_', '_!_')[4]
                     ELSE t END AS s FROM src)""", f"""
fp AS (SELECT prio, row_number() OVER (PARTITION BY prio ORDER BY pos) - 1 AS fpos,
              translate(replace(s, chr(9), ''), {FULL}, {HALF}) AS sentence, label
       FROM src2)""", """
w AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY prio, fpos) AS rn FROM fp)""",
"""
ided AS (SELECT prio, fpos, sentence, CAST(label AS INTEGER) AS label,
                CAST(row_number() OVER (PARTITION BY prio ORDER BY fpos) - 1 AS BIGINT) AS id
         FROM w WHERE rn = 1 AND prio > 0)""")


@register("j2_headline_extra_csv", _J2_IDED + """
SELECT id, sentence, label FROM ided WHERE prio = 3""")
def q_j2_extra(spark, sf):
    """J2 extra output (W1 CSV) read back with S3."""
    out = _j2(spark, sf)
    return io.read_csv(spark, f"{out}/extra.csv",
                       "id long, sentence string, label int")


@register("j2_headline_trainval_tsv", _J2_IDED + """
SELECT CAST(row_number() OVER (ORDER BY CASE prio WHEN 2 THEN 0 ELSE 1 END, fpos) - 1
            AS BIGINT) AS id,
       sentence, CAST(label AS VARCHAR) AS label
FROM ided WHERE prio IN (1, 2)""")
def q_j2_trainval(spark, sf):
    """J2 train-then-dev union (W2 TSV) read back with S2b."""
    out = _j2(spark, sf)
    return io.read_tsv(spark, f"{out}/trainval.tsv", io.SINGLE_TSV, quoted=True)


# ---------------------------------------------------------------- J3

# Every document becomes one training sentence with a run, an emote block,
# Latin letters and emoji appended (newlines folded to spaces).
_J3_SENT_SPARK = ("concat(replace(text, '\\n', ' '), repeat('哈', cast(doc_id % 15 as int)), "
                  "'b', repeat('[怒]', cast(doc_id % 40 as int)), 'Zz', "
                  "repeat('😭', cast(doc_id % 3 as int)), '😀')")
_J3_SENT_SQL = ("replace(text, chr(10), ' ') || repeat('哈', CAST(doc_id % 15 AS INTEGER)) || "
                "'b' || repeat('[怒]', CAST(doc_id % 40 AS INTEGER)) || 'Zz' || "
                "repeat('😭', CAST(doc_id % 3 AS INTEGER)) || '😀'")


def _j3(spark, sf):
    from tasklane.plans.registry_prep import LEXICON
    root = io.scratch_dir(spark, "j3")
    d = read_table(spark, sf, "documents", spread=True).select(
        "doc_id", F.expr(_J3_SENT_SPARK).alias("s"),
        (F.col("doc_id") % 7).cast("string").alias("label"))
    (d.orderBy("doc_id")
     .select(F.concat_ws("\t", F.col("doc_id").cast("string"), "s", "label"))
     .write.text(f"{root}/train"))
    # The vocabulary knows one of the lexicon's characters.
    vocab = (read_table(spark, sf, "benchmark").select(F.explode(F.concat(
        T.char_array("text"), F.array(F.lit("😀")))).alias("token"))
        .distinct())
    outs = jobs.emotion_cleaning(spark, f"{root}/train", vocab, LEXICON,
                                 f"{root}/out")
    return root, outs


@register("j3_emotion_clean_tsv", f"""
WITH src AS (SELECT doc_id, {_J3_SENT_SQL} AS x, CAST(doc_id % 7 AS VARCHAR) AS label,
                    CAST(doc_id % 40 AS INTEGER) AS ne FROM documents),
ch AS (SELECT doc_id, unnest(string_split(x, '')) AS c,
              generate_subscripts(string_split(x, ''), 1) AS i FROM src),
isl AS (SELECT doc_id, c, i,
               i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch),
runs AS (SELECT doc_id, c, i,
                row_number() OVER (PARTITION BY doc_id, c, g ORDER BY i) AS k FROM isl),
sq AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS y FROM runs
       WHERE c = chr(10) OR k <= 6 GROUP BY doc_id),
em AS (SELECT sq.doc_id, src.label,
              replace(y, 'b' || repeat('[怒]', ne) || 'Zz',
                      'b' || repeat('[怒]', least(ne, 30)) || 'Zz') AS y
       FROM sq JOIN src ON sq.doc_id = src.doc_id)
SELECT doc_id AS id,
       replace(regexp_replace(y, '[A-Za-z]+', '', 'g'), '😭', ':大声哭喊的脸:')
         AS sentence,
       label
FROM em""")
def q_j3_clean(spark, sf):
    """J3 cleaned sentences (W2 TSV) read back with S2b."""
    root, _ = _j3(spark, sf)
    return io.read_tsv(spark, f"{root}/out/train_clean.tsv", io.SINGLE_TSV,
                       quoted=True)


@register("t10_clean_emotion_train", f"""
WITH src AS (SELECT doc_id, repeat('哈', CAST(doc_id % 15 AS INTEGER)) AS a,
                    repeat('[怒]', CAST(doc_id % 40 AS INTEGER)) AS b, doc_id % 15 AS na,
                    doc_id % 40 AS nb FROM documents)
SELECT doc_id, repeat('哈', CAST(least(na, 6) AS INTEGER)) ||
       repeat('[怒]', CAST(least(nb, 30) AS INTEGER)) || '，' AS text
FROM src""")
def q_t10_emotion(spark, sf):
    """The emotion recipe squeezes runs and emotes, drops Latin."""
    raw = ("concat(repeat('哈', cast(doc_id % 15 as int)), 'b', "
           "repeat('[怒]', cast(doc_id % 40 as int)), 'Zz，')")
    return read_table(spark, sf, "documents").select("doc_id", T.clean(
        F.expr(raw), "emotion_train").alias("text"))


@register("j3_emotion_oov_report", f"""
WITH v AS (SELECT DISTINCT unnest(string_split(replace(trim(text), ' ', '') || '😀', ''))
             AS c FROM benchmark),
x AS (SELECT unnest(string_split(replace(trim({_J3_SENT_SQL}), ' ', ''), '')) AS c
      FROM documents)
SELECT c AS ch, count(*) AS n FROM x
WHERE c <> '' AND c NOT IN (SELECT c FROM v WHERE c IS NOT NULL)
GROUP BY c""")
def q_j3_oov(spark, sf):
    """J3 out-of-vocabulary character report over the training file."""
    _, outs = _j3(spark, sf)
    return outs["oov"]
