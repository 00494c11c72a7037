"""Registered queries: scoring, losses, metrics, parameters, encoding,
pooling and heads (M*, A*, E*, F*, H*).

Inputs are the derived tables of ``tasklane.plans.fixtures`` (scored,
tokens, layers, params), all built from the whole ``embeddings`` table.
Doubles are rounded to 9 decimals on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tasklane.functions import metrics as FM
from tasklane.operators import encode as E
from tasklane.operators import heads as H
from tasklane.operators import losses as LS
from tasklane.operators import metrics as M
from tasklane.operators import params as A
from tasklane.operators import pooling as P
from tasklane.operators import splits as K
from tasklane.operators import vocab as V
from tasklane.plans import fixtures as fx
from tasklane.plans import oracle_sql as osql
from tasklane.plans.catalog import register
from tasklane.sources.tables import read_table

R = 9
TASK_W = {0: 1.0, 1: 2.0, 2: 1.0}


def _r(c, n=R):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _ra(c, n=R):
    return F.transform(F.col(c) if isinstance(c, str) else c,
                       lambda x: F.round(x, n))


# Shared SQL: scored + log-sum-exp.
_LSE = osql.with_(osql.SCORED, """
s1 AS (SELECT *, list_max(logits) AS mx FROM scored)""", """
s2 AS (SELECT *, mx + ln(list_sum(list_transform(logits, lambda v: exp(v - mx)))) AS lse,
              CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
       FROM s1)""")


def _with(*ctes):
    """Extend ``_LSE`` with more CTEs."""
    return _LSE.rstrip("\n") + ",\n" + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------- M1 / M2

@register("m1_softmax", _LSE + """
SELECT id, list_transform(logits, lambda v: round(exp(v - lse), 9)) AS probs FROM s2""")
def q_m1(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("id", _ra(FM.softmax("logits")).alias("probs"))


@register("m2_argmax", _LSE + "SELECT id, task_id, pred FROM s2")
def q_m2(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("id", "task_id", FM.argmax("logits").alias("pred"))


# ---------------------------------------------------------------- M3 / M4

@register("m3_cross_entropy", _LSE + """
SELECT task_id, round(avg(lse - logits[target + 1]), 9) AS loss FROM s2 GROUP BY task_id""")
def q_m3(spark, sf):
    l = LS.sample_loss(fx.scored(spark, sf), (), "ce")
    return l.select("task_id", _r("loss").alias("loss"))


@register("m4_focal", _LSE + """
SELECT task_id,
       round(avg(pow(greatest(1 - (exp(logits[target + 1] - lse) + 1e-7), 0), 2.0)
                 * -ln(exp(logits[target + 1] - lse) + 1e-7)), 9) AS loss
FROM s2 GROUP BY task_id""")
def q_m4(spark, sf):
    l = LS.sample_loss(fx.scored(spark, sf), (), "focal", alpha=1.0, gamma=2.0)
    return l.select("task_id", _r("loss").alias("loss"))


# ---------------------------------------------------------------- M5 / M6

_CC = """
pr AS (SELECT {g} task_id, target,
              unnest(list_transform(logits, lambda v: {score})) AS p,
              generate_subscripts(logits, 1) - 1 AS cls FROM s2),
cc AS (SELECT {g} task_id, cls,
              sum(CASE WHEN cls = target THEN p ELSE 0 END) AS tp,
              sum(CASE WHEN cls <> target THEN p ELSE 0 END) AS fp,
              sum(CASE WHEN cls = target THEN 1 - p ELSE 0 END) AS fn
       FROM pr GROUP BY ALL)"""
_SOFT = "exp(v - lse)"


@register("m5_soft_f1", _with(_CC.format(g="", score=_SOFT)) + """
SELECT task_id,
       round(1 - avg(2 * tp / (2 * tp + fn + fp + 1e-7)), 9) AS loss_macro,
       round(1 - 2 * sum(tp) / (2 * sum(tp) + sum(fn) + sum(fp) + 1e-7), 9) AS loss_micro
FROM cc GROUP BY task_id""")
def q_m5(spark, sf):
    s = fx.scored(spark, sf)
    a = LS.sample_loss(s, (), "f1", average="macro").withColumnRenamed(
        "loss", "loss_macro")
    b = LS.sample_loss(s, (), "f1", average="micro").withColumnRenamed(
        "loss", "loss_micro")
    return a.join(b, "task_id").select("task_id", _r("loss_macro").alias(
        "loss_macro"), _r("loss_micro").alias("loss_micro"))


_HARD_CC = """
pr AS (SELECT {g} task_id, target, pred,
              unnest(generate_series(0, len(logits) - 1)) AS cls FROM s2),
cc AS (SELECT {g} task_id, cls,
              sum(CASE WHEN cls = target AND cls = pred THEN 1.0 ELSE 0.0 END) AS tp,
              sum(CASE WHEN cls <> target AND cls = pred THEN 1.0 ELSE 0.0 END) AS fp,
              sum(CASE WHEN cls = target AND cls <> pred THEN 1.0 ELSE 0.0 END) AS fn
       FROM pr GROUP BY ALL)"""


@register("m6_hard_f1", _with(_HARD_CC.format(g="")) + """
SELECT task_id,
       round(avg(2 * tp / (2 * tp + fn + fp + 1e-7)), 9) AS kpi_macro,
       round(2 * sum(tp) / (2 * sum(tp) + sum(fn) + sum(fp) + 1e-7), 9) AS kpi_micro
FROM cc GROUP BY task_id""")
def q_m6(spark, sf):
    s = fx.scored(spark, sf)
    a = M.hard_f1(s, (), "macro").withColumnRenamed("kpi", "kpi_macro")
    b = M.hard_f1(s, (), "micro").withColumnRenamed("kpi", "kpi_micro")
    return a.join(b, "task_id").select("task_id", _r("kpi_macro").alias(
        "kpi_macro"), _r("kpi_micro").alias("kpi_micro"))


# ---------------------------------------------------------------- M7 / M9 / M16

_REPORT_ROWS = """
rows AS (SELECT task_id, target AS cls,
                CASE WHEN target = pred THEN 1.0 ELSE 0.0 END AS tp, 0.0 AS fp,
                CASE WHEN target <> pred THEN 1.0 ELSE 0.0 END AS fn,
                lse - logits[target + 1] AS loss, 1 AS n FROM s2
         UNION ALL
         SELECT task_id, pred, 0.0, CASE WHEN target <> pred THEN 1.0 ELSE 0.0 END, 0.0,
                0.0, 0 FROM s2),
pc AS (SELECT task_id, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
              sum(loss) AS loss, sum(n) AS n FROM rows GROUP BY ALL),
pt AS (SELECT task_id, avg(2 * tp / (2 * tp + fp + fn)) AS f1,
              sum(loss) / sum(n) AS loss FROM pc GROUP BY task_id)"""


@register("m7_macro_f1", _with(_REPORT_ROWS) + """
SELECT task_id, round(f1, 9) AS f1 FROM pt""")
def q_m7(spark, sf):
    return M.macro_f1(fx.scored(spark, sf)).select("task_id", _r("f1").alias("f1"))


_F1COLS = """
       coalesce(max(f1) FILTER (WHERE task_id = 0), 0.0) AS f0,
       coalesce(max(f1) FILTER (WHERE task_id = 1), 0.0) AS f1_,
       coalesce(max(f1) FILTER (WHERE task_id = 2), 0.0) AS f2"""


@register("m9_report", _with(_REPORT_ROWS) + f"""
SELECT round(f0, 9) AS f1_ocnli, round(f1_, 9) AS f1_ocemotion, round(f2, 9) AS f1_tnews,
       round((f0 + f1_ + f2) / 3.0, 9) AS competition_score
FROM (SELECT {_F1COLS} FROM pt)""")
def q_m9(spark, sf):
    r = M.report(fx.scored(spark, sf))
    return r.select(*[_r(c).alias(c) for c in r.columns])


@register("m16_evaluate", _with(_REPORT_ROWS) + f"""
SELECT round(l0, 9) AS loss_ocnli, round(l1, 9) AS loss_ocemotion, round(l2, 9) AS loss_tnews,
       round(vl, 9) AS val_loss,
       round(f0, 9) AS f1_ocnli, round(f1_, 9) AS f1_ocemotion, round(f2, 9) AS f1_tnews,
       round((f0 + f1_ + f2) / 3.0, 9) AS competition_score
FROM (SELECT max(loss) FILTER (WHERE task_id = 0) AS l0,
             max(loss) FILTER (WHERE task_id = 1) AS l1,
             max(loss) FILTER (WHERE task_id = 2) AS l2,
             sum(loss) FILTER (WHERE loss > 0) / count(loss) FILTER (WHERE loss > 0) AS vl,
             {_F1COLS}
      FROM pt)""")
def q_m16(spark, sf):
    r = M.evaluate(fx.scored(spark, sf))
    return r.select(*[_r(c).alias(c) for c in r.columns])


# ---------------------------------------------------------------- M10 / M11 / M14

_BL = """
bl AS (SELECT batch_id, task_id, avg(lse - logits[target + 1]) AS loss
       FROM s2 GROUP BY ALL)"""


@register("m10_weighted_loss", _with(_BL) + """
SELECT batch_id,
       round(sum(w * loss) FILTER (WHERE loss > 0) / sum(w) FILTER (WHERE loss > 0), 9) AS loss
FROM (SELECT *, CASE task_id WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM bl)
GROUP BY batch_id""")
def q_m10(spark, sf):
    l = LS.multi_task_loss(fx.scored(spark, sf), "ce", TASK_W, "train")
    return l.select("batch_id", _r("loss").alias("loss"))


@register("m11_uncertainty_loss", _with(_BL) + """
SELECT batch_id, round(sum(loss * exp(-ln(2.0)) + ln(2.0) / 2), 9) AS loss
FROM bl GROUP BY batch_id""")
def q_m11(spark, sf):
    l = LS.multi_task_loss(fx.scored(spark, sf), "ce", "uct", "train")
    return l.select("batch_id", _r("loss").alias("loss"))


@register("m14_step_loss", _with(_BL, """
ub AS (SELECT batch_id, sum(loss) FILTER (WHERE loss > 0) / count(loss) FILTER (WHERE loss > 0) AS loss
       FROM bl GROUP BY batch_id)""") + """
SELECT CAST(batch_id // 4 AS BIGINT) AS step, round(sum(loss) / 4.0, 9) AS loss
FROM ub GROUP BY ALL""")
def q_m14(spark, sf):
    b = LS.multi_task_loss(fx.scored(spark, sf), "ce", "uni", "train")
    s = LS.step_loss(b, 4)
    return s.select("step", _r("loss").alias("loss"))


# ---------------------------------------------------------------- M12 / M13

_DTP = _with(_BL, _HARD_CC.format(g="batch_id,"), """
kp AS (SELECT batch_id, task_id, avg(2 * tp / (2 * tp + fn + fp + 1e-7)) AS kpi
       FROM cc GROUP BY ALL)""", """
seq AS (SELECT kp.*, bl.loss,
               list(kpi) OVER (PARTITION BY task_id ORDER BY batch_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ks
        FROM kp JOIN bl USING (batch_id, task_id))""", """
rr AS (SELECT batch_id, task_id, loss, kpi,
              list_reduce(list_prepend(0.5, ks), lambda r, k: 0.95 * r + 0.05 * k) AS r
       FROM seq)""", """
ww AS (SELECT *, -1.0 * pow(1 - r, 1.0) * ln(r) AS w FROM rr)""")


@register("m12_running_kpi", _DTP + """
SELECT batch_id, task_id, round(kpi, 9) AS kpi, round(r, 9) AS r, round(w, 9) AS w FROM ww""")
def q_m12(spark, sf):
    st = LS.running_kpi(fx.scored(spark, sf), running_alpha=0.05,
                        task_alpha=1.0, task_gamma=1.0)
    return st.select("batch_id", "task_id", _r("kpi").alias("kpi"),
                     _r("r").alias("r"), _r("w").alias("w"))


@register("m12_dtp_loss", _DTP + """
SELECT batch_id, round(sum(w * loss) / sum(w), 9) AS loss FROM ww GROUP BY batch_id""")
def q_m12_loss(spark, sf):
    l = LS.multi_task_loss(fx.scored(spark, sf), "ce", "dtp", "train")
    return l.select("batch_id", _r("loss").alias("loss"))


@register("m13_focal_val", _LSE + """,
fl AS (SELECT task_id,
              avg(pow(greatest(1 - (exp(logits[target + 1] - lse) + 1e-7), 0), 1.0)
                  * -ln(exp(logits[target + 1] - lse) + 1e-7)) AS loss
       FROM s2 GROUP BY task_id)
SELECT round(max(loss) FILTER (WHERE task_id = 0), 9) AS loss_ocnli,
       round(max(loss) FILTER (WHERE task_id = 1), 9) AS loss_ocemotion,
       round(max(loss) FILTER (WHERE task_id = 2), 9) AS loss_tnews,
       round(sum(loss) FILTER (WHERE loss > 0) / count(loss) FILTER (WHERE loss > 0), 9)
         AS val_loss
FROM fl""")
def q_m13(spark, sf):
    l = LS.multi_task_loss(fx.scored(spark, sf), "focal", "uct", "val")
    return l.select(*[_r(c).alias(c) for c in l.columns])


@register("m13_soft_f1_train", _with(_CC.format(g="batch_id,", score=_SOFT), """
fb AS (SELECT batch_id, task_id, 1 - avg(2 * tp / (2 * tp + fn + fp + 1e-7)) AS loss
       FROM cc GROUP BY ALL)""", """
grid AS (SELECT batch_id, unnest([0, 1, 2]) AS task_id FROM (SELECT DISTINCT batch_id FROM fb))""") + """
SELECT batch_id,
       round(sum(l) FILTER (WHERE l > 0) / count(l) FILTER (WHERE l > 0), 9) AS loss
FROM (SELECT g.batch_id, g.task_id, coalesce(fb.loss, 1.0) AS l
      FROM grid g LEFT JOIN fb USING (batch_id, task_id))
GROUP BY batch_id""")
def q_m13_f1(spark, sf):
    l = LS.multi_task_loss(fx.scored(spark, sf), "f1", "uni", "train")
    return l.select("batch_id", _r("loss").alias("loss"))


_FOCAL_ROW = """pow(greatest(1 - (exp(logits[target + 1] - lse) + 1e-7), 0), 2.0)
                  * -ln(exp(logits[target + 1] - lse) + 1e-7)"""


@register("m13_focal_dtp", _DTP + f""",
fo AS (SELECT batch_id, task_id, avg({_FOCAL_ROW}) AS fl FROM s2 GROUP BY ALL)
SELECT batch_id, round(sum(w * fl) / sum(w), 9) AS loss
FROM ww JOIN fo USING (batch_id, task_id) GROUP BY batch_id""")
def q_m13_focal_dtp(spark, sf):
    l = LS.multi_task_loss(fx.scored(spark, sf), "focal", "dtp", "train",
                           gamma=2.0)
    return l.select("batch_id", _r("loss").alias("loss"))


@register("m16_evaluate_focal", _with(_REPORT_ROWS, f"""
fo AS (SELECT task_id, avg({_FOCAL_ROW}) AS fl FROM s2 GROUP BY ALL)""") + f"""
SELECT (SELECT round(max(fl) FILTER (WHERE task_id = 0), 9) FROM fo) AS loss_ocnli,
       (SELECT round(max(fl) FILTER (WHERE task_id = 1), 9) FROM fo) AS loss_ocemotion,
       (SELECT round(max(fl) FILTER (WHERE task_id = 2), 9) FROM fo) AS loss_tnews,
       (SELECT round(sum(fl) FILTER (WHERE fl > 0) / count(fl) FILTER (WHERE fl > 0), 9)
        FROM fo) AS val_loss,
       round(f0, 9) AS f1_ocnli, round(f1_, 9) AS f1_ocemotion, round(f2, 9) AS f1_tnews,
       round((f0 + f1_ + f2) / 3.0, 9) AS competition_score
FROM (SELECT {_F1COLS} FROM pt)""")
def q_m16_focal(spark, sf):
    r = M.evaluate(fx.scored(spark, sf), sample="focal", gamma=2.0)
    return r.select(*[_r(c).alias(c) for c in r.columns])


# ---------------------------------------------------------------- M15

@register("m15_best_checkpoint", """
SELECT event_type AS run_id, first(event_id ORDER BY value DESC, event_id ASC) AS best_step,
       max(value) AS best_score
FROM events GROUP BY event_type""")
def q_m15(spark, sf):
    ev = read_table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("step"),
        F.col("value").alias("score"))
    return M.best_checkpoint(ev)


# ---------------------------------------------------------------- A1-A3

@register("a1_average_params", osql.with_(osql.PARAMS, """
x AS (SELECT name, chunk, ord, unnest(vals) AS v, generate_subscripts(vals, 1) AS i
      FROM params)""", """
avgd AS (SELECT name, chunk, i, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL)""") + """
SELECT name, chunk, list(round(v, 9) ORDER BY i) AS vals, CAST(max(n) AS INTEGER) AS n_models
FROM avgd WHERE NOT contains(name, 'position_ids') GROUP BY name, chunk
UNION ALL
SELECT name, chunk, list_transform(arg_max(vals, ord), lambda v: round(v, 9)), 1
FROM params WHERE contains(name, 'position_ids') GROUP BY name, chunk""")
def q_a1(spark, sf):
    a = A.average_params(fx.params(spark, sf), chunked=True)
    return a.select("name", "chunk", _ra("vals").alias("vals"), "n_models")


@register("a1_average_params_chunked", osql.with_(osql.PARAMS, """
x AS (SELECT name, chunk, ord, unnest(vals) AS v, generate_subscripts(vals, 1) AS i
      FROM params)""", """
avgd AS (SELECT name, chunk * 4 + (i - 1) // 16 AS c, i, avg(v) AS v, count(*) AS n
         FROM x WHERE NOT contains(name, 'position_ids') GROUP BY ALL)""", """
last AS (SELECT name, chunk, arg_max(vals, ord) AS vals FROM params
         WHERE contains(name, 'position_ids') GROUP BY name, chunk)""", """
lx AS (SELECT name, chunk, unnest(vals) AS v, generate_subscripts(vals, 1) AS i FROM last)""") + """
SELECT name, CAST(c AS INTEGER) AS chunk, list(round(v, 9) ORDER BY i) AS vals,
       CAST(max(n) AS INTEGER) AS n_models
FROM avgd GROUP BY name, c
UNION ALL
SELECT name, CAST(chunk * 4 + (i - 1) // 16 AS INTEGER), list(round(v, 9) ORDER BY i), 1
FROM lx GROUP BY name, chunk * 4 + (i - 1) // 16""")
def q_a1_chunked(spark, sf):
    c = A.chunk_params(fx.params(spark, sf), size=16, chunk_len=64)
    a = A.average_params(c, chunked=True)
    return a.select("name", "chunk", _ra("vals").alias("vals"), "n_models")


@register("a3_shape_conflicts", osql.with_(osql.PARAMS, """
p2 AS (SELECT model_id, name,
              CASE WHEN model_id = 2 AND name LIKE 'shared.1%' THEN vals[1:32]
                   ELSE vals END AS vals FROM params)""", """
shp AS (SELECT name, model_id, sum(len(vals)) AS n FROM p2 GROUP BY name, model_id)""") + """
SELECT name, count(DISTINCT n) AS n_shapes FROM shp GROUP BY name
HAVING count(DISTINCT n) > 1""")
def q_a3(spark, sf):
    p = fx.params(spark, sf)
    p = p.withColumn("vals", F.when(
        (F.col("model_id") == 2) & F.col("name").startswith("shared.1"),
        F.slice("vals", 1, 32)).otherwise(F.col("vals")))
    return A.shape_conflicts(p)


# ---------------------------------------------------------------- E1-E5

_VOCAB_SQL = """
cnt AS (SELECT c AS ch, count(*) AS n
        FROM (SELECT unnest(string_split(replace(trim(text), ' ', ''), '')) AS c FROM {src})
        WHERE c <> '' GROUP BY c),
vocab AS (SELECT token, CAST(id AS INTEGER) AS id FROM (VALUES ('[PAD]', 0), ('[UNK]', 1),
                                                   ('[CLS]', 2), ('[SEP]', 3)) t(token, id)
          UNION ALL
          SELECT ch, CAST(row_number() OVER (ORDER BY n DESC, ch) + 3 AS INTEGER)
          FROM (SELECT * FROM cnt ORDER BY n DESC, ch LIMIT {size}))"""


@register("e1_build_vocab", "WITH " + _VOCAB_SQL.format(src="documents", size=200)
          + "\nSELECT token, id FROM vocab")
def q_e1(spark, sf):
    return V.build_vocab(read_table(spark, sf, "documents", spread=True),
                         "text", 200)


_ENC_ONE = """
{name} AS (
  SELECT k, list(coalesce(v.id, 1) ORDER BY i) AS ids FROM (
    SELECT k, unnest(string_split(replace(trim({col}), ' ', ''), '')) AS c,
           generate_subscripts(string_split(replace(trim({col}), ' ', ''), ''), 1) AS i
    FROM {src}) x
  LEFT JOIN vocab v ON x.c = v.token WHERE x.c <> '' GROUP BY k)"""


@register("e2_encode_single", "WITH " + _VOCAB_SQL.format(src="documents", size=200) + ","
          + _ENC_ONE.format(name="ea", col="text",
                            src="(SELECT doc_id AS k, text FROM documents)") + """
SELECT d.doc_id, [2] || coalesce(ea.ids, []) || [3] AS input_ids,
       list_transform(range(len(coalesce(ea.ids, [])) + 2), lambda x: CAST(0 AS INTEGER))
         AS token_type_ids,
       CAST(len(coalesce(ea.ids, [])) + 2 AS INTEGER) AS length
FROM documents d LEFT JOIN ea ON d.doc_id = ea.k""")
def q_e2(spark, sf):
    d = read_table(spark, sf, "documents", spread=True)
    v = V.build_vocab(d, "text", 200)
    return E.encode(d.select("doc_id", "text"), v, "text", keep=["doc_id"])


# Words, the vocabulary's tokens and, round by round, the longest token at
# each place that the spelling of a distinct word has reached.
_SUBWORD_SQL = rf"""WITH RECURSIVE
cut AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[{V.GONE}]', '', 'g'),
               '{V.WORD}') AS ws FROM documents),
occ AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
cnt AS (SELECT w, count(*) AS n FROM occ GROUP BY w),
cand AS (SELECT unnest(list_concat(
           list_distinct([w, left(w, 1), left(w, 3)]),
           CASE WHEN length(w) > 3 THEN ['##' || substr(w, 4)] ELSE [] END,
           list_transform(range(2, length(w) + 1), lambda j: '##' || substr(w, j, 1)))) AS token, n
         FROM cnt),
top AS (SELECT token, sum(n) AS n FROM cand GROUP BY token
        ORDER BY sum(n) DESC, token LIMIT 600),
voc AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM top),
pieces AS (SELECT CASE WHEN token[:2] = '##' AND token <> '##' THEN substr(token, 3)
                    ELSE token END AS piece,
                  token[:2] = '##' AND token <> '##' AS goes_on, id FROM voc),
sizes AS (SELECT DISTINCT length(piece) AS n FROM pieces),
spelt AS (
  SELECT w, 1 AS pos, 0 AS k, CAST(NULL AS BIGINT) AS id FROM cnt WHERE length(w) <= 100
  UNION ALL
  SELECT w, pos + n, k + 1, id FROM (
    SELECT s.w, s.pos, s.k, z.n, p.id,
           row_number() OVER (PARTITION BY s.w ORDER BY z.n DESC) AS nth
    FROM spelt s JOIN sizes z ON s.pos + z.n <= length(s.w) + 1
    JOIN pieces p ON p.piece = substr(s.w, s.pos, z.n) AND p.goes_on = (s.k > 0))
  WHERE nth = 1),
done AS (SELECT w FROM spelt WHERE k > 0 AND pos = length(w) + 1),
word_ids AS (SELECT w, list(id ORDER BY k) AS ids FROM spelt SEMI JOIN done USING (w)
             WHERE k > 0 GROUP BY w),
ids AS (SELECT doc_id, flatten(list(coalesce(ids, [1]) ORDER BY i)) AS ids
        FROM occ LEFT JOIN word_ids USING (w) GROUP BY doc_id)
SELECT d.doc_id, list_transform([2] || coalesce(ids, []) || [3], lambda x: CAST(x AS INTEGER))
         AS input_ids,
       list_transform(range(len(coalesce(ids, [])) + 2), lambda x: CAST(0 AS INTEGER))
         AS token_type_ids,
       CAST(len(coalesce(ids, [])) + 2 AS INTEGER) AS length
FROM documents d LEFT JOIN ids USING (doc_id)"""


@register("e2_encode_subword", _SUBWORD_SQL)
def q_e2_subword(spark, sf):
    """E2 by words: longest match over words, stems and continuations."""
    d = read_table(spark, sf, "documents", spread=True)
    v = V.build_word_vocab(d, "text", 600)
    return E.encode_words(d.select("doc_id", "text"), v, "text",
                          keep=["doc_id"])


_PAIRS = """
pairs AS (SELECT a.conv_id * 1000 + a.turn AS pos, a.text AS s1, b.text AS s2
          FROM conversations a JOIN conversations b
            ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

_PAIR_ENC = ("WITH " + _PAIRS.strip() + ",\n" + _VOCAB_SQL.format(
    src="conversations", size=200) + "," + _ENC_ONE.format(
    name="ea", col="s1", src="(SELECT pos AS k, s1 FROM pairs)") + ","
    + _ENC_ONE.format(name="eb", col="s2", src="(SELECT pos AS k, s2 FROM pairs)")
    + """,
enc AS (
  SELECT p.pos,
         [2] || coalesce(ea.ids, []) || [3] || coalesce(eb.ids, []) || [3] AS input_ids,
         list_transform(range(len(coalesce(ea.ids, [])) + 2), lambda x: CAST(0 AS INTEGER))
           || list_transform(range(len(coalesce(eb.ids, [])) + 1), lambda x: CAST(1 AS INTEGER))
           AS token_type_ids,
         CAST(len(coalesce(ea.ids, [])) + len(coalesce(eb.ids, [])) + 3 AS INTEGER) AS length,
         CAST((row_number() OVER (ORDER BY md5('606:0:' || p.pos), p.pos) - 1) // 4 AS BIGINT)
           AS batch_id
  FROM pairs p LEFT JOIN ea ON p.pos = ea.k LEFT JOIN eb ON p.pos = eb.k),
col AS (SELECT *, max(length) OVER (PARTITION BY batch_id) AS ml FROM enc)
""")


def _pair_encoded(spark, sf):
    from tasklane.plans.registry_prep import conversation_pairs
    c = read_table(spark, sf, "conversations", spread=True)
    v = V.build_vocab(c, "text", 200)
    p = conversation_pairs(spark, sf).select("pos", "sentence1", "sentence2")
    # Order and batch first, then encode (row-wise): the rank reads its
    # input twice (counts and rows), so the encoder runs once, after it.
    o = K.shuffle_order(p, "pos", epoch=0)
    b = K.assign_batches(o, "order", batch_size=32, accumulation=8)
    return E.encode(b, v, "sentence1", "sentence2",
                    keep=["pos", "order", "batch_id", "step"])


@register("e3_e4_pair_collate", _PAIR_ENC + """
SELECT pos, batch_id,
       input_ids || list_transform(range(ml - length), lambda x: CAST(0 AS INTEGER)) AS input_ids,
       token_type_ids || list_transform(range(ml - length), lambda x: CAST(0 AS INTEGER))
         AS token_type_ids,
       list_transform(range(length), lambda x: CAST(1 AS INTEGER))
         || list_transform(range(ml - length), lambda x: CAST(0 AS INTEGER)) AS attention_mask,
       length
FROM col""")
def q_e34(spark, sf):
    b = _pair_encoded(spark, sf)
    return E.collate(b).select("pos", "batch_id", "input_ids", "token_type_ids",
                               "attention_mask", "length")


@register("e5_padding_waste", _PAIR_ENC + """
SELECT round(sum(ml - length) / sum(ml), 9) AS pad_share_dynamic,
       round(sum(greatest(512, length) - length) / sum(greatest(512, length)), 9)
         AS pad_share_fixed
FROM col""")
def q_e5(spark, sf):
    """Lengths alone: nothing is encoded and nothing of the texts moves."""
    from tasklane.plans.registry_prep import conversation_pairs
    p = E.with_length(conversation_pairs(spark, sf).select(
        "pos", "sentence1", "sentence2"), "sentence1", "sentence2").select(
            "pos", "length")
    b = K.assign_batches(K.shuffle_order(p, "pos", epoch=0), "order",
                         batch_size=32, accumulation=8)
    dyn = E.padding_waste(b, (), "batch_id").withColumnRenamed(
        "pad_share", "pad_share_dynamic")
    fix = E.padding_waste(b, (), None, fixed_len=512).withColumnRenamed(
        "pad_share", "pad_share_fixed")
    both = dyn.unionByName(fix, allowMissingColumns=True).groupBy().agg(
        F.max("pad_share_dynamic").alias("d"), F.max("pad_share_fixed").alias("f"))
    return both.select(_r("d").alias("pad_share_dynamic"),
                       _r("f").alias("pad_share_fixed"))


# ---------------------------------------------------------------- F1-F8

_TOK_EX = osql.with_(osql.TOKENS, """
tx AS (SELECT id, pos, mask, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM tokens)""")


@register("f1_max_pool", _TOK_EX + """
SELECT id, list(round(m, 9) ORDER BY d) AS feature
FROM (SELECT id, d, max(v) AS m FROM tx WHERE mask GROUP BY ALL) GROUP BY id""")
def q_f1(spark, sf):
    p = P.max_pool(fx.tokens(spark, sf))
    return p.select("id", _ra("feature").alias("feature"))


@register("f2_mean_pool", _TOK_EX + """
SELECT id, list(round(m, 9) ORDER BY d) AS feature
FROM (SELECT id, d, avg(v) AS m FROM tx WHERE mask GROUP BY ALL) GROUP BY id""")
def q_f2(spark, sf):
    p = P.mean_pool(fx.tokens(spark, sf))
    return p.select("id", _ra("feature").alias("feature"))


@register("f3_first_token", osql.with_(osql.TOKENS) + """
SELECT id, vec AS feature FROM tokens WHERE pos = 0""")
def q_f3(spark, sf):
    return P.first_token(fx.tokens(spark, sf))


@register("f4_last_token", osql.with_(osql.TOKENS) + """
SELECT id, arg_max(vec, pos) AS feature FROM tokens WHERE mask GROUP BY id""")
def q_f4(spark, sf):
    return P.last_token(fx.tokens(spark, sf))


@register("f5_layer_select", osql.with_(osql.LAYERS) + """
SELECT id, vec AS feature FROM layers WHERE layer = 2""")
def q_f5(spark, sf):
    return P.layer_select(fx.layers(spark, sf), 2)


def _layer_scores(spark):
    rows = [(t, l, 0.25 * l * (t + 1)) for t in range(3) for l in range(4)]
    return spark.createDataFrame(rows, "task_id int, layer int, score double")


@register("f6_layer_mixture", osql.with_(osql.LAYERS, """
sc AS (SELECT t AS task_id, l AS layer, 0.25 * l * (t + 1) AS score
       FROM range(0, 3) a(t), range(1, 4) b(l))""", """
sm AS (SELECT *, exp(score - max(score) OVER (PARTITION BY task_id)) AS e FROM sc)""", """
w AS (SELECT task_id, layer, e / sum(e) OVER (PARTITION BY task_id) AS w FROM sm)""", """
lx AS (SELECT l.id, l.layer, unnest(l.vec) AS v, generate_subscripts(l.vec, 1) AS d
       FROM layers l WHERE l.layer >= 1)""") + """
SELECT lx.id, list(round(s, 9) ORDER BY d) AS feature FROM (
  SELECT lx.id, d, sum(w.w * v) AS s FROM lx JOIN w
    ON w.task_id = lx.id % 3 AND w.layer = lx.layer GROUP BY ALL) lx
GROUP BY lx.id""")
def q_f6(spark, sf):
    lay = fx.layers(spark, sf)
    task_of = lay.select("id").distinct().withColumn(
        "task_id", (F.col("id") % 3).cast("int"))
    p = P.layer_mixture(lay, _layer_scores(spark), task_of)
    return p.select("id", _ra("feature").alias("feature"))


@register("f8_pooler_output", """
SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS feature
FROM embeddings""")
def q_f8(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("pooled"))
    return P.pooler_output(e)


# ---------------------------------------------------------------- H1-H3

def features_table(spark, sf):
    """(id, task_id, target, feature): embeddings as pooled features."""
    e = read_table(spark, sf, "embeddings")
    task = (F.col("vec_id") % 3).cast("int")
    n_cls = F.element_at(F.array(F.lit(3), F.lit(7), F.lit(10)), task + 1)
    return e.select(F.col("vec_id").alias("id"), task.alias("task_id"),
                    (F.col("label") % n_cls).cast("int").alias("target"),
                    F.transform("embedding", lambda x: x.cast("double"))
                    .alias("feature"))


def heads_table(spark, sf, offset: int = 0, rows=None):
    """(task_id, cls, w, b): task t's class c weight = embedding of vec_id
    offset + c, for c < C_t; bias 0 (or rows x 64 hidden units)."""
    e = read_table(spark, sf, "embeddings")
    out = None
    for t, c in enumerate([3, 7, 10]):
        n = rows or c
        part = e.where((F.col("vec_id") >= offset) &
                       (F.col("vec_id") < offset + n)).select(
            F.lit(t).alias("task_id"), (F.col("vec_id") - offset).cast("int")
            .alias("cls"), F.transform("embedding", lambda x: x.cast("double"))
            .alias("w"), F.lit(0.0).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


_HEAD_SQL = """
f AS (SELECT vec_id AS id, CAST(vec_id % 3 AS INTEGER) AS task_id,
             list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
wm AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
              AS W FROM embeddings WHERE vec_id < 10),
hm AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
              AS W FROM embeddings WHERE vec_id >= 100 AND vec_id < 164)"""


@register("h2_hard_linear", "WITH " + _HEAD_SQL.strip() + """
SELECT f.id, f.task_id,
       list_transform(list_slice((SELECT W FROM wm), 1, [3, 7, 10][f.task_id + 1]),
                      lambda r: round(list_dot_product(r, f.x), 6)) AS logits
FROM f""")
def q_h2(spark, sf):
    s = H.score(features_table(spark, sf), "hard", heads=heads_table(spark, sf))
    return s.select("id", "task_id", _ra("logits", 6).alias("logits"))


@register("h1_single_linear", "WITH " + _HEAD_SQL.strip() + """
SELECT f.id, list_transform((SELECT W FROM wm),
                            lambda r: round(list_dot_product(r, f.x), 6)) AS logits
FROM f""")
def q_h1(spark, sf):
    f = features_table(spark, sf)
    s = H.score(f, "single", heads=heads_table(spark, sf).where(
        F.col("task_id") == 2))
    return s.select("id", _ra("logits", 6).alias("logits"))


@register("h3_hard_plus", "WITH " + _HEAD_SQL.strip() + """,
hid AS (SELECT f.id, f.task_id,
               list_transform((SELECT W FROM hm), lambda r: tanh(list_dot_product(r, f.x))) AS hx
        FROM f)
SELECT hid.id, hid.task_id,
       list_transform(list_slice((SELECT W FROM wm), 1, [3, 7, 10][hid.task_id + 1]),
                      lambda r: round(list_dot_product(r, hid.hx), 6)) AS logits
FROM hid""")
def q_h3(spark, sf):
    s = H.score(features_table(spark, sf), "hard_plus",
                heads=heads_table(spark, sf),
                hidden=heads_table(spark, sf, offset=100, rows=64))
    return s.select("id", "task_id", _ra("logits", 6).alias("logits"))


# ---------------------------------------------------------------- ST1 (streaming)

@register("st1_running_kpi_stream", _DTP + """
SELECT batch_id, task_id, round(kpi, 9) AS kpi, round(r, 9) AS r, round(w, 9) AS w FROM ww""")
def q_st1(spark, sf):
    from tasklane.streaming.kpi import run_to_table
    t = run_to_table(spark, fx.scored(spark, sf), n_files=2)
    return t.select("batch_id", "task_id", _r("kpi").alias("kpi"),
                    _r("r").alias("r"), _r("w").alias("w"))


# Every tenth batch loses a row, which no later file brings.
_LOST = "vec_id % 320 = 5"


@register("st1_deadline", _DTP.replace(
    "FROM embeddings", f"FROM (SELECT * FROM embeddings WHERE NOT ({_LOST}))") + f"""
SELECT batch_id, task_id, round(kpi, 9) AS kpi, round(r, 9) AS r, round(w, 9) AS w,
       CAST(coalesce(n, 0) AS BIGINT) AS missing
FROM ww LEFT JOIN (SELECT vec_id // 32 AS batch_id, count(*) AS n FROM embeddings
                   WHERE {_LOST} GROUP BY 1) USING (batch_id)""")
def q_st1_deadline(spark, sf):
    """ST1 with lost rows: keyed state closes their batches at the deadline."""
    from tasklane.streaming import deadline
    from tasklane.streaming.kpi import read_output
    _, base = deadline.replay_lossy(spark, fx.scored(spark, sf),
                                    F.col("id") % 320 == 5, n_files=1)
    missing = deadline.read_incomplete(spark, base).select(
        "batch_id", (F.col("batch_rows") - F.col("n")).alias("missing"))
    return read_output(spark, base).join(missing, "batch_id", "left").select(
        "batch_id", "task_id", _r("kpi").alias("kpi"), _r("r").alias("r"),
        _r("w").alias("w"), F.coalesce("missing", F.lit(0).cast("long"))
        .alias("missing"))


# ---------------------------------------------------------------- F7, H4-H6, H8
# Weights are model-sized: a bounded number of embedding rows is collected
# once and broadcast. Oracles use the same rows; tests also compare with numpy.

def _rows(spark, sf, lo, hi):
    return _row_ranges(spark, sf, [(lo, hi)])[0]


def _row_ranges(spark, sf, ranges):
    """Embedding rows of several vec_id ranges, one bounded collect (model
    weights: at most sum(hi - lo) rows)."""
    import numpy as np
    cond = None
    for lo, hi in ranges:
        c = (F.col("vec_id") >= lo) & (F.col("vec_id") < hi)
        cond = c if cond is None else cond | c
    got = {r[0]: r[1] for r in read_table(spark, sf, "embeddings").where(cond)
           .select("vec_id", "embedding").collect()}
    return [np.array([got[i] for i in range(lo, hi)], dtype=np.float64)
            for lo, hi in ranges]


def numpy_model(spark, sf):
    import numpy as np
    d = 64
    t0, t1, t2, x1, x2, g, y1, y2, c = _row_ranges(
        spark, sf, [(0, 3), (0, 7), (0, 10), (100, 164), (200, 264),
                    (300, 306), (320, 384), (384, 448), (450, 454)])
    towers = {t: [(w.T, np.zeros(w.shape[0]))]
              for t, w in enumerate([t0, t1, t2])}
    assert c.shape == (4, d)
    e1 = [(x1.T, c[0]), (y1.T, c[1])]
    e2 = [(x2.T, c[2]), (y2.T, c[3])]
    gate = (g[0:2].T, np.zeros(2))
    gates = {t: (g[2 * t:2 * t + 2].T, np.zeros(2)) for t in range(3)}
    return {"towers": towers, "expert": e1, "experts": [e1, e2],
            "gate": gate, "gates": gates}


def _numpy_head(arch):
    def q(spark, sf):
        s = H.score(features_table(spark, sf), arch,
                    model=numpy_model(spark, sf))
        return s.select("id", "task_id", _ra("logits", 6).alias("logits"))
    return q


_EXPERT_SQL = "WITH " + _HEAD_SQL.strip() + """,
e2m AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
               AS W FROM embeddings WHERE vec_id >= 200 AND vec_id < 264),
gm AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
              AS W FROM embeddings WHERE vec_id >= 300 AND vec_id < 306),
y1m AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
               AS W FROM embeddings WHERE vec_id >= 320 AND vec_id < 384),
y2m AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
               AS W FROM embeddings WHERE vec_id >= 384 AND vec_id < 448),
bm AS (SELECT list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)
              AS B FROM embeddings WHERE vec_id >= 450 AND vec_id < 454),
hid AS (SELECT f.id, f.task_id, f.x,
              list_transform((SELECT W FROM hm), lambda r, i:
                greatest(list_dot_product(r, f.x) + B[1][i], 0.0)) AS h1,
              list_transform((SELECT W FROM e2m), lambda r, i:
                greatest(list_dot_product(r, f.x) + B[3][i], 0.0)) AS h2, B
       FROM f, bm),
ex AS (SELECT id, task_id, x,
              list_transform((SELECT W FROM y1m), lambda r, i:
                list_dot_product(r, h1) + B[2][i]) AS a1,
              list_transform((SELECT W FROM y2m), lambda r, i:
                list_dot_product(r, h2) + B[4][i]) AS a2
       FROM hid)"""


def _mixture_sql(gate_row: str) -> str:
    """Gate logits from gate rows ``gate_row`` and ``gate_row + 1`` (1-based
    positions in gm), softmax over the two experts, mixture, task tower."""
    return _EXPERT_SQL + f""",
gz AS (SELECT *, list_dot_product((SELECT W FROM gm)[{gate_row}], x) AS z0,
              list_dot_product((SELECT W FROM gm)[{gate_row} + 1], x) AS z1 FROM ex),
mix AS (SELECT id, task_id, a1, a2,
               exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1)))
                 AS g0 FROM gz)
SELECT id, task_id,
       list_transform(list_slice((SELECT W FROM wm), 1, [3, 7, 10][task_id + 1]),
                      lambda r: round(list_dot_product(r, list_transform(range(64),
                        lambda i: g0 * a1[i + 1] + (1 - g0) * a2[i + 1])), 6)) AS logits
FROM mix"""


register("h4_expert_mlp", _EXPERT_SQL + """
SELECT id, task_id,
       list_transform(list_slice((SELECT W FROM wm), 1, [3, 7, 10][task_id + 1]),
                      lambda r: round(list_dot_product(r, a1), 6)) AS logits
FROM ex""")(_numpy_head("expert"))
register("h5_mixture_of_experts", _mixture_sql("1"))(_numpy_head("moe"))
register("h6_multi_gate_moe", _mixture_sql("2 * task_id + 1"))(_numpy_head("mmoe"))


@register("f7_attention_pool", osql.with_(osql.TOKENS, """
te AS (SELECT vec_id - 400 AS task, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q
       FROM embeddings WHERE vec_id >= 400 AND vec_id < 403)""", """
sc AS (SELECT t.id, h.h, t.pos, t.vec,
              list_dot_product(t.vec[h.h * 16 + 1:h.h * 16 + 16],
                               te.q[h.h * 16 + 1:h.h * 16 + 16]) / 4.0 AS s
       FROM tokens t JOIN te ON te.task = t.id % 3 CROSS JOIN range(4) h(h)
       WHERE t.mask)""", """
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id, h)) AS e FROM sc)""", """
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY id, h) AS p FROM ex)""", """
dims AS (SELECT id, h, i, sum(p * vec[h * 16 + i + 1]) AS v
         FROM pr CROSS JOIN range(16) r(i) GROUP BY id, h, i)""") + """
SELECT id, list(round(v, 6) ORDER BY h, i) AS feature FROM dims GROUP BY id""")
def q_f7(spark, sf):
    import numpy as np
    tok = fx.tokens(spark, sf)
    task_of = tok.select("id").distinct().withColumn(
        "task_id", (F.col("id") % 3).cast("int"))
    w = {"task_embedding": _rows(spark, sf, 400, 403),
         "wq": np.eye(64), "wk": np.eye(64), "wv": np.eye(64)}
    p = P.attention_pool(tok, task_of, w, n_heads=4)
    return p.select("id", _ra("feature", 6).alias("feature"))


@register("h8_fit_linear_heads", osql.with_(osql.SCORED, """
c AS (SELECT task_id, target, count(*) AS k FROM scored GROUP BY ALL)""") + """
SELECT task_id, CAST(sum(k) AS BIGINT) AS n, round(max(k) / sum(k), 9) AS majority_share,
       true AS reaches_majority, true AS loss_below_uniform FROM c GROUP BY task_id""")
def q_h8(spark, sf):
    """Facts about the fit that don't depend on the optimiser: no worse than
    the majority class, and better than guessing evenly."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    f = features_table(spark, sf)
    models = H.fit_linear_heads(f, task_weights={0: 1.0, 1: 2.0, 2: 4.0},
                                max_iter=50)
    out = None
    for t, m in models.items():
        hit = (F.col("prediction") == F.col("target")).cast("double")
        loss = -F.log(F.element_at(vector_to_array("probability"),
                                   F.col("target") + 1))
        one = m.transform(f.where(F.col("task_id") == t).select(
            "task_id", "target", array_to_vector("feature").alias("features")
        )).groupBy("task_id").agg(
            F.avg(hit).alias("accuracy"), F.avg(loss).alias("loss"),
            F.lit(float(np.log(m.numClasses))).alias("uniform"))
        out = one if out is None else out.unionByName(one)
    maj = (f.groupBy("task_id", "target").count().groupBy("task_id")
           .agg(F.sum("count").alias("n"),
                (F.max("count") / F.sum("count")).alias("majority_share")))
    return out.join(maj, "task_id").select(
        "task_id", "n", _r("majority_share").alias("majority_share"),
        (F.col("accuracy") >= F.col("majority_share"))
        .alias("reaches_majority"),
        (F.col("loss") < F.col("uniform")).alias("loss_below_uniform"))


@register("h8_joint_fit", osql.with_(osql.SCORED, """
c AS (SELECT task_id, target, count(*) AS k FROM scored GROUP BY ALL)""") + """
SELECT task_id, CAST(sum(k) AS BIGINT) AS n, true AS reaches_majority,
       true AS loss_below_uniform, true AS variance_fits_loss, true AS below_separate_fits
FROM c GROUP BY task_id""")
def q_h8_joint(spark, sf):
    """Facts about the joint fit: as for H8; each learned variance is twice
    its task's loss, where the objective is least; the objective (M11) is
    below that of the separate fits after as many iterations."""
    import math

    from tasklane.operators import joint_fit
    f = features_table(spark, sf)
    fit = joint_fit.fit_jointly(f, hidden=8, steps=60, reg=0.01)
    hidden, heads = fit.tables(spark)
    scored = H.score(f, "hard_plus", heads, hidden)
    mine = LS.uncertainty_loss(LS.sample_loss(scored, [], "ce"),
                               log_variance=fit.log_variance)
    apart = None
    for t, m in H.fit_linear_heads(f, max_iter=fit.jobs, reg=0.01).items():
        one = spark.createDataFrame(
            [(t, i, w.tolist(), float(b)) for i, (w, b) in enumerate(zip(
                m.coefficientMatrix.toArray(), m.interceptVector))],
            "task_id int, cls int, w array<double>, b double")
        apart = one if apart is None else apart.unionByName(one)
    theirs = LS.uncertainty_loss(LS.sample_loss(
        H.linear_head(f, apart), [], "ce"))
    below = mine.first().loss < theirs.first().loss      # a row each
    hit = (FM.argmax("logits") == F.col("target")).cast("double")
    said = F.create_map(*[F.lit(v) for t, s in fit.log_variance.items()
                          for v in (t, math.exp(s))])
    per = scored.groupBy("task_id").agg(
        F.avg(hit).alias("accuracy"), F.avg(FM.cross_entropy(
            "logits", "target")).alias("loss"),
        F.max(F.size("logits")).alias("classes"))
    maj = (f.groupBy("task_id", "target").count().groupBy("task_id")
           .agg(F.sum("count").alias("n"),
                (F.max("count") / F.sum("count")).alias("majority")))
    return per.join(maj, "task_id").select(
        "task_id", "n", (F.col("accuracy") >= F.col("majority"))
        .alias("reaches_majority"),
        (F.col("loss") < F.log(F.col("classes"))).alias("loss_below_uniform"),
        (F.abs(said[F.col("task_id")] / (2 * F.col("loss")) - 1) < 0.1)
        .alias("variance_fits_loss"),
        F.lit(below).alias("below_separate_fits"))


# ---------------------------------------------------------------- J5 / J6

_J_LOGITS = "WITH " + _HEAD_SQL.strip() + """,
sc0 AS (SELECT f.id, f.task_id,
               CAST(e.label % [3, 7, 10][f.task_id + 1] AS INTEGER) AS target,
               list_transform(list_slice((SELECT W FROM wm), 1, [3, 7, 10][f.task_id + 1]),
                              lambda r: list_dot_product(r, f.x)) AS logits
        FROM f JOIN embeddings e ON e.vec_id = f.id),
s1 AS (SELECT *, list_max(logits) AS mx FROM sc0),
s2 AS (SELECT *, mx + ln(list_sum(list_transform(logits, lambda v: exp(v - mx)))) AS lse,
              CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
       FROM s1)"""


ORACLES_J5 = _J_LOGITS + "," + _REPORT_ROWS + f"""
SELECT round(l0, 6) AS loss_ocnli, round(l1, 6) AS loss_ocemotion, round(l2, 6) AS loss_tnews,
       round(vl, 6) AS val_loss,
       round(f0, 9) AS f1_ocnli, round(f1_, 9) AS f1_ocemotion, round(f2, 9) AS f1_tnews,
       round((f0 + f1_ + f2) / 3.0, 9) AS competition_score
FROM (SELECT max(loss) FILTER (WHERE task_id = 0) AS l0,
             max(loss) FILTER (WHERE task_id = 1) AS l1,
             max(loss) FILTER (WHERE task_id = 2) AS l2,
             sum(loss) FILTER (WHERE loss > 0) / count(loss) FILTER (WHERE loss > 0) AS vl,
             {_F1COLS}
      FROM pt)"""


@register("j5_evaluate_model", ORACLES_J5)
def q_j5(spark, sf):
    from tasklane.plans.jobs import evaluate_model
    r = evaluate_model(features_table(spark, sf), heads_table(spark, sf))
    return r.select(*[_r(c, 6 if c.startswith(("loss", "val")) else 9).alias(c)
                      for c in r.columns])


def _j6_sql():
    from tasklane.operators.labels import EMOTION_LABELS, HEADLINE_LABELS
    dec = "WHEN task_id = 0 THEN CAST(pred AS VARCHAR) " + " ".join(
        f"WHEN task_id = {t} AND pred = {i} THEN '{k}'"
        for t, d in ((1, EMOTION_LABELS), (2, HEADLINE_LABELS))
        for k, i in d.items())
    return _J_LOGITS + f"""
SELECT CAST(id AS VARCHAR) AS id,
       CASE task_id WHEN 0 THEN 'ocnli' WHEN 1 THEN 'ocemotion' ELSE 'tnews' END AS task,
       CASE {dec} END AS label
FROM s2"""


@register("j6_predictions", _j6_sql())
def q_j6(spark, sf):
    from tasklane.plans.jobs import predictions
    return predictions(features_table(spark, sf), heads_table(spark, sf))
