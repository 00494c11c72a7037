"""Registered queries: text cleaning, labels, unions, splits (T*, P*, U*, K*).

Every query reads whole supplied tables; derived text is built by the same
expression here and in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklane.functions import text as T
from tasklane.operators import dedup, labels as L, splits as K
from tasklane.plans import oracle_sql as osql
from tasklane.plans.catalog import register
from tasklane.sources.tables import read_table

HALF, FULL = osql.HALF, osql.FULL
# The two-entry emoji lexicon of the fixtures.
LEXICON = {"😭": ":大声哭喊的脸:", "😀": ":嘿嘿:"}


def _docs(spark, sf):
    return read_table(spark, sf, "documents", spread=True)


# ---------------------------------------------------------------- T1 / T2

@register("t1_fold_width", f"""
SELECT doc_id, translate(translate(text, {HALF}, {FULL}), {FULL}, {HALF}) AS text
FROM documents""")
def q_t1(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.fold_width(T.to_full_width("text")).alias("text"))


@register("t2_remove_tabs", """
SELECT doc_id,
       replace(substr(text, 1, 10) || chr(9) || substr(text, 11) || chr(9), chr(9), '') AS text
FROM documents""")
def q_t2(spark, sf):
    d = _docs(spark, sf)
    tabbed = F.concat(F.substring("text", 1, 10), F.lit("\t"),
                      F.expr("substr(text, 11)"), F.lit("\t"))
    return d.select("doc_id", T.remove_tabs(tabbed).alias("text"))


# ---------------------------------------------------------------- T3 runs

_RUN_SPARK = ("concat(substr(text, 1, 20), repeat('哈', cast(doc_id % 15 as int)), 'b', "
              "repeat('^', cast(doc_id % 9 as int)), substr(text, 21))")
_RUN_SQL = ("substr(text, 1, 20) || repeat('哈', CAST(doc_id % 15 AS INTEGER)) || 'b' || "
            "repeat('^', CAST(doc_id % 9 AS INTEGER)) || substr(text, 21)")


@register("t3_squeeze_runs", f"""
WITH src AS (SELECT doc_id, {_RUN_SQL} AS x FROM documents),
ch AS (SELECT doc_id, unnest(string_split(x, '')) AS c,
              generate_subscripts(string_split(x, ''), 1) AS i FROM src),
isl AS (SELECT doc_id, c, i,
               i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch),
runs AS (SELECT doc_id, c, i,
                row_number() OVER (PARTITION BY doc_id, c, g ORDER BY i) AS k FROM isl)
SELECT doc_id, string_agg(c, '' ORDER BY i) AS text
FROM runs WHERE c = chr(10) OR k <= 6 GROUP BY doc_id""")
def q_t3(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.squeeze_runs(F.expr(_RUN_SPARK)).alias("text"))


# ---------------------------------------------------------------- T4 emotes

def _emote_spark():
    n = (F.col("doc_id") % 40).cast("int")
    return F.concat(F.col("text"), F.lit("x"), F.expr(
        "repeat('[怒]', cast(doc_id % 40 as int))"), F.lit("y[泪][泪]")), n


@register("t4_squeeze_emotes_cap", """
SELECT doc_id, text || 'x' || repeat('[怒]', least(CAST(doc_id % 40 AS INTEGER), 30))
               || 'y[泪][泪]' AS text
FROM documents""")
def q_t4_cap(spark, sf):
    x, _ = _emote_spark()
    return _docs(spark, sf).select(
        "doc_id", T.squeeze_emotes(x, keep=30, mode="cap").alias("text"))


@register("t4_squeeze_emotes_thin", """
SELECT doc_id, text || 'x' || repeat('[怒]', CAST(doc_id % 40 AS INTEGER)
                                     - 2 * (CAST(doc_id % 40 AS INTEGER) // 4))
               || 'y[泪][泪]' AS text
FROM documents""")
def q_t4_thin(spark, sf):
    x, _ = _emote_spark()
    return _docs(spark, sf).select(
        "doc_id", T.squeeze_emotes(x, mode="thin").alias("text"))


# ---------------------------------------------------------------- T5 Latin

@register("t5_strip_latin", """
SELECT doc_id, regexp_replace(text, '[A-Za-z]+', '', 'g') AS text,
       regexp_replace(substr(text, 1, greatest(length(text) - 20, 0)), '[A-Za-z]+', '', 'g')
         || substr(text, greatest(length(text) - 20, 0) + 1, 20) AS text_keep_tail
FROM documents""")
def q_t5(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.strip_latin("text").alias("text"),
                    T.strip_latin("text", keep_tail=20).alias("text_keep_tail"))


# ---------------------------------------------------------------- T6 / T7

@register("t6_char_counts", """
SELECT c AS ch, count(*) AS n
FROM (SELECT unnest(string_split(replace(trim(text), ' ', ''), '')) AS c FROM documents)
WHERE c <> '' GROUP BY c""")
def q_t6(spark, sf):
    from tasklane.operators.vocab import char_counts
    return char_counts(_docs(spark, sf), "text")


_EMOJI_SPARK = "concat(text, repeat('😭', cast(doc_id % 3 as int)), '😀')"
_EMOJI_SQL = "text || repeat('😭', CAST(doc_id % 3 AS INTEGER)) || '😀'"


@register("t7_oov_char_counts", f"""
WITH v AS (SELECT DISTINCT unnest(string_split(replace(trim(text), ' ', ''), '')) AS c
           FROM benchmark),
x AS (SELECT unnest(string_split(replace(trim({_EMOJI_SQL}), ' ', ''), '')) AS c
      FROM documents)
SELECT c AS ch, count(*) AS n FROM x
WHERE c <> '' AND c NOT IN (SELECT c FROM v WHERE c IS NOT NULL)
GROUP BY c""")
def q_t7(spark, sf):
    from tasklane.operators.vocab import oov_counts
    vocab = (read_table(spark, sf, "benchmark")
             .select(F.explode(T.char_array("text")).alias("token")).distinct())
    d = _docs(spark, sf).select(F.expr(_EMOJI_SPARK).alias("text"))
    return oov_counts(d, "text", vocab)


@register("t8_emoji_names", f"""
SELECT doc_id, replace(replace({_EMOJI_SQL}, '😭', ':大声哭喊的脸:'), '😀', ':嘿嘿:') AS text
FROM documents""")
def q_t8(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.replace_chars(F.expr(_EMOJI_SPARK), LEXICON)
                    .alias("text"))


@register("t8_emoji_names_table", f"""
SELECT doc_id, replace(replace({_EMOJI_SQL}, '😭', ':大声哭喊的脸:'), '😀', ':嘿嘿:') AS text
FROM documents""")
def q_t8_table(spark, sf):
    from tasklane.operators.vocab import replace_chars_table
    d = _docs(spark, sf).select("doc_id", F.expr(_EMOJI_SPARK).alias("text"))
    lex = spark.createDataFrame(list(LEXICON.items()), "ch string, rep string")
    return replace_chars_table(d, "doc_id", "text", lex)


# ---------------------------------------------------------------- T9 / T10

_RULES = [("[ \\t\\r\\n]+", " "), ("[0-9]+", "#")]


@register("t9_regex_rules", """
SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'),
                              '[0-9]+', '#', 'g') AS text
FROM documents""")
def q_t9(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", T.apply_rules("text", _RULES).alias("text"))


@register("t10_clean_headline", f"""
SELECT doc_id,
       translate(replace(translate(substr(text, 1, 10) || chr(9) || substr(text, 11),
                                   {HALF}, {FULL}), chr(9), ''), {FULL}, {HALF}) AS text
FROM documents""")
def q_t10(spark, sf):
    x = T.to_full_width(F.concat(F.substring("text", 1, 10), F.lit("\t"),
                                 F.expr("substr(text, 11)")))
    return _docs(spark, sf).select("doc_id", T.clean(x, "headline").alias("text"))


def _t10_fold(recipe):
    @register(f"t10_clean_{recipe}", f"""
SELECT doc_id, translate(translate(text || chr(9), {HALF}, {FULL}), {FULL}, {HALF}) AS text
FROM documents""")
    def q(spark, sf):
        return _docs(spark, sf).select("doc_id", T.clean(T.to_full_width(
            F.concat("text", F.lit("\t"))), recipe).alias("text"))
    q.__doc__ = f"T10: the {recipe} recipe folds widths and keeps tabs."


_t10_fold("pair")
_t10_fold("test")


# ---------------------------------------------------------------- S4 + P4/P5/P7

_LINE_SPARK = ("concat(cast(doc_id as string), '_!_', cast(100 + doc_id % 17 as string), "
               "'_!_name_!_', translate(text, '\\n', ' '), '_!_')")
_LINE_SQL = ("CAST(doc_id AS VARCHAR) || '_!_' || CAST(100 + doc_id % 17 AS VARCHAR) || "
             "'_!_name_!_' || replace(text, chr(10), ' ') || '_!_'")
_TN_VALUES = ", ".join(f"({k}, {v})" for k, v in L.HEADLINE_LABELS.items())


@register("s4_headline_lines", f"""
WITH lines AS (SELECT doc_id AS line_no, {_LINE_SQL} AS line FROM documents),
parsed AS (SELECT line_no, string_split(line, '_!_') AS f FROM lines),
dict(code, idx) AS (VALUES {_TN_VALUES})
SELECT line_no AS id,
       translate(replace(f[4], chr(9), ''), {FULL}, {HALF}) AS sentence,
       CAST(f[2] AS INTEGER) AS code,
       CAST(dict.idx AS INTEGER) AS label
FROM parsed LEFT JOIN dict ON CAST(f[2] AS INTEGER) = dict.code""")
def q_s4(spark, sf):
    from tasklane.sources.io import parse_delimited_lines
    lines = _docs(spark, sf).select(F.col("doc_id").alias("line_no"),
                                    F.expr(_LINE_SPARK).alias("value"))
    p = parse_delimited_lines(lines, line_no="line_no")
    return p.select(F.col("line_no").alias("id"),
                    T.clean("sentence", "headline").alias("sentence"),
                    L.strict_int("code").alias("code"),
                    L.encode_label(L.strict_int("code"), L.HEADLINE_LABELS)
                    .cast("int").alias("label"))


# ---------------------------------------------------------------- pair task (J1 parts)

def conversation_pairs(spark, sf):
    """Pair samples: a turn and the next turn of the same conversation;
    label = role of the next turn; '-' where pos % 11 = 0, NULL where
    pos % 13 = 0 (unlabelled cases)."""
    c = read_table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"),
                 F.col("text").alias("sentence2"), F.col("role"))
    j = a.join(b, ["conv_id", "turn"], "inner")
    pos = F.col("conv_id") * 1000 + F.col("turn")
    lab = (F.when(pos % 11 == 0, F.lit("-")).when(pos % 13 == 0, F.lit(None))
           .otherwise(F.col("role")))
    return j.select(pos.alias("pos"), "conv_id", "sentence1", "sentence2",
                    lab.alias("label"))


_PAIRS_SQL = """
pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS pos, a.conv_id, a.text AS sentence1,
         b.text AS sentence2,
         CASE WHEN (a.conv_id * 1000 + a.turn) % 11 = 0 THEN '-'
              WHEN (a.conv_id * 1000 + a.turn) % 13 = 0 THEN NULL
              ELSE b.role END AS label
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
)"""


@register("p2_drop_unlabelled", osql.with_(_PAIRS_SQL) + """
SELECT pos, sentence1, sentence2, label FROM pairs WHERE label IS DISTINCT FROM '-'""")
def q_p2(spark, sf):
    p = conversation_pairs(spark, sf)
    return L.drop_unlabelled(p).select("pos", "sentence1", "sentence2", "label")


@register("u1_pair_trainval", osql.with_(_PAIRS_SQL, f"""
kept AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS src
         FROM pairs WHERE label IS DISTINCT FROM '-')""") + f"""
SELECT CAST(row_number() OVER (ORDER BY src, pos) - 1 AS BIGINT) AS id,
       src, pos,
       translate(sentence1, {FULL}, {HALF}) AS sentence1,
       translate(sentence2, {FULL}, {HALF}) AS sentence2, label
FROM kept""")
def q_u1(spark, sf):
    p = L.drop_unlabelled(conversation_pairs(spark, sf))
    p = p.select("pos", T.fold_width("sentence1").alias("sentence1"),
                 T.fold_width("sentence2").alias("sentence2"), "label",
                 "conv_id")
    train = p.where(F.col("conv_id") % 5 != 0).drop("conv_id")
    dev = p.where(F.col("conv_id") % 5 == 0).drop("conv_id")
    u = dedup.ordered_union([train, dev], pos="pos", src="src", id_col="id")
    return u.select("id", "src", "pos", "sentence1", "sentence2", "label")


# ---------------------------------------------------------------- U2 joint union + P5/P8

_ROLE_DICT = {"user": "entailment", "assistant": "neutral", "system": "contradiction"}
_LANG_DICT = {"en": "happiness", "fr": "sadness", "de": "like", "es": "anger"}


def _case(col, d):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in d.items()) + " END"


def _map_col(col, d):
    m = F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.try_element_at(m, F.col(col))


@register("u2_joint_union", osql.with_(_PAIRS_SQL, f"""
lines AS (SELECT doc_id, {_LINE_SQL} AS line FROM documents),
dict(code, idx) AS (VALUES {_TN_VALUES}),
emo(raw, idx) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in L.EMOTION_LABELS.items())}),
nli(raw, idx) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in L.PAIR_LABELS.items())}),
j AS (
  SELECT 0 AS task_id, pos AS id, sentence1, sentence2, {_case('label', _ROLE_DICT)} AS raw
  FROM pairs WHERE label IS DISTINCT FROM '-'
  UNION ALL
  SELECT 1, doc_id, text, NULL, {_case('lang', _LANG_DICT)} FROM documents
  UNION ALL
  SELECT 2, doc_id, string_split(line, '_!_')[4], NULL, string_split(line, '_!_')[2] FROM lines
)""") + """
SELECT j.task_id, j.id, j.sentence1, j.sentence2, j.raw AS label,
       CAST(CASE j.task_id WHEN 0 THEN nli.idx WHEN 1 THEN emo.idx
            ELSE dict.idx END AS INTEGER) AS target
FROM j LEFT JOIN nli ON j.task_id = 0 AND j.raw = nli.raw
       LEFT JOIN emo ON j.task_id = 1 AND j.raw = emo.raw
       LEFT JOIN dict ON j.task_id = 2 AND j.raw = CAST(dict.code AS VARCHAR)""")
def q_u2(spark, sf):
    from tasklane.sources.io import parse_delimited_lines
    pairs = L.drop_unlabelled(conversation_pairs(spark, sf)).select(
        F.col("pos").alias("id"), "sentence1", "sentence2",
        _map_col("label", _ROLE_DICT).alias("label"))
    # One scan: a document is a sample of both single-text tasks.
    lines = read_table(spark, sf, "documents", spread=True).select(
        F.col("doc_id").alias("id"), "text", "lang",
        F.expr(_LINE_SPARK).alias("value"))
    parsed = parse_delimited_lines(lines, "id", keep=["text", "lang"])
    singles = parsed.select("id", F.inline(F.array(
        F.struct(F.lit(1).alias("task_id"), F.col("text").alias("sentence1"),
                 _map_col("lang", _LANG_DICT).alias("label")),
        F.struct(F.lit(2).alias("task_id"),
                 F.col("sentence").alias("sentence1"),
                 F.col("code").alias("label")))))
    j = L.tag_task(pairs, 0).unionByName(singles, allowMissingColumns=True)
    return j.select("task_id", "id", "sentence1", "sentence2", "label",
                    L.encode_task_label("label", "task_id").cast("int")
                    .alias("target"))


# ---------------------------------------------------------------- P6/P9/P10/P11

_DEC_SQL = "WHEN task_id = 0 THEN CAST(pred AS VARCHAR) " + " ".join(
    f"WHEN task_id = {t} AND pred = {i} THEN '{k}'"
    for t, d in ((1, L.EMOTION_LABELS), (2, L.HEADLINE_LABELS))
    for k, i in d.items())


@register("p6_label_decode", osql.with_(osql.SCORED, """
pr AS (SELECT id, task_id,
              CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
       FROM scored)""") + f"""
SELECT CAST(id AS VARCHAR) AS id, task_id, CASE {_DEC_SQL} END AS label FROM pr""")
def q_p6(spark, sf):
    from tasklane.functions.metrics import argmax
    from tasklane.plans import fixtures as fx
    s = fx.scored(spark, sf)
    return s.select(F.col("id").cast("string").alias("id"), "task_id",
                    L.decode_task_label(argmax("logits"), "task_id")
                    .alias("label"))


@register("p9_head_per_task", osql.with_(osql.SCORED) + """
SELECT id, task_id, target FROM (
  SELECT id, task_id, target,
         row_number() OVER (PARTITION BY task_id ORDER BY id) AS rn FROM scored)
WHERE rn <= 4""")
def q_p9(spark, sf):
    from tasklane.plans import fixtures as fx
    s = fx.scored(spark, sf).select("id", "task_id", "target")
    return L.head_per_task(s, 4, "task_id", "id")


@register("p10_positional_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 600 THEN 'head'
                    ELSE 'tail' END AS part
FROM documents""")
def q_p10(spark, sf):
    d = _docs(spark, sf).select("doc_id")
    a, b = L.positional_split(d, 600, pos="doc_id")
    return a.withColumn("part", F.lit("head")).unionByName(
        b.withColumn("part", F.lit("tail")))


@register("p11_task_mask", osql.with_(osql.SCORED) + """
SELECT id, target FROM scored WHERE task_id = 1""")
def q_p11(spark, sf):
    from tasklane.plans import fixtures as fx
    return L.task_mask(fx.scored(spark, sf), "ocemotion").select("id", "target")


# ---------------------------------------------------------------- K1-K6

_MD5N = "CAST(('0x' || substr({x}, 1, 15)) AS BIGINT)"


@register("k1_folds_lineitem", """
SELECT l_orderkey, l_linenumber, l_returnflag,
       CAST((row_number() OVER (PARTITION BY l_returnflag
             ORDER BY md5('606:' || l_orderkey || '-' || l_linenumber),
                      l_orderkey || '-' || l_linenumber) - 1) % 5 AS INTEGER) AS fold
FROM lineitem""")
def q_k1_lineitem(spark, sf):
    li = read_table(spark, sf, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", "l_returnflag")
    li = li.withColumn("_id", F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                          F.col("l_linenumber").cast("string")))
    return K.stratified_folds(li, "_id", "l_returnflag").drop("_id")


@register("k1_folds_documents", """
SELECT doc_id, lang,
       CAST((row_number() OVER (PARTITION BY lang ORDER BY md5('606:' || doc_id), doc_id) - 1)
            % 5 AS INTEGER) AS fold
FROM documents""")
def q_k1_docs(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    return K.stratified_folds(d, "doc_id", "lang")


@register("k2_fold_select", """
WITH f AS (SELECT doc_id, lang,
       (row_number() OVER (PARTITION BY lang ORDER BY md5('606:' || doc_id), doc_id) - 1) % 5 AS fold
       FROM documents)
SELECT lang, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS split, count(*) AS n
FROM f GROUP BY ALL""")
def q_k2(spark, sf):
    d = K.stratified_folds(_docs(spark, sf).select("doc_id", "lang"),
                           "doc_id", "lang")
    tr = K.fold_select(d, 2, "train").withColumn("split", F.lit("train"))
    va = K.fold_select(d, 2, "val").withColumn("split", F.lit("val"))
    return tr.unionByName(va).groupBy("lang", "split").agg(
        F.count(F.lit(1)).alias("n"))


@register("k4_oversample", f"""
WITH ev AS (SELECT event_type, event_id,
                   row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rk
            FROM events),
cnt AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
ex AS (SELECT event_type, n, max(n) OVER () - n AS extra FROM cnt),
dr AS (SELECT event_type, n, j AS draw FROM ex, range(0, extra) t(j) WHERE extra > 0),
pk AS (SELECT event_type, draw,
              {_MD5N.format(x="md5('606:' || event_type || ':' || draw)")} % n AS rk FROM dr)
SELECT event_type, event_id, CAST(NULL AS BIGINT) AS draw FROM ev
UNION ALL
SELECT pk.event_type, ev.event_id, pk.draw FROM pk JOIN ev
  ON pk.event_type = ev.event_type AND pk.rk = ev.rk""")
def q_k4(spark, sf):
    ev = read_table(spark, sf, "events").select("event_type", "event_id")
    return K.oversample(ev, task="event_type", id_col="event_id").select(
        "event_type", "event_id", "draw")


@register("k4_multinomial_split", """
WITH cnt AS (SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids
             FROM events GROUP BY event_type)
SELECT event_type, n AS n_rows, n_ids, max(n) OVER () - n AS n_drawn,
       max(n) OVER () AS n_total
FROM cnt""")
def q_k4_split(spark, sf):
    """K4 by multinomial splitting; the draws are numpy's, the totals SQL's."""
    from tasklane.operators.multinomial import oversample_split
    ev = read_table(spark, sf, "events").select("event_type", "event_id")
    return oversample_split(ev, "event_type", "event_id").groupBy(
        "event_type").agg(
            F.count_if(F.col("copy") == 0).alias("n_rows"),
            F.countDistinct("event_id").alias("n_ids"),
            F.count_if(F.col("copy") > 0).alias("n_drawn"),
            F.count(F.lit(1)).alias("n_total"))


@register("k5_shuffle", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('606:0:' || doc_id), doc_id) - 1 AS BIGINT)
       AS "order"
FROM documents""")
def q_k5(spark, sf):
    return K.shuffle_order(_docs(spark, sf).select("doc_id"), "doc_id")


@register("k6_batches", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('606:1:' || doc_id), doc_id) - 1 AS rk
           FROM documents)
SELECT doc_id, CAST(rk AS BIGINT) AS "order", CAST(rk // 4 AS BIGINT) AS batch_id,
       CAST(rk // 32 AS BIGINT) AS step
FROM o""")
def q_k6(spark, sf):
    o = K.shuffle_order(_docs(spark, sf).select("doc_id"), "doc_id", epoch=1)
    return K.assign_batches(o, "order", batch_size=32, accumulation=8).select(
        "doc_id", "order", "batch_id", "step")


# ---------------------------------------------------------------- D1 / D2 / D4

@register("d1_keep_first", """
SELECT text, min(doc_id) AS pos FROM documents GROUP BY text""")
def q_d1(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("pos"), "text")
    return dedup.keep_first(d, F.col("text"), "pos").select(
        F.col("key").alias("text"), "pos")


_D2_SQL = osql.with_(osql.CORPUS, """
fp AS (SELECT text, min(prio) AS p FROM corpus GROUP BY text)""") + """
SELECT c.prio, c.pos, c.text FROM corpus c JOIN fp ON c.text = fp.text AND c.prio = fp.p"""


@register("d2_bloom_subtract", _D2_SQL)
def q_d2_bloom(spark, sf):
    """D2 behind Bloom filters of the earlier sources' keys."""
    from tasklane.operators.bitmaps import subtract_filtered
    from tasklane.plans import fixtures as fx
    return subtract_filtered(fx.corpus(spark, sf), "text", "prio").select(
        "prio", "pos", "text")


@register("d2_subtract_earlier", _D2_SQL)
def q_d2(spark, sf):
    from tasklane.plans import fixtures as fx
    return dedup.subtract_earlier(fx.corpus(spark, sf), "text", "prio").select(
        "prio", "pos", "text")


@register("d4_overlap_audit", osql.with_(osql.CORPUS) + """
SELECT text AS key, count(DISTINCT prio) AS n_sources FROM corpus GROUP BY text
HAVING count(DISTINCT prio) > 1""")
def q_d4(spark, sf):
    from tasklane.plans import fixtures as fx
    return dedup.overlap_audit(fx.corpus(spark, sf), "text", "prio")
