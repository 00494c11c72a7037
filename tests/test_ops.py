"""Goldens and properties for labels, splits, dedup, encoding, metrics,
losses, parameters, pooling, heads and streaming."""

import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tasklane.operators import (dedup, encode as E, heads as H, labels as L,
                                losses as LS, metrics as M, params as A,
                                pooling as P, splits as K)
from tasklane.functions import text as T
from tasklane.plans import fixtures as fx
from tasklane.plans import jobs
from tasklane.sources import io


def test_labels_roundtrip(spark):
    df = spark.createDataFrame([("like",), ("anger",), (None,), ("xx",)], "l string")
    out = df.select(L.encode_label("l", L.EMOTION_LABELS).alias("i")).collect()
    assert [r.i for r in out] == [3, 4, None, None]
    d = spark.createDataFrame([(3,), (4,)], "i int").select(
        L.decode_label("i", L.EMOTION_LABELS).alias("s")).collect()
    assert [r.s for r in d] == ["like", "anger"]
    with pytest.raises(Exception):
        spark.createDataFrame([(99,)], "i int").select(
            L.decode_label("i", L.EMOTION_LABELS)).collect()


def test_drop_unlabelled_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("-",), (None,)], "label string")
    assert L.drop_unlabelled(df).count() == 2


def test_strict_int_fails_and_try_int_quarantines(spark):
    df = spark.createDataFrame([("12",), ("x",)], "v string")
    with pytest.raises(Exception):
        df.select(L.strict_int("v")).collect()
    assert [r[0] for r in df.select(L.try_int("v")).collect()] == [12, None]


def test_folds_balanced_and_partition(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_returnflag")
    f = K.stratified_folds(li, "id", "l_returnflag", k=5)
    assert f.count() == li.count()
    per = f.groupBy("l_returnflag", "fold").count().groupBy("l_returnflag").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in per)


def test_oversample_equal_counts(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_type", "event_id")
    o = K.oversample(ev, "event_type", "event_id")
    counts = {r[0]: r[1] for r in o.groupBy("event_type").count().collect()}
    assert len(set(counts.values())) == 1
    assert max(counts.values()) == ev.groupBy("event_type").count().agg(
        F.max("count")).collect()[0][0]


def test_priority_dedup_properties(spark):
    c = fx.corpus(spark, SF_SMALL)
    best = dedup.priority_dedup(c, "text", "prio", "pos", key_name="text")
    assert best.count() == c.select("text").distinct().count()
    audit = dedup.overlap_audit(best.withColumnRenamed("prio", "src"), "text")
    assert audit.count() == 0
    # invariant to input partitioning
    again = dedup.priority_dedup(c.repartition(7), "text", "prio", "pos", key_name="text")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, again.collect()))


def test_priority_dedup_packed_matches_struct(spark):
    df = spark.createDataFrame(
        [("a", 2, 5), ("a", 1, 9), ("a", 1, 7), ("b", 3, 0), (None, 2, 1), (None, 0, 4)],
        "k string, prio int, pos long")
    packed = sorted(map(tuple, dedup.priority_dedup(df, "k").collect()), key=str)
    with_payload = dedup.priority_dedup(df.withColumn("x", F.lit(1)), "k",
                                        payload=["x"]).drop("x")
    assert packed == sorted(map(tuple, with_payload.collect()), key=str)
    assert ("a", 1, 7) in packed and (None, 0, 4) in packed
    edge = [("a", p, q) for p in (-2 ** 31, 0, 2 ** 31 - 1)
            for q in (-2 ** 63, -1, 2 ** 41, 2 ** 63 - 1)]
    for i in range(len(edge)):
        df = spark.createDataFrame(edge[i:], "k string, prio int, pos long")
        assert [tuple(r) for r in dedup.priority_dedup(df, "k").collect()] == [edge[i]]


def test_subtract_earlier(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c")],
                               "prio int, k string")
    out = sorted(map(tuple, dedup.subtract_earlier(df, "k").collect()))
    assert out == [(0, "a"), (1, "b"), (1, "b"), (2, "c")]


def test_pad_golden(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 0, 0], 3)],
                               "input_ids array<int>, token_type_ids array<int>, length int")
    r = E.pad(df, 5).collect()[0]
    assert r.input_ids == [1, 2, 3, 0, 0]
    assert r.attention_mask == [1, 1, 1, 0, 0]
    assert r.token_type_ids == [0, 0, 0, 0, 0]


def test_encode_pair_types(spark):
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3),
                                   ("a", 4), ("b", 5)], "token string, id int")
    df = spark.createDataFrame([("ab", "bz")], "s1 string, s2 string")
    r = E.encode(df, vocab, "s1", "s2").collect()[0]
    assert r.input_ids == [2, 4, 5, 3, 5, 1, 3]
    assert r.token_type_ids == [0, 0, 0, 0, 1, 1, 1]
    assert r.length == 7


def _expr_encode(df, vocab, a, b):
    """E2 as expressions, written apart from the operator."""
    m = F.create_map(*[F.lit(x) for r in vocab.collect() for x in (r[0], r[1])])

    def ids(c):
        chars = F.split(F.replace(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(" "),
                                  F.lit("")), "")
        return F.transform(F.filter(chars, lambda x: x != ""),
                           lambda x: F.coalesce(F.try_element_at(m, x), F.lit(1)))
    cls, sep = F.array(F.lit(2)), F.array(F.lit(3))
    first = F.concat(cls, ids(a), sep)
    rest = F.concat(ids(b), sep) if b else F.array().cast("array<int>")
    return (df.withColumn("input_ids", F.concat(first, rest))
            .withColumn("token_type_ids", F.concat(F.transform(first, lambda _: F.lit(0)),
                                                   F.transform(rest, lambda _: F.lit(1))))
            .withColumn("length", F.size("input_ids")))


def test_encode_arrow_matches_expr(spark):
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3),
                                   ("a", 4), ("中", 5), ("😀", 6), ("\t", 7)],
                                  "token string, id int")
    rows = [(0, " a 中😀b ", "😭a"), (1, "", None), (2, None, " "),
            (3, "a\ta  中", "中中"), (4, "😀" * 3, "")]
    df = spark.createDataFrame(rows, "k int, s1 string, s2 string").repartition(3)
    for pair in (None, "s2"):
        arrow = sorted(E.encode(df, vocab, "s1", pair).collect())
        expr = sorted(_expr_encode(df, vocab, "s1", pair).collect())
        assert arrow == expr
    r = {x.k: x for x in E.encode(df, vocab, "s1", "s2").collect()}
    assert r[0].input_ids == [2, 4, 5, 6, 1, 3, 1, 4, 3]
    assert r[2].input_ids == [2, 3, 3] and r[2].token_type_ids == [0, 0, 1]


def test_char_counts_kernel_matches_explode(spark):
    from tasklane.operators import vocab as V
    df = spark.createDataFrame([(" a 中😀b ",), ("",), (None,), ("a\ta😀😀",)],
                               "t string").repartition(2)
    assert sorted(V.char_counts(df, "t").collect()) == sorted(
        V.char_counts_exploded(df, "t").collect())


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id long, task_id int, target int, "
                                 "logits array<double>, batch_id long")


def test_macro_f1_vs_kpi(spark):
    # 3 classes, class 2 absent from target and prediction
    rows = [(0, 1, 0, [2.0, 1.0, 0.0], 0), (1, 1, 1, [0.0, 2.0, 0.0], 0),
            (2, 1, 1, [2.0, 1.0, 0.0], 0)]
    s = _scored(spark, rows)
    rep = M.macro_f1(s).collect()[0].f1
    kpi = M.hard_f1(s).collect()[0].kpi
    f0, f1 = 2 * 1 / (2 + 1 + 0), 2 * 1 / (2 + 0 + 1)
    assert rep == pytest.approx((f0 + f1) / 2)
    assert kpi == pytest.approx((2 / (3 + 1e-7) + 2 / (3 + 1e-7) + 0) / 3)


def test_weighted_loss_absent_task(spark):
    losses = spark.createDataFrame([(0, 0.5), (2, 1.5)], "task_id int, loss double")
    r = LS.weighted_loss(losses, (), {0: 1.0, 1: 2.0, 2: 1.0}).collect()[0].loss
    assert r == pytest.approx((0.5 + 1.5) / 2)
    none = spark.createDataFrame([(0, float("nan"))], "task_id int, loss double")
    assert LS.weighted_loss(none).collect()[0].loss is None


def test_running_kpi_golden(spark):
    # r0 = 0.5, a = 0.05, KPI 0.2 then 0.4 -> 0.48075
    from tasklane.plans.scan import affine_scan
    df = spark.createDataFrame([(0, 0, 0.95, 0.05 * 0.2), (0, 1, 0.95, 0.05 * 0.4)],
                               "g int, k long, a double, b double")
    out = affine_scan(df, ["g"], "k", "a", "b", 0.5, width=1, levels=3)
    r = {row.k: row.r for row in out.collect()}
    assert r[1] == pytest.approx(0.48075)


def test_affine_scan_matches_loop(spark):
    rng = np.random.default_rng(1)
    n = 300
    kp = rng.random(n)
    df = spark.createDataFrame([(0, i, 0.9, 0.1 * float(kp[i])) for i in range(n)],
                               "g int, k long, a double, b double")
    from tasklane.plans.scan import affine_scan
    out = {r.k: r.r for r in affine_scan(df, ["g"], "k", "a", "b", 0.5,
                                         width=7, levels=3).collect()}
    r = 0.5
    for i in range(n):
        r = 0.9 * r + 0.1 * kp[i]
        assert out[i] == pytest.approx(r, rel=1e-12)


def test_average_params_golden(spark):
    rows = [(0, 0, "shared.w", [1.0, 2.0]), (1, 1, "shared.w", [3.0, 4.0]),
            (2, 2, "shared.w", [5.0, 6.0]), (0, 0, "head.0", [7.0]),
            (0, 0, "emb.position_ids", [0.0]), (2, 2, "emb.position_ids", [9.0])]
    p = spark.createDataFrame(rows, "model_id int, ord int, name string, vals array<double>")
    out = {r.name: (r.vals, r.n_models) for r in A.average_params(p).collect()}
    assert out["shared.w"] == ([3.0, 4.0], 3)
    assert out["head.0"] == ([7.0], 1)
    assert out["emb.position_ids"] == ([9.0], 1)
    same = spark.createDataFrame([(0, 0, "x", [1.5]), (1, 1, "x", [1.5])],
                                 "model_id int, ord int, name string, vals array<double>")
    assert A.average_params(same).collect()[0].vals == [1.5]


def test_attention_pool_vs_numpy(spark):
    tok = fx.tokens(spark, SF_SMALL)
    task_of = tok.select("id").distinct().withColumn("task_id", (F.col("id") % 3).cast("int"))
    rng = np.random.default_rng(0)
    d = 64
    w = {"task_embedding": rng.normal(size=(3, d)), "wq": rng.normal(size=(d, d)) / 8,
         "wk": rng.normal(size=(d, d)) / 8, "wv": rng.normal(size=(d, d)) / 8}
    got = {r.id: np.array(r.feature) for r in
           P.attention_pool(tok, task_of, w, n_heads=2).collect()}
    rows = tok.collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.id, []).append(r)
    for sid, toks in seqs.items():
        toks.sort(key=lambda r: r.pos)
        x = np.array([t.vec for t in toks])
        m = np.array([t.mask for t in toks])
        q = w["task_embedding"][sid % 3] @ w["wq"]
        k, v = x @ w["wk"], x @ w["wv"]
        heads = []
        for h in range(2):
            sl = slice(h * 32, (h + 1) * 32)
            s = k[m][:, sl] @ q[sl] / math.sqrt(32)
            p = np.exp(s - s.max())
            p /= p.sum()
            heads.append(p @ v[m][:, sl])
        assert np.allclose(got[sid], np.concatenate(heads), atol=1e-9)


def test_numpy_heads_vs_numpy(spark):
    rng = np.random.default_rng(2)
    d = 8
    feats = spark.createDataFrame(
        [(i, i % 3, [float(v) for v in rng.normal(size=d)]) for i in range(30)],
        "id long, task_id int, feature array<double>")
    towers = {t: [(rng.normal(size=(d, c)), rng.normal(size=c))] for t, c in enumerate([3, 7, 10])}
    ex = [[(rng.normal(size=(d, d)), rng.normal(size=d)) for _ in range(2)] for _ in range(2)]

    def expert(layers, x):
        (w1, b1), (w2, b2) = layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2
    gates = {t: (rng.normal(size=(d, 2)), rng.normal(size=2)) for t in range(3)}
    model = {"towers": towers, "expert": ex[0], "experts": ex, "gate": gates[0], "gates": gates}
    X = {r.id: (np.array(r.feature), r.task_id) for r in feats.collect()}
    for arch in ("expert", "moe", "mmoe"):
        got = {r.id: np.array(r.logits) for r in H.score(feats, arch, model=model).collect()}
        for i, (x, t) in X.items():
            if arch == "expert":
                h = expert(ex[0], x)
            else:
                gw, gb = gates[0] if arch == "moe" else gates[t]
                g = np.exp(x @ gw + gb)
                g /= g.sum()
                h = sum(g[j] * expert(ex[j], x) for j in range(2))
            want = h @ towers[t][0][0] + towers[t][0][1]
            assert np.allclose(got[i], want), arch


def test_streaming_equals_batch(spark):
    from tasklane.streaming.kpi import run_to_table
    s = fx.scored(spark, SF_SMALL)
    st = {(r.batch_id, r.task_id): r.r for r in run_to_table(spark, s, n_files=2).collect()}
    bt = {(r.batch_id, r.task_id): r.r for r in LS.running_kpi(s).collect()}
    assert st.keys() == bt.keys()
    assert all(st[k] == pytest.approx(bt[k], abs=1e-12) for k in bt)


def test_streaming_holds_open_batches_and_counts_late_rows(spark, tmp_out):
    from tasklane.streaming import kpi
    s = fx.scored(spark, SF_SMALL).where("batch_id < 3").withColumn("batch_rows", F.lit(32))
    base = f"{tmp_out}/st1"
    step = kpi._Step(base, 0.05, 1.0, 1.0, 0.5)
    half = F.pmod(F.col("id"), F.lit(2)) == 0
    step(s.where((F.col("batch_id") == 0) & half), 0)
    assert kpi.read_output(spark, base).count() == 0
    step(s.where(((F.col("batch_id") == 0) & ~half) | ((F.col("batch_id") == 2) & half)), 1)
    assert {r.batch_id for r in kpi.read_output(spark, base).collect()} == {0}
    last = s.where((F.col("batch_id") == 2) & ~half)
    step(last, 2)
    step(last, 2)          # the same trigger again changes nothing
    assert {r.batch_id for r in kpi.read_output(spark, base).collect()} == {0, 2}
    step(s.where("batch_id = 1"), 3)
    assert {r.batch_id for r in kpi.read_output(spark, base).collect()} == {0, 2}
    assert [tuple(r) for r in kpi.read_late(spark, base).collect()] == [(1, 32)]


def test_io_roundtrips_and_jobs(spark, tmp_out):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    pairs = conv.alias("a").join(conv.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id"))
                                 & (F.col("b.turn") == F.col("a.turn") + 1)).select(
        F.col("a.text").alias("sentence1"), F.col("b.text").alias("sentence2"),
        F.when(F.col("a.turn") % 4 == 0, F.lit("-")).otherwise(F.col("b.role")).alias("label"))
    tr, dv = f"{tmp_out}/train.json", f"{tmp_out}/dev.json"
    pairs.coalesce(1).write.json(tr)
    pairs.limit(5).coalesce(1).write.json(dv)
    outs = jobs.pair_task_preparation(spark, tr, dv, f"{tmp_out}/j1")
    n_keep = pairs.where(F.col("label") != "-").count()
    back = io.read_csv(spark, f"{tmp_out}/j1/trainval.csv", io.PAIR_TSV)
    assert back.count() == outs["trainval"].count()
    ids = sorted(r.id for r in back.collect())
    assert ids == list(range(len(ids)))
    assert io.read_csv(spark, f"{tmp_out}/j1/train.csv",
                       "id long, sentence1 string, sentence2 string, label string").count() == n_keep
    # J6 + W3 round trip
    from tasklane.plans.registry_model import features_table, heads_table
    pred = jobs.predict_and_export(features_table(spark, SF_SMALL), heads_table(spark, SF_SMALL),
                                   f"{tmp_out}/pred")
    tasks = sorted(os.listdir(f"{tmp_out}/pred"))
    assert [t for t in tasks if t.startswith("task=")] == ["task=ocemotion", "task=ocnli", "task=tnews"]
    files = [f for f in os.listdir(f"{tmp_out}/pred/task=ocnli") if f.endswith(".json")]
    rec = json.loads(open(f"{tmp_out}/pred/task=ocnli/{files[0]}").readline())
    assert set(rec) == {"id", "label"} and isinstance(rec["id"], str)
    assert pred.count() == 50 * 0 + spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    # J4
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.translate("lang", "e", "ｅ").alias("sentence"))
    io.write_tsv(docs, f"{tmp_out}/test_in")
    out = jobs.test_conversion(spark, f"{tmp_out}/test_in", f"{tmp_out}/test_out")
    assert out.where(F.col("sentence").contains("ｅ")).count() == 0


def _write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-00000.txt", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_headline_preparation_job_brute_force(spark, tmp_out):
    """J2 on hand-made sources: priority test < dev < train < extra, dedup
    on the cleaned (tab-free, width-folded) sentence, ids per source."""
    _write_lines(f"{tmp_out}/test", ["0\t同一句\t101", "1\tＡＢＣ\t102"])
    _write_lines(f"{tmp_out}/dev", [json.dumps({"sentence": "ABC", "label": "103"}),
                                    json.dumps({"sentence": "新句\t子", "label": "104"})])
    _write_lines(f"{tmp_out}/train", [json.dumps({"sentence": "新句子", "label": "105"}),
                                      json.dumps({"sentence": "训练", "label": "106"}),
                                      json.dumps({"sentence": "训练", "label": "107"}),
                                      json.dumps({"sentence": "第二", "label": "111"})])
    _write_lines(f"{tmp_out}/extra", ["9_!_108_!_x_!_训练_!_kw", "10_!_109_!_x_!_额外_!_",
                                      "11_!_110_!_x_!_ＡＢＣ_!_", "12_!_112_!_x_!_同一句_!_"])
    outs = jobs.headline_preparation(spark, f"{tmp_out}/test", f"{tmp_out}/dev",
                                     f"{tmp_out}/train", f"{tmp_out}/extra",
                                     f"{tmp_out}/out")
    got = {k: sorted(map(tuple, v.collect())) for k, v in outs.items()}
    assert got["dev"] == [(0, "新句子", 104)]
    assert got["train"] == [(0, "训练", 106), (1, "第二", 111)]
    assert got["extra"] == [(0, "额外", 109)]
    assert got["trainval"] == [(0, "训练", 106), (1, "第二", 111), (2, "新句子", 104)]
    back = io.read_csv(spark, f"{tmp_out}/out/train.csv", "id long, sentence string, label int")
    assert sorted(map(tuple, back.collect())) == got["train"]


def test_headline_preparation_moves_texts_twice(spark, tmp_out):
    """J2 sends every text through one shuffle to find its copies; the kept
    ones through one more, into order. Numbering moves none."""
    for name, line in (("test", "{0}\t句{0}\t1"), ("extra", "{0}_!_1_!_x_!_句{0}_!_"),
                       ("dev", '{{"sentence": "句{0}", "label": "1"}}'),
                       ("train", '{{"sentence": "句{0}b", "label": "2"}}')):
        for part in range(3):
            _write_lines(f"{tmp_out}/{name}/{part}", [
                line.format(part * 100 + i) for i in range(50 + part)])
    outs = jobs.headline_preparation(
        spark, *[f"{tmp_out}/{n}/*" for n in ("test", "dev", "train", "extra")],
        f"{tmp_out}/out")
    assert [outs[n].count() for n in ("dev", "train", "extra", "trainval")] == [
        0, 153, 0, 153]
    got = outs["trainval"].orderBy("id").collect()
    assert [(r.id, r.sentence) for r in got] == [(i, f"句{x}b") for i, x in enumerate(
        p * 100 + j for p in range(3) for j in range(50 + p))]
    for out in outs.values():
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in re.findall(r"Exchange.*", plan) if "sentence" in x]
        assert not re.search(r"Exchange hashpartitioning\([^)]*_tl_", plan)
    lines = io.number_scanned(io.with_position(spark.read.text(f"{tmp_out}/extra/*")))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.id for r in lines.collect()) == list(range(153))


def test_emotion_cleaning_job_brute_force(spark, tmp_out):
    """J3 against plain Python re on sample texts plus constructed runs,
    emotes, Latin letters and emoji."""
    import re
    from collections import Counter
    docs = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .orderBy("doc_id").select("text").collect()]
    extras = ["哈" * 9 + "abc", "[怒]" * 35 + " x", "[笑哭]" * 31, "好😀😭Z ", "  ",
              " " * 8]
    sents = [re.sub(r"[\t\n\r]", " ", t) for t in docs[:30]] + extras
    _write_lines(f"{tmp_out}/train", [f"{i}\t{s}\t1" for i, s in enumerate(sents)])
    vocab = spark.createDataFrame([(c,) for c in "哈好[]怒😀"], "token string")
    lex = {"😭": ":大声哭喊的脸:", "😀": ":嘿嘿:"}
    out = jobs.emotion_cleaning(spark, f"{tmp_out}/train", vocab, lex, f"{tmp_out}/out")

    def py_clean(s):
        s = re.sub(r"(.)\1{6,}", lambda m: m.group(1) * 6, s)
        s = re.sub(r"((\[[一-龥]+\])\2{29})\2+", r"\1", s)
        s = re.sub(r"[A-Za-z]+", "", s)
        return s.replace("😭", lex["😭"])      # the vocabulary knows the other

    got = {r.id: r.sentence for r in out["clean"].collect()}
    assert got == {i: py_clean(s) for i, s in enumerate(sents)}
    want = Counter(c for s in sents for c in s.strip(" ").replace(" ", ""))
    for c in "哈好[]怒😀":
        want.pop(c, None)
    assert {r.ch: r.n for r in out["oov"].collect()} == dict(want)


def test_jsonl_corrupt_lines_and_sink_whitespace(spark, tmp_out):
    _write_lines(f"{tmp_out}/in", [json.dumps({"sentence1": " a ", "sentence2": "b\t",
                                               "label": "1"}), "{not json"])
    df = io.read_jsonl(spark, f"{tmp_out}/in", keep_corrupt=True).cache()
    rows = sorted(df.collect(), key=lambda r: r._corrupt_record or "")
    assert rows[0].sentence1 == " a " and rows[0]._corrupt_record is None
    assert rows[1]._corrupt_record == "{not json" and rows[1].sentence1 is None
    good = df.where(F.col("_corrupt_record").isNull()).select(
        F.lit(7).cast("long").alias("id"), "sentence1", "sentence2", "label")
    io.write_tsv(good, f"{tmp_out}/tsv")
    back = io.read_tsv(spark, f"{tmp_out}/tsv", io.PAIR_TSV, quoted=True).collect()
    assert [tuple(r) for r in back] == [(7, " a ", "b\t", "1")]
    io.write_csv(good, f"{tmp_out}/csv")
    back = io.read_csv(spark, f"{tmp_out}/csv", io.PAIR_TSV).collect()
    assert [tuple(r) for r in back] == [(7, " a ", "b\t", "1")]


def test_spread_keeps_rows_and_only_fans_out_small_inputs(spark):
    from tasklane.plans.parallel import spread
    from tasklane.sources.tables import read_table
    d = read_table(spark, SF_SMALL, "documents")
    s = read_table(spark, SF_SMALL, "documents", spread=True)
    target = spark.sparkContext.defaultParallelism
    assert s.rdd.getNumPartitions() >= min(target, max(d.rdd.getNumPartitions(), target))
    assert sorted(map(tuple, s.select("doc_id", "text").collect())) == sorted(
        map(tuple, d.select("doc_id", "text").collect()))
    # pruning and filters still reach the scan under the exchange
    plan = s.where(F.col("doc_id") > 5).select("doc_id")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "GreaterThan(doc_id,5)" in plan and "text" not in plan
    wide = spark.range(0, 100, numPartitions=target * 2)
    assert spread(wide) is wide


def test_counting_and_encoding_take_memory_for_a_slice_only(spark):
    import tracemalloc

    import pyarrow as pa
    from tasklane.functions import codepoints as CP
    from tasklane.operators import vocab as V
    text = pa.array(["a text of some words, " * 20] * 40_000)    # 17 MB
    whole = pa.RecordBatch.from_arrays([text, text], names=["_s", "t"])
    tracemalloc.start()
    counts = [*V._count_partition([whole.select(["_s"])])]
    for b in CP.slices(whole, ["_s", "t"]):
        CP.frame([CP.code_points(b.column(c)) for c in ("_s", "t")], 2, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(counts[0]["n"].to_pylist()) == 17 * 20 * 40_000
    assert peak < 32e6


def test_codepoint_slices_bound_text_bytes():
    import pyarrow as pa
    from tasklane.functions import codepoints as CP
    b = pa.RecordBatch.from_pydict({"s": ["ab", "中文字", None, "x" * 10, "y"],
                                    "k": [1, 2, 3, 4, 5]})
    parts = list(CP.slices(b, ["s"], limit=6))
    assert sum(p.num_rows for p in parts) == 5
    assert [k for p in parts for k in p.column("k").to_pylist()] == [1, 2, 3, 4, 5]
    for p in parts:
        nbytes = sum(len(x.encode()) for x in p.column("s").to_pylist() if x)
        assert p.num_rows == 1 or nbytes <= 6
    assert list(CP.slices(b, ["s"], limit=1000)) == [b]


def test_any_vocabulary_and_lexicon_size(spark):
    big = spark.createDataFrame([(chr(0x4E00 + i), i) for i in range(20000)]
                                + [(chr(0x20000 + i), 50000 + i) for i in range(10000)]
                                + [("ab", 9), ("x", 5), ("x", 7)], "token string, id int")
    df = spark.createDataFrame([(1, chr(0x4E00 + 19999) + "x" + chr(0x20000 + 9999) + "y")],
                               "k int, s string")
    got = E.encode(df, big, "s").first()
    assert got.input_ids == [2, 19999, 5, 59999, 1, 3]
    assert E.with_length(df, "s").first().length == got.length == 6
    lex = {chr(0x4E00 + i): f"<{i}>" for i in range(4000)} | {"<": "(", "no": "!"}
    t = chr(0x4E00) + "<" + chr(0x4E00 + 3999) + "no"
    one = spark.createDataFrame([(t,), (None,), ("",)], "s string")
    assert [r[0] for r in one.select(T.replace_chars("s", lex)).collect()] == [
        "<0>(<3999>no", None, ""]


def test_ranks_of_sparse_positions(spark):
    from tasklane.plans.rank import position_buckets, two_level_rank
    ids = [i * 10 ** 6 for i in range(3000)] + [2 ** 62, 2 ** 62 + 1, -5, -2 ** 63]
    df = spark.createDataFrame([(i, i % 2) for i in ids], "id long, g long").repartition(7)
    got = {r.id: r["rank"] for r in two_level_rank(
        df, ["id"], position_buckets("id")).collect()}
    assert got == {v: k for k, v in enumerate(sorted(ids))}
    for g in (0, 1):
        own = sorted(i for i in ids if i % 2 == g)
        got = {r.id: r["rank"] for r in two_level_rank(
            df, ["id"], position_buckets("id"), groups=["g"]).where(F.col("g") == g).collect()}
        assert got == {v: k for k, v in enumerate(own)}


def test_errors_instead_of_lost_rows(spark):
    f = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 5, [1.0, 2.0])],
                              "id long, task_id int, feature array<double>")
    h = spark.createDataFrame([(0, 0, [1.0, 1.0], 0.5), (0, 1, [0.0, 1.0], 0.0)],
                              "task_id int, cls int, w array<double>, b double")
    assert H.linear_head(f.where("id = 1"), h).first().logits == [3.5, 2.0]
    assert H.single_linear_head(f, h).count() == 2
    with pytest.raises(Exception, match="no head for task 5"):
        H.linear_head(f, h).collect()
    with pytest.raises(Exception, match="sizes differ"):
        H.linear_head(f.where("id = 1").withColumn("feature", F.array(F.lit(1.0))), h).collect()
    old = H.BROADCAST_VALUES
    try:
        H.BROADCAST_VALUES = 0
        assert H.linear_head(f.where("id = 1"), h).first().logits == [3.5, 2.0]
        with pytest.raises(Exception, match="no head for task 5"):
            H.linear_head(f, h).collect()
    finally:
        H.BROADCAST_VALUES = old
    p = spark.createDataFrame([(0, 0, "a", [1.0, 2.0, 3.0]), (1, 1, "a", [1.0, 2.0])],
                              "model_id int, ord int, name string, vals array<double>")
    with pytest.raises(Exception, match="sizes differ between models: a"):
        A.average_params(p).collect()


def test_sample_loss_options_reach_dtp_and_evaluation(spark):
    s = fx.scored(spark, SF_SMALL)
    a, b = (LS.multi_task_loss(s, "focal", "dtp", gamma=g).agg(F.sum("loss")).first()[0]
            for g in (1.0, 3.0))
    assert abs(a - b) > 1e-6
    val = LS.multi_task_loss(s, "f1", "uni", "val").first()
    ev = M.evaluate(s, sample="f1").first()
    assert ev.val_loss == pytest.approx(val.val_loss)
    assert ev.f1_tnews == pytest.approx(M.report(s).first().f1_tnews)


def test_separator_is_plain_text(spark):
    lines = spark.createDataFrame([(0, "1|100|x|title|y")], "line_no long, value string")
    assert io.parse_delimited_lines(lines, sep="|").first().sentence == "title"


def test_pooling_by_name(spark):
    tok = fx.tokens(spark, SF_SMALL)
    for name, fn in (("max", P.max_pool), ("mean", P.mean_pool), ("first", P.first_token),
                     ("last", P.last_token)):
        assert sorted(P.pool(name, tok).collect()) == sorted(fn(tok).collect())
    lay = fx.layers(spark, SF_SMALL)
    assert P.pool("inter", layers=lay, layer=2).count() == P.layer_select(lay, 2).count()
    task_of = lay.select("id", (F.col("id") % 2).cast("int").alias("task_id")).distinct()
    scores = spark.createDataFrame([(t, i, float(t + i)) for t in range(2) for i in range(4)],
                                   "task_id int, layer int, score double")
    mixed = {r.id: r.feature for r in P.pool("mol", layers=lay, task_of=task_of,
                                             scores=scores).collect()}
    old = P.MIXTURE_BROADCAST_ROWS
    try:
        P.MIXTURE_BROADCAST_ROWS = 0
        salted = {r.id: r.feature for r in P.pool("mol", layers=lay, task_of=task_of,
                                                  scores=scores).collect()}
    finally:
        P.MIXTURE_BROADCAST_ROWS = old
    assert mixed.keys() == salted.keys()
    assert all(np.allclose(mixed[k], salted[k]) for k in mixed)
    with pytest.raises(ValueError, match="unknown pooling"):
        P.pool("sum", tok)


def test_evaluate_and_predict_from_a_split(spark, tmp_out):
    rows = spark.createDataFrame([(i, f'say "{i}"\n', ["106", "116"][i % 2]) for i in range(6)],
                                 "id long, sentence string, label string")
    io.write_tsv(rows, f"{tmp_out}/tv.tsv")
    split = io.load_split(spark, {"tnews_trainval_path": f"{tmp_out}/tv.tsv"}, "tnews",
                          "trainval")
    feats = spark.createDataFrame([(i, 2, [float(i % 2), 1.0]) for i in range(6)],
                                  "id long, task_id int, feature array<double>")
    n = len(L.HEADLINE_LABELS)
    a, b = L.HEADLINE_LABELS[106], L.HEADLINE_LABELS[116]
    heads = spark.createDataFrame([(2, c, [4.0 * (c == b) - 4.0 * (c == a), 2.0 * (c == a)], 0.0)
                                   for c in range(n)],
                                  "task_id int, cls int, w array<double>, b double")
    both = jobs.labelled_features(split, feats)
    assert jobs.evaluate_model(both, heads, sample="focal").first().f1_tnews == 1.0
    got = {r.id: (r.task, r.label) for r in jobs.predictions(both, heads).collect()}
    assert got == {str(i): ("tnews", ["106", "116"][i % 2]) for i in range(6)}
    with pytest.raises(Exception, match="no feature for id"):
        jobs.labelled_features(split, feats.where("id < 5")).collect()
