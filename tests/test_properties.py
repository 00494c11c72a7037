"""Properties from the test strategy: softmax, argmax ties, report range,
padding masks, and text operators against plain Python on random strings."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tasklane.functions import metrics as FM
from tasklane.functions import text as T
from tasklane.operators import encode as E
from tasklane.operators import metrics as M
from tasklane.plans import fixtures as fx


def test_softmax_sums_to_one_and_argmax_first_max(spark):
    rows = [([1.0, 3.0, 3.0],), ([-1000.0, 1000.0],), ([0.0],), ([2.0, 2.0, 1.0],)]
    df = spark.createDataFrame(rows, "l array<double>")
    out = df.select(FM.softmax("l").alias("p"), FM.log_softmax("l").alias("lp"),
                    FM.argmax("l").alias("a")).collect()
    for r in out:
        assert abs(sum(r.p) - 1.0) < 1e-12
        assert np.allclose(np.exp(r.lp), r.p)
    assert [r.a for r in out] == [1, 1, 0, 0]


def test_report_in_unit_range_and_prediction_only_class(spark):
    s = fx.scored(spark, SF_SMALL)
    f1 = [r.f1 for r in M.macro_f1(s).collect()]
    assert f1 and all(0.0 <= v <= 1.0 for v in f1)
    # class 2 appears only as a prediction: it counts with F1 0 (report)
    one = spark.createDataFrame(
        [(0, 1, 0, [2.0, 0.0, 1.0], 0), (1, 1, 1, [0.0, 0.0, 5.0], 0)],
        "id long, task_id int, target int, logits array<double>, batch_id long")
    got = M.macro_f1(one).collect()[0].f1
    assert abs(got - (1.0 + 0.0 + 0.0) / 3) < 1e-12


def test_padding_mask_sums_to_length_and_batches_share_length(spark):
    rows = [(i, i // 3, list(range(1 + i % 5)), [0] * (1 + i % 5), 1 + i % 5)
            for i in range(12)]
    df = spark.createDataFrame(rows, "pos long, batch_id long, input_ids array<int>, "
                                     "token_type_ids array<int>, length int")
    out = E.collate(df).collect()
    by_batch = {}
    for r in out:
        assert sum(r.attention_mask) == r.length
        assert len(r.input_ids) == len(r.attention_mask) == len(r.token_type_ids)
        by_batch.setdefault(r.batch_id, set()).add(len(r.input_ids))
    assert all(len(v) == 1 for v in by_batch.values())
    fixed = E.pad(df, 8).collect()
    assert all(len(r.input_ids) == 8 and sum(r.attention_mask) == r.length for r in fixed)


def _random_strings(n, seed=7):
    rnd = random.Random(seed)
    alphabet = list("aaAbZ哈哈[怒]泪 \n😀x") + ["[怒]"] * 3
    out = []
    for _ in range(n):
        k = rnd.randint(0, 60)
        s = "".join(rnd.choice(alphabet) for _ in range(k))
        if rnd.random() < 0.3:
            s += rnd.choice("哈a ") * rnd.randint(5, 12)
        if rnd.random() < 0.3:
            s += "[怒]" * rnd.randint(25, 40)
        out.append(s)
    return out


def test_text_operators_match_python_on_random_strings(spark):
    strs = _random_strings(300)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strs)], "i int, s string")
    got = {r.i: r for r in df.select(
        "i", T.squeeze_runs("s").alias("runs"),
        T.squeeze_emotes("s", keep=30).alias("emo"),
        T.strip_latin("s").alias("lat"),
        T.squeeze_runs(T.squeeze_runs("s")).alias("runs2"),
        T.squeeze_emotes(T.squeeze_emotes("s", keep=30), keep=30).alias("emo2"),
    ).collect()}
    for i, s in enumerate(strs):
        runs = re.sub(r"(.)\1{6,}", lambda m: m.group(1) * 6, s)
        emo = re.sub(r"((\[[一-龥]+\])\2{29})\2+", r"\1", s)
        assert got[i].runs == runs
        assert got[i].emo == emo
        assert got[i].lat == re.sub(r"[A-Za-z]+", "", s)
        assert got[i].runs2 == got[i].runs      # idempotent
        assert got[i].emo2 == got[i].emo        # cap mode is idempotent


def test_best_checkpoint_first_best_wins_and_nulls(spark):
    log = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 3, 0.9), ("a", 2, 0.9), ("a", 4, 0.1),
         ("b", 6, None), ("b", 5, None), ("c", 1, None), ("c", 2, 0.3)],
        "run_id string, step long, score double")
    got = {r.run_id: (r.best_step, r.best_score) for r in M.best_checkpoint(log).collect()}
    assert got == {"a": (2, 0.9), "b": (5, None), "c": (2, 0.3)}
