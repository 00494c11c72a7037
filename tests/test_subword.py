"""Longest-match encoding against a word-by-word version."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tasklane.functions import codepoints as CP
from tasklane.functions import subword
from tasklane.operators import encode as E
from tasklane.operators import vocab as V


def _cut(text):
    out, word = [], ""
    for ch in text or "":
        kind = unicodedata.category(ch)
        if ch in " \t\n\r" or kind[0] == "Z":
            out, word = out + [word], ""
        elif kind[0] == "C" or ch == "�":
            continue
        elif kind[0] == "P" or ch in "$+<=>^`|~" or any(
                a <= ord(ch) <= b for a, b in subword.CJK):
            out, word = out + [word, ch], ""
        else:
            word += ch
    return [w for w in [*out, word] if w]


def _encode(text, tokens, longest=100):
    ids = []
    for w in _cut(text):
        own, at = [], 0
        while at < len(w) and len(w) <= longest:
            for z in range(len(w), at, -1):
                t = ("##" if at else "") + w[at:z]
                if t in tokens:
                    own.append(tokens[t])
                    at = z
                    break
            else:
                break
        ids += own if own and at == len(w) else [V.UNK_ID]
    return ids


TOKENS = {t: i + 4 for i, t in enumerate(
    ["a", "b", "ab", "abc", "##c", "##cd", "##cde", "##a", "the", "##", "#",
     "19", "##9", "##99", "2", "漢", "字", "##漢", "。", ",", "é", "##é", "😀",
     "##😀", "un", "##aff", "##able", "##ab", "x" * 60])}
TEXTS = ["ab", "abcde abcd", "the1999", "1999 2 99", "漢字ab。é,éa", "unaffable",
         "a\x00b​c", " \t\n", "", None, "😀😀 a😀", "##", "#a", "ab　the",
         "[UNK] [CLS]", "a" * 101 + " a" + "a" * 99, "x" * 60, "ab,abc$漢a",
         "�ab", "a-b_c", " ab b", "AB Ab"]


def test_longest_match_is_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcde19 漢,é😀\x01#") for _ in range(
        rng.randrange(30))) for _ in range(400)]
    vocab = spark.createDataFrame(
        [*zip(V.SPECIALS, range(4)), *TOKENS.items(), ("ab", 999),
         (None, 5)], "token string, id int")
    df = spark.createDataFrame(
        [(i, t, texts[-1 - i]) for i, t in enumerate(texts)],
        "id int, text string, other string").repartition(3)
    one = E.encode_words(df, vocab, "text").collect()
    assert one[0].asDict().keys() == {
        "id", "text", "other", "input_ids", "token_type_ids", "length"}
    for r in one:
        want = [2, *_encode(texts[r.id], TOKENS), 3]
        assert r.input_ids == want, texts[r.id]
        assert r.length == len(want) and r.token_type_ids == [0] * len(want)
    for r in E.encode_words(df, vocab, "text", "other", keep=["id"],
                            lower=True, longest_word=20).collect():
        a, b = (_encode((t or "").lower(), TOKENS, 20) for t in (
            texts[r.id], texts[-1 - r.id]))
        assert r.input_ids == [2, *a, 3, *b, 3]
        assert r.token_type_ids == [0] * (len(a) + 2) + [1] * (len(b) + 1)


def test_without_tokens_all_words_are_unknown(spark):
    vocab = spark.createDataFrame([*zip(V.SPECIALS, range(4))],
                                  "token string, id int")
    df = spark.createDataFrame([("a b",), ("",)], "text string")
    got = E.encode_words(df, vocab, "text").orderBy("length").collect()
    assert [r.input_ids for r in got] == [[2, 3], [2, 1, 1, 3]]
    assert not E.encode_words(df.where("false"), vocab, "text").count()


def test_a_large_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_VOCAB_CHARS", 10)
    vocab = spark.createDataFrame([("a" * 11, 4)], "token string, id int")
    with pytest.raises(ValueError, match="11 characters"):
        E.encode_words(vocab, vocab, "token")


def test_a_batch_spells_each_word_once(monkeypatch):
    walked = []
    own = subword.Pieces._spell
    monkeypatch.setattr(subword.Pieces, "_spell", lambda self, cps, a, b: (
        walked.append(len(a)), own(self, cps, a, b))[1])
    pieces = subword.Pieces(TOKENS, 1)
    texts = TEXTS * 50
    ids, off = pieces(*CP.all_code_points(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == _encode(t, TOKENS)
    assert walked == [len({w for t in TEXTS for w in _cut(t)})]


def test_words_whose_hashes_clash_stay_apart(monkeypatch):
    monkeypatch.setattr(subword.np, "unique", lambda h, **_: (
        h[:1], np.zeros(1, int), np.zeros(len(h), int)))
    cps = np.array([97, 98, 97, 99], np.uint32)
    one, back = subword.distinct(cps, np.array([0, 2]), np.array([2, 4]))
    assert one.tolist() == back.tolist() == [0, 1]


def test_the_vocabulary_is_made_once(spark):
    df = spark.createDataFrame([("ab ab b",)], "text string")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    vocab = V.build_word_vocab(df, "text", 9).coalesce(1).mapInArrow(
        count, "token string, id int")
    E.encode_words(df, vocab, "text").collect()
    assert made.value == V.build_word_vocab(df, "text", 9).count()


def test_counted_words_are_the_regular_expressions(spark):
    """Unassigned code points included."""
    texts = TEXTS + ["a\u0378b", "x\ue000y\ufeffz", "\u0085 a\x1f", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = df.select(F.explode(F.regexp_extract_all(F.regexp_replace(
        "text", f"[{V.GONE}]", ""), F.lit(V.WORD), F.lit(0))).alias("w")
        ).groupBy("w").count()
    assert {r.word: r.n for r in V.word_counts(df, "text").collect()} == {
        r["w"]: r["count"] for r in want.collect()}


def test_all_rows_of_a_batch_walk_together():
    pieces = subword.Pieces(TOKENS, 1)
    long = "unaffable " * 20_000
    ids, off = pieces(*CP.all_code_points(pa.array([long, "a", None, "é"])))
    want = _encode("unaffable", TOKENS)
    assert off.tolist() == [0, 20_000 * len(want), 20_000 * len(want) + 1,
                            20_000 * len(want) + 1, 20_000 * len(want) + 2]
    assert (ids[:off[1]].reshape(-1, len(want)) == np.array(want)).all()


def test_word_vocabulary_cuts_as_the_encoder(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {r.word: r.n for r in V.word_counts(df, "text").collect()}
    want = {}
    for t in TEXTS:
        for w in _cut(t):
            want[w] = want.get(w, 0) + 1
    assert got == want
    vocab = V.build_word_vocab(df, "text", 10 ** 6)
    assert vocab.select(F.countDistinct("id"), F.min("id")).first()[:] == (
        vocab.count(), 0)
    back = E.encode_words(df, vocab, "text").collect()
    long = [r for r in back if 1 in r.input_ids]
    assert all(len(max(_cut(r.text), key=len)) > 100 for r in long)
