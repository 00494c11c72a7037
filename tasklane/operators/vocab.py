"""Character vocabularies (T6-T8 over tables, E1).

Counting pre-aggregates per task on Arrow batches (one row per distinct
character leaves a task), then sums per character; membership is an
anti/equi join whose build side AQE broadcasts only when its measured size
is small. Replacement (T8) is a narrow pass; only a lexicon beyond
``LEXICON_BYTES`` is joined by character.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklane.functions.codepoints import (CountAccumulator,
                                           all_code_points, code_points,
                                           slices)
from tasklane.functions.subword import ASCII_SYMBOLS, CJK, counted_words
from tasklane.functions.text import char_array, replace_chars

# Special tokens first, in this order, ids 0..3.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3


def _count_partition(batches):
    """Map-side pre-aggregation: one (ch, n) row per distinct character of
    the task's input (bounded by the character set, not by the data)."""
    acc = CountAccumulator()
    for whole in batches:
        for b in slices(whole, ["_s"]):
            acc.add(code_points(b.column(0))[0])
    yield acc.batch()


def char_counts(df: DataFrame, text: str) -> DataFrame:
    """(ch, n) over all texts (trimmed, spaces removed, code points).

    Each task counts its characters on Arrow batches (vectorised) and emits
    one row per distinct character; the shuffle carries partial counts
    only."""
    return (df.select(F.col(text).alias("_s"))
            .mapInArrow(_count_partition, "ch string, n long")
            .groupBy("ch").agg(F.sum("n").alias("n")))


def char_counts_exploded(df: DataFrame, text: str) -> DataFrame:
    """T6 as a pure expression plan: explode characters, count."""
    return (df.select(F.explode(char_array(text)).alias("ch"))
            .groupBy("ch").agg(F.count(F.lit(1)).alias("n")))


def oov_counts(df: DataFrame, text: str, vocab: DataFrame,
               token: str = "token") -> DataFrame:
    """(ch, n) for characters not in ``vocab``."""
    v = vocab.select(F.col(token).alias("ch")).where(F.col("ch").isNotNull())
    return char_counts(df, text).join(v, "ch", "left_anti")


# Descriptions of a lexicon that travels with the tasks.
LEXICON_BYTES = 32 << 20


def replace_chars_table(df: DataFrame, id_col: str, text: str,
                        lexicon: DataFrame, ch: str = "ch",
                        rep: str = "rep") -> DataFrame:
    """T8 for a lexicon table: (id, text). Of several descriptions of a
    character the smallest counts; NULL ones don't. Keys are single
    characters, which Unicode bounds, so all but a lexicon of over
    ``LEXICON_BYTES`` travels with the tasks and the pass is narrow."""
    names = lexicon.where((F.char_length(ch) == 1) & F.col(rep).isNotNull()) \
        .groupBy(F.col(ch).alias("_rc_ch")).agg(F.min(rep).alias("_rc_rep"))
    size = names.agg(F.sum(F.octet_length("_rc_rep"))).first()[0] or 0
    if size > LEXICON_BYTES:
        return _replace_by_join(df, id_col, text, names)
    return df.select(id_col, replace_chars(
        text, {r[0]: r[1] for r in names.collect()}).alias(text))


def _replace_by_join(df: DataFrame, id_col: str, text: str,
                     names: DataFrame) -> DataFrame:
    """Characters with positions, joined, put together in order."""
    ex = df.select(id_col, F.posexplode(F.split(F.col(text), "")).alias(
        "_rc_pos", "_rc_ch"))
    j = ex.join(names, "_rc_ch", "left")
    out = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        "_rc_pos", F.coalesce("_rc_rep", "_rc_ch").alias("_rc_s")))).alias("_rc"))
    res = out.select(id_col, F.array_join(F.col("_rc._rc_s"), "").alias(text))
    # Texts that are empty strings explode to one empty piece; NULL texts
    # produce no rows and come back as NULL through the outer join.
    return df.select(id_col).join(res, id_col, "left")


def build_vocab(df: DataFrame, text: str, size: int) -> DataFrame:
    """(token, id): the specials, then the ``size`` most frequent
    characters by (count desc, token). Top-N is planned as a per-partition
    top-N plus a merge (TakeOrderedAndProject); the final numbering runs
    over at most ``size`` rows."""
    top = (char_counts(df, text).orderBy(F.col("n").desc(), F.col("ch"))
           .limit(size))
    w = Window.orderBy(F.col("n").desc(), F.col("ch"))
    ranked = top.select(F.col("ch").alias("token"),
                        (F.row_number().over(w) - 1 + len(SPECIALS))
                        .cast("int").alias("id"))
    spark = df.sparkSession
    specials = spark.createDataFrame(list(zip(SPECIALS, range(len(SPECIALS)))),
                                     "token string, id int")
    return specials.unionByName(ranked)


# As ``functions.subword`` cuts words, for regular expressions: what vanishes,
# and what is a word alone.
GONE = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\p{Cf}\p{Co}\x{FFFD}"
ALONE = r"\p{P}" + "".join(f"\\x{ord(c):02x}" for c in ASCII_SYMBOLS) + "".join(
    f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK)
WORD = rf"[{ALONE}]|[^{ALONE}\p{{Z}}\t\n\r]+"


# Distinct words that a task holds before it hands their counts on.
COUNTED_WORDS = 100_000


def _count_words(batches):
    seen: dict[str, int] = {}

    def counts():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()),
             pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
    for whole in batches:
        for b in slices(whole, ["_s"]):
            for word, n in counted_words(*all_code_points(b.column(0))):
                seen[word] = seen.get(word, 0) + n
            if len(seen) >= COUNTED_WORDS:
                yield counts()
                seen.clear()
    yield counts()


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, words cut as for ``encode_words``; the same
    as matches of ``WORD`` in texts without ``GONE``. Tasks count on Arrow
    batches, so a word leaves a task about once."""
    return (df.select(F.col(text).alias("_s"))
            .mapInArrow(_count_words, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_word_vocab(df: DataFrame, text: str, size: int,
                     continuation: str = "##", stem: int = 3) -> DataFrame:
    """E1 for words: (token, id): the specials, then the ``size`` most
    frequent of words, their first characters and stems, what follows the
    stem, and the characters behind the first (these two as continuations),
    by (count desc, token)."""
    def goes_on(c):
        return F.concat(F.lit(continuation), c)
    word = F.col("word")
    chars = F.split(F.substring(word, 2, 2 ** 31 - 1), "")
    tokens = F.concat(
        F.array_distinct(F.array(word, F.left(word, F.lit(1)),
                                 F.left(word, F.lit(stem)))),
        F.when(F.char_length(word) > stem, F.array(goes_on(
            F.substring(word, stem + 1, 2 ** 31 - 1)))).otherwise(
            F.array().cast("array<string>")),
        F.transform(F.filter(chars, lambda c: c != ""), goes_on))
    top = (word_counts(df, text).select(F.explode(tokens).alias("token"), "n")
           .groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.col("n").desc(), "token").limit(size))
    ranked = top.select("token", (F.row_number().over(Window.orderBy(
        F.col("n").desc(), "token")) - 1 + len(SPECIALS)).cast("int")
        .alias("id"))
    specials = df.sparkSession.createDataFrame(
        list(zip(SPECIALS, range(len(SPECIALS)))), "token string, id int")
    return specials.unionByName(ranked)
