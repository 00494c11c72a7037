"""Sequence encoding and padding.

Encoding is a narrow, shuffle-free pass, vectorised over Arrow batches. By
characters, only single-character tokens can match, so the part of any
vocabulary that it needs is bounded by Unicode (1.1 M code points, two
arrays of a few MB); it is collected once and travels with the tasks. By
words, the vocabulary's tries travel, and a vocabulary of over
``MAX_VOCAB_CHARS`` characters is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, StructField,
                               StructType)

from tasklane.functions import codepoints as CP
from tasklane.functions.subword import Pieces
from tasklane.operators.vocab import (CLS_ID, PAD_ID, SEP_ID, SPECIALS,
                                      UNK_ID)
from tasklane.session import cut_lineage

# Characters of all tokens: a few dozen bytes each in a task.
MAX_VOCAB_CHARS = 4_000_000


def encode(df: DataFrame, vocab: DataFrame, text: str,
           text_pair: str | None = None,
           keep: Sequence[str] | None = None) -> DataFrame:
    """``input_ids`` = [CLS] a [SEP] (b [SEP]), ``token_type_ids``
    0 for the first segment, 1 for the second, and ``length``. NULL text
    encodes as empty; of repeated tokens the smallest id counts.

    A narrow ``mapInArrow`` that decodes each batch to code points once and
    looks all of them up with one ``searchsorted``. ``keep``: input columns
    carried to the output (default all); naming only the needed ones keeps
    e.g. the raw text out of the Python round trip.
    """
    if keep is not None:
        df = df.select(*dict.fromkeys(
            [*keep, text] + ([text_pair] if text_pair else [])))
    rows = (vocab.where(F.char_length("token") == 1).groupBy("token")
            .agg(F.min("id").alias("id")).collect())
    lookup = CP.Lookup({r[0]: r[1] for r in rows}, UNK_ID)

    def ids(column):
        cps, offs = CP.code_points(column)
        return lookup(cps), offs
    return _encode_arrow(df, ids, text, text_pair, keep)


def encode_words(df: DataFrame, vocab: DataFrame, text: str,
                 text_pair: str | None = None,
                 keep: Sequence[str] | None = None, lower: bool = False,
                 continuation: str = "##", longest_word: int = 100
                 ) -> DataFrame:
    """E2 by words: as ``encode``, but words (runs between white space,
    punctuation and CJK characters, which are words alone) become the longest
    tokens that spell them, those behind the first with the ``continuation``
    mark. A word that can't be spelt, or is longer than ``longest_word``, is
    [UNK]. The special tokens are no words of a text. ``lower``: texts are
    lower-cased first."""
    cols = [text] + ([text_pair] if text_pair else [])
    if keep is not None:
        df = df.select(*dict.fromkeys([*keep, *cols]))
    names = dict.fromkeys(keep or df.columns)
    # Measured, then collected: it is made once.
    plain = cut_lineage(vocab.where(
        F.col("token").isNotNull() & ~F.col("token").isin(*SPECIALS))
        .select("token", "id"))
    chars = plain.agg(F.sum(F.char_length("token"))).first()[0] or 0
    if chars > MAX_VOCAB_CHARS:
        raise ValueError(f"a vocabulary of {chars} characters; up to "
                         f"{MAX_VOCAB_CHARS} travel with the tasks")
    rows = plain.groupBy("token").agg(F.min("id").alias("id")).collect()
    pieces = Pieces({r.token: r.id for r in rows}, UNK_ID, continuation,
                    longest_word)

    def ids(column):
        return pieces(*CP.all_code_points(column))
    seen = {c: f"_e2_{i}" for i, c in enumerate(cols)}
    df = df.select(*names, *[(F.lower(c) if lower else F.col(c)).alias(n)
                             for c, n in seen.items()])
    return _encode_arrow(df, ids, seen[text], seen.get(text_pair), [*names])


def with_length(df: DataFrame, text: str, text_pair: str | None = None
                ) -> DataFrame:
    """E2's ``length`` without encoding: every character is one id, known or
    not, between [CLS] and [SEP]."""
    def chars(c: str) -> Column:
        return F.coalesce(F.char_length(F.replace(F.trim(F.col(c)), F.lit(" "),
                                                  F.lit(""))), F.lit(0))
    n = chars(text) + 2
    return df.withColumn("length", n if text_pair is None
                         else n + chars(text_pair) + 1)


_ENC_FIELDS = [("input_ids", ArrayType(IntegerType())),
               ("token_type_ids", ArrayType(IntegerType())),
               ("length", IntegerType())]


def _encode_arrow(df: DataFrame, to_ids: Callable, text: str,
                  text_pair: str | None,
                  carry: Sequence[str] | None = None) -> DataFrame:
    """``to_ids``: an Arrow column -> all its ids, and row offsets."""
    cols = [text] + ([text_pair] if text_pair else [])
    keep = [f for f in df.schema.fields if f.name not in dict(_ENC_FIELDS)
            and (carry is None or f.name in carry)]
    out_schema = StructType(keep + [StructField(n, t) for n, t in _ENC_FIELDS])
    names = [f.name for f in keep]

    def run(batches):
        for whole in batches:
            for b in CP.slices(whole, cols):
                yield _encode_batch(b)

    def _encode_batch(b):
        segs = [to_ids(b.column(c)) for c in cols]
        ids, types, length = CP.frame(segs, CLS_ID, SEP_ID)
        return pa.RecordBatch.from_arrays(
            [b.column(n) for n in names] + [ids, types, length],
            schema=pa.schema([b.schema.field(n) for n in names] + [
                pa.field("input_ids", pa.list_(pa.int32())),
                pa.field("token_type_ids", pa.list_(pa.int32())),
                pa.field("length", pa.int32())]))

    return df.mapInArrow(run, out_schema)


def pad(df: DataFrame, max_len, pad_id: int = PAD_ID) -> DataFrame:
    """Pad ids with ``pad_id``, types with 0, mask 1/0 up to ``max_len``
    (a number or a column)."""
    ml = F.lit(max_len) if isinstance(max_len, int) else (
        F.col(max_len) if isinstance(max_len, str) else max_len)
    diff = F.greatest(ml - F.col("length"), F.lit(0))
    return (df.withColumn("attention_mask", F.concat(
                F.array_repeat(F.lit(1), F.col("length")),
                F.array_repeat(F.lit(0), diff)))
            .withColumn("token_type_ids", F.concat(
                "token_type_ids", F.array_repeat(F.lit(0), diff)))
            .withColumn("input_ids", F.concat(
                "input_ids", F.array_repeat(F.lit(pad_id), diff))))


def collate(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad every row to the longest row of its batch. A batch holds a
    fixed, small number of rows, so the window partition is bounded."""
    mx = F.max("length").over(Window.partitionBy(batch))
    return pad(df.withColumn("max_len", mx), "max_len")


def padding_waste(df: DataFrame, by=(), batch: str | None = "batch_id",
                  fixed_len: int | None = None) -> DataFrame:
    """E5: share of pad positions, per grouping: dynamic per-batch padding
    (``batch``) or a fixed length."""
    by = list(by)
    if fixed_len is not None:
        ml = F.greatest(F.lit(fixed_len), F.col("length"))
        base = df.withColumn("_pw_ml", ml)
        return base.groupBy(*by).agg(
            (F.sum(F.col("_pw_ml") - F.col("length")) / F.sum("_pw_ml"))
            .alias("pad_share"))
    per = df.groupBy(*by, batch).agg(F.max("length").alias("_pw_ml"),
                                      F.sum("length").alias("_pw_len"),
                                      F.count(F.lit(1)).alias("_pw_n"))
    return per.groupBy(*by).agg(
        (F.sum(F.col("_pw_ml") * F.col("_pw_n") - F.col("_pw_len"))
         / F.sum(F.col("_pw_ml") * F.col("_pw_n"))).alias("pad_share"))
