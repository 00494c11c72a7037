"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Words are runs of letters and digits (any byte outside ASCII counts as a
letter), lower-cased. Every n-gram of a test item is a seed, so any run of
``SEED_N`` unchanged words holds one. One common n-gram proves nothing, several
of one item that stand in a text as they stand in the item are rare: a text
with two to five seeds of an item (one for each ten words) within its length
near one diagonal, or one seed of an item of fewer than ``LONE_WORDS`` words,
is aligned with that item around them, by word, with Smith-Waterman; edited,
cut or reordered copies keep a high score. A text is contaminated if an alignment
reaches ``MIN_SCORE`` of an item's perfect score, or, so that a part of a long
item counts as well, if one has ``MIN_WORDS`` equal words more than
``EDIT_WORDS`` for each edit. Places where too few of the item's words stand
near the seed for any alignment to reach either are skipped.

Test items are a stated query set. They are read in blocks of bounded size
(``BLOCK_WORDS``); each block's hashes travel to the tasks and every text is
compared with them in Arrow batches, so nothing of the corpus is shuffled.
A benchmark of several blocks costs a pass for each, between which the texts
and their hits so far are written to the shared folder: the driver and a task
hold one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm.common import arrow_map, table
from tasklane.session import checkpoint_dir

SEED_N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
MIN_WORDS = 13
LONE_WORDS = 8             # items shorter than this need one seed alone
WORDS_PER_SEED = 10        # others one for so many words, at least two,
MOST_SEEDS = 5             # and at most so many
EDIT_WORDS = 3
BLOCK_WORDS = 1 << 20

_BETWEEN = np.ones(256, bool)
_BETWEEN[0x80:] = False
_BETWEEN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
         ] = False


def _lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    out[after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the n+1 row offsets."""
    buf, off = K.flat(column)
    buf = _lower(buf)
    starts, ends, ptr = K.word_spans(buf, off, _BETWEEN)
    return K.span_hashes(buf, starts, ends), ptr


class Lookup:
    """Places of 64-bit hashes in a sorted array; a bitmap of their high
    bits turns most strangers away."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = max(10, min(20, len(values).bit_length() + 6))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._high(values)] = True

    def _high(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` that are known, and their place."""
        at = np.flatnonzero(self.map[self._high(x)])
        place = np.searchsorted(self.values, x[at])
        place = np.minimum(place, max(0, len(self.values) - 1))
        same = self.values[place] == x[at] if len(self.values) else \
            np.zeros(len(at), bool)
        return at[same], place[same]


@dataclass(frozen=True)
class Items:
    """A block of test items: ids, word hashes, and their seeds."""
    ids: list
    words: np.ndarray
    ptr: np.ndarray
    seeds: np.ndarray       # sorted hashes
    seed_ptr: np.ndarray    # per seed, its range in the next two
    item: np.ndarray
    offset: np.ndarray


def _grams(words: np.ndarray, ptr: np.ndarray, n: int):
    at = K.windows(ptr, n)
    return K.gram_hashes(words, n)[at], at


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS
                ) -> Iterator[list[tuple]]:
    """Distinct ``(item_id, text)`` rows in blocks of bounded total length,
    cut by a hash of the text and read one at a time."""
    items = benchmark.select("item_id", "text").where(
        "text is not null").distinct()
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(words) // block_words))
    key = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for b in range(blocks):
        yield sorted(map(tuple, items.where(key == b).collect()),
                     key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def prepare_items(rows: list[tuple], n: int = SEED_N) -> Items | None:
    """Items of at least ``n`` words with all their n-grams as seeds."""
    words, ptr = _words(pa.array([r[1] for r in rows], pa.string()))
    keep = np.flatnonzero(np.diff(ptr) >= n)
    if not len(keep):
        return None
    words = np.concatenate([words[ptr[i]:ptr[i + 1]] for i in keep])
    ptr = np.concatenate([[0], np.cumsum(np.diff(ptr)[keep])])
    ids = [rows[i][0] for i in keep]
    grams, at = _grams(words, ptr, n)
    order = np.argsort(grams, kind="stable")
    grams, at = grams[order], at[order]
    seeds, first = np.unique(grams, return_index=True)
    row = np.searchsorted(ptr, at, side="right") - 1
    return Items(ids, words, ptr, seeds, np.append(first, len(at)),
                 row, at - ptr[row])


def align(item: np.ndarray, text: np.ndarray, match: int = MATCH,
          mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """Smith-Waterman, linear gaps: the best local score and where in ``text``
    one alignment with it ends (the shortest part of the item). Rows run over the item; a running maximum
    carries gaps along a row."""
    slide = np.arange(len(text) + 1, dtype=np.int64) * -gap
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = above[:-1] + np.where(text == w, match, mismatch)
        np.maximum(row, above + gap, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slide) - slide
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def _hits(items: Items, known: Lookup, words, ptr, n: int, min_score: float,
          min_words: int):
    """``(row, item, score, start word, end word)`` of the alignments that
    reach a threshold: the best of each row and item."""
    grams, at = _grams(words, ptr, n)
    where, seed = known.find(grams)
    if not len(where):
        return
    times = np.diff(items.seed_ptr)[seed]
    entry = np.repeat(items.seed_ptr[seed], times) + (
        np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    place = np.repeat(at[where], times)
    row = np.searchsorted(ptr, place, side="right") - 1
    item, begin = items.item[entry], place - items.offset[entry]
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    offset = items.offset[entry][order]
    size = items.ptr[item + 1] - items.ptr[item]
    slack = size // 2 + 4
    # A second seed, elsewhere in the item and in the text, near the same
    # diagonal.
    pair = ((row[1:] == row[:-1]) & (item[1:] == item[:-1])
            & (begin[1:] - begin[:-1] <= slack[1:])
            & (offset[1:] != offset[:-1])
            & (begin[1:] + offset[1:] != begin[:-1] + offset[:-1]))
    sure = size < LONE_WORDS
    sure[1:] |= pair
    sure[:-1] |= pair
    if not sure.any():
        return
    row, item, begin, size, slack = (x[sure] for x in (
        row, item, begin, size, slack))
    needed = np.where(size < LONE_WORDS, 1, np.clip(
        size // WORDS_PER_SEED, 2, MOST_SEEDS))
    last = np.arange(len(row)) + needed - 1
    inside = np.minimum(last, len(row) - 1)
    full = np.flatnonzero((last == inside) & (row[inside] == row) & (
        item[inside] == item) & (begin[inside] - begin <= slack))
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, full, 1)
    np.add.at(cover, last[full] + 1, -1)
    sure = np.cumsum(cover[:-1]) > 0
    if not sure.any():
        return
    row, item, begin, size, slack = (x[sure] for x in (
        row, item, begin, size, slack))
    left = np.maximum(begin - slack, ptr[row])
    right = np.minimum(begin + size + slack, ptr[row + 1])
    # Windows of a row and item that overlap are aligned as one.
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (
        left[1:] > right[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    done: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, j, a, b in zip(row[first].tolist(), item[first].tolist(),
                          left[first].tolist(), right[last].tolist(),
                          strict=True):
        own = items.words[items.ptr[j]:items.ptr[j + 1]]
        # No alignment matches more words than stand in both.
        both = int(np.isin(own, words[a:b]).sum())
        if both < min(min_score * len(own), min_words):
            continue
        score, end = align(own, words[a:b])
        if score < min_score * MATCH * len(own):
            # A part alone. Its span is that of the stricter alignment.
            score, end = align(own, words[a:b], 1, *[-EDIT_WORDS] * 2
                               ) if both >= min_words else (0, 0)
            if score < min_words:
                continue
            back = align(own[::-1], words[a:a + end][::-1], 1,
                         *[-EDIT_WORDS] * 2)[1]
            score = align(own, words[a + end - back:a + end])[0]
        else:
            back = 0
        if score > done.get((i, j), (0,))[0]:
            back = back or align(own[::-1], words[a:a + end][::-1])[1]
            done[i, j] = (score, a + end - back - int(ptr[i]),
                          a + end - int(ptr[i]))
    for (i, j), found in done.items():
        full = MATCH * int(items.ptr[j + 1] - items.ptr[j])
        yield i, j, found[0] / full, found[1], found[2]


def _match_batches(items: Items, keep, n: int, min_score: float,
                   min_words: int):
    def run(batches, schema):
        known = Lookup(items.seeds)
        for batch in K.byte_slices(batches, "text"):
            words, ptr = _words(batch.column("text"))
            own: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j, score, a, b in _hits(items, known, words, ptr, n,
                                           min_score, min_words):
                own[i].append({"item_id": items.ids[j], "score": score,
                               "start": a, "end": b})
            yield K.with_columns(batch, keep, {
                "hits": pa.array(own, schema.field("hits").type)}, schema)
    return run


_HIT = "array<struct<item_id: bigint, score: double, start: bigint, " \
    "end: bigint>>"


def benchmark_hits(documents: DataFrame, benchmark: DataFrame,
                   keep: list[str] | None = None, n: int = SEED_N,
                   min_score: float = MIN_SCORE, min_words: int = MIN_WORDS,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``documents``: the columns in ``keep``
    (default ``doc_id``; not named ``hits`` or ``_before``) and ``hits``, the test items it
    holds with their score (share of a perfect one) and the words of the
    text they span.

    Null and empty texts hold nothing. Null items, and items of fewer than
    ``n`` words, match nothing; repeated items count once; equal scores in a
    text keep the first place. Only ``text`` and ``keep`` are read; empty
    tables give no rows or no hits."""
    keep = ["doc_id"] if keep is None else keep
    need = list(dict.fromkeys([*keep, "text"]))
    found = documents.select(*need)
    hits = F.array().cast(_HIT)
    after = False
    for rows in item_blocks(benchmark, block_words):
        items = prepare_items(rows, n)
        if items is None:
            continue
        if after:              # one block's items in a plan at a time
            spark = documents.sparkSession
            path = (f"{checkpoint_dir(spark).rstrip('/')}/"
                    f"hits-{uuid.uuid4().hex}")
            found.withColumn("_before", hits).drop("hits").write.parquet(path)
            found = spark.read.parquet(path)
            hits = F.col("_before")
        inner = T.StructType([*found.schema.fields, T.StructField(
            "hits", T._parse_datatype_string(_HIT))])
        found = arrow_map(found, _match_batches(
            items, found.columns, n, min_score, min_words), inner)
        hits = F.concat(hits, "hits") if after else F.col("hits")
        after = True
    return found.select(*keep, hits.alias("hits"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options
                   ) -> DataFrame:
    """The rows of ``documents`` that hold no test item, all columns."""
    names = documents.columns
    plain = documents.toDF(*[c if c == "text" else f"_c{i}"
                             for i, c in enumerate(names)])
    hits = benchmark_hits(plain, benchmark, plain.columns, **options)
    return hits.where(F.size("hits") == 0).drop("hits").toDF(*names)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str
                                  ) -> DataFrame:
    """Every document with the number of test items it holds, the best of
    them (ties: the smallest id) and the verdict."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"),
                          table(spark, sf_dir, "benchmark"))
    best = F.array_min(F.transform("hits", lambda h: F.struct(
        (-h["score"]).alias("score"), h["item_id"].alias("item_id"),
        h["start"].alias("start"), h["end"].alias("end"))))
    return hits.select(
        "doc_id", F.size("hits").cast("long").alias("n_items"),
        best["item_id"].alias("item_id"), (-best["score"]).alias("score"),
        best["start"].alias("start_word"), best["end"].alias("end_word"),
        (F.size("hits") > 0).alias("contaminated"))
