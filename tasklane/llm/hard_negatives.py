"""Hard negatives for contrastive training by a secondary-sort shuffle.

Every pair of an anchor and another row has an integer score. Pairs travel as
packed keys (anchor, descending score, id) through
``repartitionAndSortWithinPartitions``, and an iterator reads each anchor's
pairs from the best score down: a row of the anchor's label opens a window of
scores, a row of another label is a negative of every window that is open. It
holds the open windows and a few rows of the score at hand, never an anchor.

Anchors are taken in blocks of bounded size, which travel to the tasks that
hold the rows; rows never move. What a task knows can't matter isn't sent: a
first pass finds the scores that open an anchor's windows, and of the rows
within a window each task sends its first few. The sort sees a bounded number
of pairs for each anchor and task, and gives what it would give for all pairs.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm.common import arrow_map, prepare, table
from tasklane.session import checkpoint_dir

BLOCK_ANCHORS = 4096       # anchors at a time, and the bytes of their vectors
BLOCK_BYTES = 8 << 20
TILE_PAIRS = 1 << 20       # scores computed at once

_BEST = T.StructType([
    T.StructField("anchor", T.IntegerType()),
    T.StructField("score", T.LongType()), T.StructField("id", T.LongType())])
_KEY = T.StructType([T.StructField("key", T.BinaryType())])
_MINED = T.StructType([
    T.StructField("anchor_id", T.LongType()),
    T.StructField("positive_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("negative_id", T.LongType()),
    T.StructField("positive_score", T.LongType()),
    T.StructField("negative_score", T.LongType())])

_SIGN = 1 << 63
_PACK = struct.Struct(">QQQB")
_NEGATIVE, _POSITIVE = 0, 1


def _vectors(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of whole numbers floor(scale * x), as doubles; shorter rows end
    in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = np.floor(
        flat.astype(np.float64) * scale)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in doubles while every sum is below
    2^53, else in 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    if most < 2 ** 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise ValueError("hard negatives: a score doesn't fit into 64 bits; "
                     "use a smaller scale")


def _first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each group by descending score and id; repeats
    count once."""
    order = np.lexsort((ids, -score, group))
    group, score, ids = group[order], score[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (
        ids[1:] != ids[:-1])
    group, score, ids = group[new], score[new], ids[new]
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:len(group)])
    nth = np.arange(len(group)) - np.repeat(
        edge, np.diff(np.r_[edge, len(group)]))
    return group[nth < k], score[nth < k], ids[nth < k]


class _Kept:
    """The first few pairs of each group that a task has seen."""

    def __init__(self, k: int):
        self.k = k
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, *new: np.ndarray) -> None:
        if len(new[0]):
            self.rows = _first(self.k, *(np.concatenate(x) for x in zip(
                self.rows, new, strict=True)))


class Anchors:
    """A block of anchors; with the scores that open their windows, if these
    are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray,
                 vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.opens = np.zeros((len(ids), 0), np.int64)
        self.closes = self.opens
        self.known = np.zeros((len(ids), 0), bool)

    def open_windows(self, anchor: np.ndarray, score: np.ndarray, k: int,
                     share: tuple[int, int]) -> None:
        """Up to ``k`` scores of each anchor."""
        shape = (len(self.ids), k)
        self.opens, self.closes = (np.zeros(shape, np.int64)
                                   for _ in range(2))
        self.known = np.zeros(shape, bool)
        filled = np.zeros(len(self.ids), np.int64)
        for a, s in zip(anchor.tolist(), score.tolist(), strict=True):
            self.opens[a, filled[a]] = s
            self.closes[a, filled[a]] = lowest(s, share)
            self.known[a, filled[a]] = True
            filled[a] += 1

    def tiles(self, batches: Iterable[pa.RecordBatch], scale: int):
        """Rows in pieces so small that all scores fit: ids, scores, whether
        labels agree."""
        step = max(1, TILE_PAIRS // max(1, len(self.ids)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                cut = batch.slice(a, step)
                ids = cut.column("id").to_numpy()
                score = _scores(self.vectors, _vectors(
                    cut.column("vector"), scale))
                yield ids, score, self.labels[:, None] == cut.column(
                    "label").to_numpy()

    def others(self, ids: np.ndarray) -> np.ndarray:
        return self.ids[:, None] != ids


def lowest(score: int, share: tuple[int, int]) -> int:
    """The least score in the window that ``score`` opens."""
    return -((-share[0] * score) // share[1])


def _best_batches(block, scale: int, k: int):
    def run(batches, schema):
        own, kept = block.value, _Kept(k)
        floor = np.full(len(own.ids), np.iinfo(np.int64).min)
        for ids, score, same in own.tiles(batches, scale):
            a, r = np.nonzero(same & (score >= floor[:, None]) &
                              own.others(ids))
            kept.add(a, score[a, r], ids[r])
            a, s, _ = kept.rows
            full = np.flatnonzero(np.bincount(a, minlength=len(floor)) >= k)
            floor[full] = s[np.searchsorted(a, full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([
            pa.array(c).cast(f.type) for c, f in zip(
                kept.rows, schema, strict=True)], schema=schema)
    return run


def _packed(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray,
            kind: int) -> list[bytes]:
    """Keys whose bytes sort by anchor, descending score and id."""
    out = np.zeros(len(ids), [("a", ">u8"), ("s", ">u8"), ("i", ">u8"),
                              ("k", "u1")])
    sign = np.uint64(_SIGN)
    out["a"] = anchor.astype(np.uint64) ^ sign
    out["s"] = ~(score.astype(np.uint64) ^ sign)
    out["i"] = ids.astype(np.uint64) ^ sign
    out["k"] = kind
    raw = out.tobytes()
    return [raw[a:a + _PACK.size] for a in range(0, len(raw), _PACK.size)]


def _pair_batches(block, scale: int, positives: int, negatives: int):
    def run(batches, schema):
        own = block.value
        n, k = own.opens.shape
        big = np.iinfo(np.int64)
        top = np.where(own.known, own.opens, big.min).max(1, initial=big.min)
        low = np.where(own.known, own.closes, big.max).min(1,
                                                           initial=big.max)
        least = np.where(own.known, own.opens, big.max).min(1,
                                                            initial=big.max)
        near, far = _Kept(positives), [_Kept(negatives) for _ in range(k)]
        for ids, score, same in own.tiles(batches, scale):
            a, r = np.nonzero(same & (score >= least[:, None]) &
                              own.others(ids))
            near.add(a, score[a, r], ids[r])
            a, r = np.nonzero(~same & (score <= top[:, None]) &
                              (score >= low[:, None]) & own.others(ids))
            s, i = score[a, r], ids[r]
            for w in range(k):
                on = own.known[a, w] & (s <= own.opens[a, w]) & (
                    s >= own.closes[a, w])
                far[w].add(a[on], s[on], i[on])
        a, s, i = near.rows
        keys = _packed(own.ids[a], s, i, _POSITIVE)
        a, s, i = (np.concatenate(x) for x in zip(
            *(w.rows for w in far), strict=True)) if far else near.rows
        if far:
            a, s, i = _first(k * negatives, a, s, i)
            keys += _packed(own.ids[a], s, i, _NEGATIVE)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())],
                                         schema=schema)
    return run


def open_windows(keys: Iterable[bytes], positives: int, negatives: int,
                 share: tuple[int, int]) -> Iterator[tuple]:
    """Rows of the result from an anchor's sorted keys, one pass. At most
    ``positives`` windows and ``negatives`` rows of one score are held."""
    last = anchor = level = None
    found, windows, tie = 0, [], []
    for key in keys:
        if key == last:                    # a repeated row
            continue
        last = key
        a, s, i, kind = _PACK.unpack(key)
        a, i, s = a - _SIGN, i - _SIGN, (_SIGN - 1) - s
        if a != anchor:
            anchor, level, found, windows, tie = a, None, 0, [], []
        if s != level:
            level, tie = s, []
            windows = [w for w in windows if w[2] <= s and w[3] < negatives]
        if kind == _POSITIVE:
            if found < positives:
                found += 1
                low = lowest(s, share)
                if low <= s:               # of a score below 0 it is empty
                    for rank, n in enumerate(tie, 1):
                        yield a, i, rank, n, s, s
                    windows.append([i, s, low, len(tie)])
            continue
        if len(tie) < negatives:
            tie.append(i)
        for w in windows:
            if w[3] < negatives:
                w[3] += 1
                yield a, w[0], w[3], i, w[1], s


def _anchor_part(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5,
         negatives: int = 5, share: tuple[int, int] = (80, 100),
         scale: int = 256, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """Hard negatives of the rows for which ``is_anchor`` holds.

    ``rows``: ``vec_id``, an integer ``label`` and ``embedding``; other
    columns aren't read. A score is the inner product of floor(scale * x).
    Positives are an anchor's first rows of its label, negatives of each are
    the first rows of other labels whose score is at most the positive's and
    at least its share; first means by descending score, then id.

    Rows with a null id, label, vector or component, or one that isn't
    finite, take no part. Exact repeats count once; rows of one id that
    differ are candidates each, and where they are anchors the one of
    smallest label, then components, is. A row is no candidate of its own id.
    Shorter vectors count as ending in zeros. An empty table, one without
    anchors and anchors without positives or negatives give no rows."""
    spark = rows.sparkSession
    prepare(spark)
    base = f"{checkpoint_dir(spark).rstrip('/')}/mined-{uuid.uuid4().hex}"
    whole = rows.select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor")).where(
        "id is not null and label is not null and vector is not null and "
        "forall(vector, x -> x is not null and not isnan(x) and "
        "abs(x) < double('inf'))")
    candidates = whole.select("id", "label", "vector")
    whole.where("_anchor").groupBy("id").agg(F.min(F.struct(
        "label", "vector")).alias("r")).select("id", "r.*").write.parquet(
        f"{base}/anchors")
    anchors = spark.read.parquet(f"{base}/anchors")
    n, dim = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    size = max(1, min(block_anchors, BLOCK_BYTES // (8 * max(1, dim or 1))))
    blocks = math.ceil(n / size)
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks))
                            == b).toArrow()
        if own.num_rows:
            _mine_block(spark, candidates, Anchors(
                own["id"].to_numpy(), own["label"].to_numpy(),
                _vectors(own["vector"], scale)), f"{base}/rows/block={b}",
                positives, negatives, share, scale)
    if not n:
        return spark.createDataFrame([], _MINED)
    return spark.read.schema(_MINED).parquet(f"{base}/rows").select(
        *_MINED.names)


def _mine_block(spark: SparkSession, candidates: DataFrame, own: Anchors,
                path: str, positives: int, negatives: int,
                share: tuple[int, int], scale: int) -> None:
    sc = spark.sparkContext
    block = sc.broadcast(own)
    first = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = arrow_map(candidates, _best_batches(block, scale, positives),
                     _BEST).dropDuplicates().withColumn(
        "nth", F.row_number().over(first)).where(
        F.col("nth") <= positives).toArrow()     # a few for each anchor
    block.unpersist()
    own.open_windows(best["anchor"].to_numpy(), best["score"].to_numpy(),
                     positives, share)
    block = sc.broadcast(own)
    pairs = arrow_map(candidates, _pair_batches(
        block, scale, positives, negatives), _KEY)
    parts = min(len(own.ids), int(spark.conf.get(
        "spark.sql.shuffle.partitions")))
    mined = pairs.rdd.map(lambda r: (bytes(r.key), None)) \
        .repartitionAndSortWithinPartitions(parts, _anchor_part) \
        .mapPartitions(lambda it: open_windows(
            (k for k, _ in it), positives, negatives, share))
    spark.createDataFrame(mined, _MINED).write.parquet(path)
    block.unpersist()


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 "
                        "else label end"))
    return mine(rows, F.col("vec_id") % 100 == 0)


def oracle_sql() -> str:
    """The query for DuckDB: all pairs, two ranked selections."""
    return """
WITH taken AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10
      ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM taken a JOIN taken r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id
    ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER first AS INTEGER) AS "rank",
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW first AS (PARTITION BY p.anchor_id, p.id
  ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER first <= 5"""
