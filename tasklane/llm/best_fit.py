"""Best-fit decreasing packing of token sequences, exact over the corpus.

Best-fit decreasing looks at nothing but lengths, and there are at most
``capacity`` of them. So the documents are counted by length, and the driver
places the counts, longest first: a segment tree over remaining capacities
finds the tightest open sequences in logarithmic time, and those of equal
remaining capacity are filled together. The result, a table whose size
depends on the capacity and never on the documents, says for each rank among
the pieces of a length which sequence and offset it has. A piece's rank is
its number among those of its task and length, in the task's order, plus the
pieces of that length in earlier tasks.

Every piece is placed as one-by-one best-fit decreasing over the whole corpus
would place it; no group of documents is packed apart.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm import tokens
from tasklane.llm.common import arrow_map, batch_rows, prepare, table
from tasklane.session import checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
TEXT_ROWS = 512            # texts that are read and go to a worker at once
_RANK_BITS = 44            # of a key made of a length and a rank

_PIECES = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("pos", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType())])
_PACKED = T.StructType([
    *[_PIECES[c] for c in ("doc_id", "piece", "start", "length",
                           "ids_crc32")],
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType())])


class CapacityTree:
    """Numbers of open sequences by remaining capacity, summed up a binary
    tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = self.leaves + remaining
        while at:
            self.total[at] += n
            at >>= 1

    def tightest(self, needed: int) -> int | None:
        """The least remaining capacity of ``needed`` or more that an open
        sequence has."""
        at = self.leaves + needed
        while not self.total[at]:
            while at & 1:              # a right child: go on from its parent
                at >>= 1
            if not at:
                return None
            at += 1                    # the next subtree to the right
        while at < self.leaves:
            at *= 2
            if not self.total[at]:
                at += 1
        return at - self.leaves


def place(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    Returns rows (length, first rank, first sequence, pieces in a sequence,
    offset): the pieces of a length from that rank on fill successive
    sequences, so many in each, one behind the other from the offset. Rows
    ascend by length and rank.

    A sequence that takes a piece is the tightest one for the next piece of
    the same length as long as it fits, so it takes as many as fit at once."""
    tree = CapacityTree(capacity)
    open_ = defaultdict(list)          # remaining -> [(first, how many)]
    sequences, out = 0, []

    def keep(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_[remaining].append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no piece of {length} fits into {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, sequences
                n = -(-left // (room // length))
                sequences += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            some = left - full * each if full < n else 0    # into one more
            out.append((length, rank, first, each, capacity - room))
            keep(room - each * length, first, full)
            if some:
                keep(room - some * length, first + full, 1)
            keep(room, first + full + bool(some), n - full - bool(some))
            rank += full * each + some
            left -= full * each + some
    out.sort()
    return np.array(out, np.int64).reshape(-1, 5)


def lookup(rows: np.ndarray, length: np.ndarray, rank: np.ndarray,
           capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, by the rows of ``place``."""
    at = np.searchsorted((rows[:, 0] << _RANK_BITS) + rows[:, 1],
                         (length << _RANK_BITS) + rank, side="right") - 1
    _, first_rank, first, each, offset = rows[at].T
    nth = rank - first_rank
    return first + nth // each, offset + nth % each * length


def _piece_batches(vocabulary: str | None, end_id: int, capacity: int):
    """Each document's ids with the end id, cut; nothing of the ids is kept
    but the checksums. ``pos`` counts the task's pieces. Tasks of a worker
    share the encoder of the installed vocabulary."""
    def run(batches, schema):
        own = tokens.json_encoder(vocabulary) if vocabulary \
            else tokens.installed_encoder(VOCABULARY)
        part = TaskContext.get().partitionId()
        seen = 0
        for batch in K.byte_slices(batches, "text", tokens.SLICE_BYTES):
            ids, off = own.encode(*K.flat(batch.column("text")))
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
            size = np.diff(off)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = size - (n - 1) * capacity       # the first piece
            start = np.where(piece, head[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece, capacity, head[doc])
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (off[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(
                at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), part, np.int32)),
                 pa.array(seen + np.arange(len(doc))),
                 batch.column("doc_id").take(pa.array(doc)),
                 pa.array(piece.astype(np.int32)), pa.array(start),
                 pa.array(length), pa.array(crc, pa.int64())], schema=schema)
            seen += len(doc)
    return run


def _place_batches(rows: np.ndarray, capacity: int):
    def run(batches, schema):
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy() for c in (
                    "length", "rank"))
                sequence, offset = lookup(rows, length, rank, capacity)
                yield K.with_columns(
                    batch, schema.names[:5], {"sequence_id": pa.array(
                        sequence), "offset": pa.array(offset)}, schema)
    return run


def pack(documents: DataFrame, capacity: int = CAPACITY,
         vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each row of ``documents``: ``doc_id``,
    ``piece``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, and where it lies: ``sequence_id``, ``offset``.

    A document is its ids and an end id; only one longer than ``capacity``
    is cut, its first piece taking what doesn't fill a sequence. Null and
    empty texts are the end id alone. Repeated rows and null ids are
    documents each; equal lengths are taken in the order of the files. A very
    long text gives as many pieces as it needs. An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read. ``vocabulary``: a tokenizer file's
    path on every worker, by default the installed one.

    The pieces (without ids) are written to the shared folder once, so that
    counts and ranks are of the same pieces even if a task runs again. They
    are few bytes for each task, so a shuffle by document and piece gathers
    them first: tasks that encode open no files, and there are as many files
    as the pieces' bytes call for. A task that runs again sends each piece to
    the same place."""
    spark = documents.sparkSession
    prepare(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("text").alias("text"))
    found = arrow_map(rows, _piece_batches(vocabulary, end_id, capacity),
                      _PIECES).hint("rebalance", "doc_id", "piece")
    with batch_rows(spark, TEXT_ROWS):
        found.write.parquet(path)
    pieces = spark.read.schema(_PIECES).parquet(path)
    # One row for each task and length, then at most one for each length.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("part").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("part", "length").orderBy(
        "pos", "doc_id", "piece")) - 1
    ranked = pieces.withColumn("nth", nth.cast("long")).join(
        before, ["part", "length"]).select(
        *_PACKED.names[:5], (F.col("nth") + F.col("before")).alias("rank"))
    return arrow_map(ranked, _place_batches(place(total, capacity),
                                            capacity), _PACKED)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
