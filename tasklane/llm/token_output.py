"""Token ids in a binary file format of independent, checksummed blocks.

Documents are range-partitioned and sorted into file order, encoded, and
their ids (each document ends with an end id) cut into blocks of
``BLOCK_IDS``, which an adaptive context-mixing range coder compresses (see
``range_coder``). A folder of Parquet files holds the blocks, one row each:
the part (a range of documents), the block's number, its bytes, and the
index of the document pieces in it. Any block decodes alone, so a reader
splits files wherever it likes, and a lost task is written again as it was.

A document's ids may be in several blocks. Readers need no document as a
whole: the checksum of a document is the exclusive-or of those of its pieces,
each moved by the bytes that follow it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm import range_coder as R
from tasklane.llm import tokens
from tasklane.llm.common import arrow_map, prepare, table
from tasklane.session import checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

_INDEX = ("doc", "doc_id", "at", "n", "before", "doc_len", "skipped")
_FILE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block",
                                                          T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("data",
                                                        T.BinaryType()),
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in _INDEX]])


class _Part:
    """Ids of a part that aren't written yet, and where documents lie."""

    def __init__(self, part: int, block_ids: int):
        self.part, self.block_ids = part, block_ids
        self.block, self.done, self.doc = 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple] = []      # doc, doc_id, start, length

    def add(self, doc_ids: list, ids: np.ndarray, off: np.ndarray) -> None:
        base = self.done + self.held
        for key, a, b in zip(doc_ids, off[:-1].tolist(), off[1:].tolist(),
                             strict=True):
            self.docs.append((self.doc, key, base + a, b - a))
            self.doc += 1
        self.ids.append(ids)
        self.held += len(ids)

    def blocks(self, all_of_it: bool, schema: pa.Schema):
        """Full blocks; at the end all."""
        if not self.held or not all_of_it and self.held < self.block_ids:
            return
        ids = np.concatenate(self.ids)
        stop = len(ids) if all_of_it else (
            len(ids) // self.block_ids * self.block_ids)
        cut = range(0, stop, self.block_ids)
        own = [ids[a:min(a + self.block_ids, stop)] for a in cut]
        data = R.encode_blocks(own)
        index: list[list[list]] = [[] for _ in own]
        left = []
        for doc, key, start, size in self.docs:
            a = max(start, self.done) - self.done
            end = start + size - self.done
            while a < min(end, stop):
                b = a // self.block_ids
                z = min(end, (b + 1) * self.block_ids, stop)
                index[b].append((doc, key, a - b * self.block_ids, z - a,
                                 start, size, a + self.done - start))
                a = z
            if end > stop:
                left.append((doc, key, start, size))
        columns = list(zip(*[[list(c) for c in zip(*rows, strict=True)]
                             for rows in index], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.part] * len(own), pa.int32()),
             pa.array(range(self.block, self.block + len(own)), pa.int64()),
             pa.array([len(b) for b in own], pa.int64()),
             pa.array(data, pa.binary()),
             *[pa.array(c, pa.list_(pa.int64())) for c in columns]],
            schema=schema)
        self.block += len(own)
        self.done += stop
        self.docs = left
        self.ids, self.held = [ids[stop:].copy()], len(ids) - stop


def _write_batches(vocabulary: str | None, end_id: int, block_ids: int):
    def run(batches, schema):
        own = tokens.json_encoder(vocabulary) if vocabulary \
            else tokens.installed_encoder(VOCABULARY)
        part = _Part(TaskContext.get().partitionId(), block_ids)
        for batch in K.byte_slices(batches, "text", tokens.SLICE_BYTES):
            ids, off = own.encode(*K.flat(batch.column("text")))
            ids = np.insert(ids, off[1:], end_id)
            part.add(batch.column("doc_id").to_pylist(), ids,
                     off + np.arange(len(off)))
            for out in part.blocks(False, schema):
                yield _fit(out, schema)
        for out in part.blocks(True, schema):
            yield _fit(out, schema)
    return run


def _fit(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [a.cast(f.type) for a, f in zip(batch.columns, schema, strict=True)],
        schema=schema)


def write_tokens(documents: DataFrame, path: str,
                 order: Sequence[str | Column] = ("doc_id",),
                 vocabulary: str | None = None, end_id: int = END_ID,
                 block_ids: int = R.BLOCK_IDS) -> None:
    """Write the ids of every row of ``documents`` to ``path``, a folder on
    any store of Spark's, in ascending ``order`` (nulls first; ties by the
    text's hash, so a rerun writes the same).

    Null and empty texts are documents of the end id alone. Repeated rows
    are documents each. Only ``doc_id``, ``text`` and the order columns are
    read. ``vocabulary``: a tokenizer file's path on every worker, by default
    the installed one."""
    prepare(documents.sparkSession)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = [f"_o{i}" for i in range(len(keys))] + ["_tie"]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        *[k.alias(n) for k, n in zip(keys, named, strict=False)],
        F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(*named).sortWithinPartitions(*named)
    arrow_map(rows.select("doc_id", "text"), _write_batches(
        vocabulary, end_id, block_ids), _FILE).write.mode(
            "errorifexists").parquet(path)


# Moving a CRC-32 by a number of zero bytes is linear over its bits: powers
# of the operator for one byte, as the images of the 32 bits.
def _apply(operator: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros_like(value)
    for bit in range(32):
        out ^= np.where((value >> np.uint32(bit)) & np.uint32(1),
                        operator[bit], np.uint32(0))
    return out


def _operators(count: int = 48) -> list[np.ndarray]:
    one = np.array([0xEDB88320, *[1 << b for b in range(31)]], np.uint32)
    for _ in range(3):
        one = _apply(one, one)
    out = [one]
    for _ in range(count - 1):
        out.append(_apply(out[-1], out[-1]))
    return out


def crc_moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each checksum's share in that of a text with ``n_bytes`` more."""
    crc = crc.astype(np.uint32)
    for k, operator in enumerate(_operators()):
        on = np.flatnonzero((n_bytes >> k) & 1)
        if len(on):
            crc[on] = _apply(operator, crc[on])
    return crc


_PIECE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("doc",
                                                          T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("before",
                                                         T.LongType()),
    T.StructField("doc_len", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("share", T.LongType())])


def _read_batches(batches, schema):
    def pieces(rows: pa.Table) -> pa.RecordBatch:
        ids = R.decode_blocks(rows["data"].to_pylist())
        index = {c: rows[c].combine_chunks() for c in _INDEX}
        flat = {c: v.flatten().to_numpy(zero_copy_only=False)
                for c, v in index.items() if c != "doc_id"}
        sizes = np.diff(index["n"].offsets.to_numpy())
        block = np.repeat(np.arange(len(ids)), sizes)
        crc = np.array([zlib.crc32(ids[b][a:a + n].tobytes()) for b, a, n in
                        zip(block.tolist(), flat["at"].tolist(),
                            flat["n"].tolist(), strict=True)], np.uint32)
        after = flat["doc_len"] - flat["skipped"] - flat["n"]
        share = crc_moved(crc, after.astype(np.int64) * 4)
        part = np.repeat(rows["part"].to_numpy(), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(flat["doc"]),
             index["doc_id"].flatten(), pa.array(flat["before"]),
             pa.array(flat["doc_len"]), pa.array(flat["n"]),
             pa.array(share.astype(np.int64))], schema=schema)
    for batch in batches:
        for row in range(batch.num_rows):
            yield pieces(pa.Table.from_batches([batch.slice(row, 1)]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it in file order),
    ``n_tokens`` and ``ids_crc32`` of every document in the files, from its
    decoded ids. A damaged block or a missing piece is an error."""
    rows = spark.read.schema(_FILE).parquet(path)
    found = arrow_map(rows.select("part", "data", *_INDEX), _read_batches,
                      _PIECE)
    docs = found.groupBy("part", "doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("before").alias("before"),
        F.max("doc_len").alias("doc_len"), F.sum("n").alias("n_tokens"),
        F.bit_xor("share").alias("ids_crc32"))
    # One row per part, from the files: how many ids are in earlier parts.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    whole = F.when(F.col("n_tokens") == F.col("doc_len"),
                   F.col("n_tokens")).otherwise(F.raise_error(F.lit(
                       "token files: a piece of a document is missing")
                   ).cast("long"))
    return docs.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("earlier")).alias("start"),
        whole.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``block`` and the decoded ``ids`` of every block; blocks in
    order of both are the stream."""
    schema = T.StructType([
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches, out):
        for batch in batches:
            ids = R.decode_blocks(batch.column("data").to_pylist())
            yield K.with_columns(batch, ["part", "block"], {"ids": pa.array(
                [x.astype(np.int64) for x in ids], pa.list_(pa.int64()))},
                out)
    return arrow_map(spark.read.schema(_FILE).parquet(path).select(
        "part", "block", "data"), run, schema)


def new_path(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def token_output(documents: DataFrame, path: str | None = None,
                 order: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """Write ``documents`` to ``path`` (by default a new shared folder) and
    read the files back; see ``write_tokens`` and ``read_documents``. An
    empty table writes no block and gives no rows."""
    spark = documents.sparkSession
    path = path or new_path(spark)
    write_tokens(documents, path, order)
    return read_documents(spark, path)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files."""
    return token_output(table(spark, sf_dir, "documents"))
