"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint: the majority of the bits of its word
shingles' XXH64 values. Distinct fingerprints are then compared exactly, in
tiles, with numpy exclusive-or and bit counts. A tile holds fingerprints
whose bits are counted alike in each of a few parts of the word: two
fingerprints differ in at least as many bits as their part counts differ in
sum, so a pair of tiles whose counts differ by more than the radius is
skipped without loss. A cell of equal counts is cut into tiles of at most
``TILE`` fingerprints, whatever its size; each surviving tile pair is one
unit of work for any executor.

Within a tile pair only links that join two groups are kept (a spanning
forest), so a large group of near copies gives as many links as members, not
their square. Components are found with joins (see ``components``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm.common import arrow_map, prepare, table
from tasklane.llm.components import Forest, components
from tasklane.session import cut_lineage

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
_TILES = 1 << 30   # tile numbers of a cell
BLOCK = 1 << 18    # pairs compared by one numpy call
# Parts of the word that are counted apart, by the number of distinct
# fingerprints: more parts skip more tile pairs but make smaller tiles. The
# links found are the same for any number of parts.
PARTS_UP_TO = ((1 << 20, 2), (1 << 28, 4), (None, 8))


def _lower_joined(buf, starts, ends):
    """The words with one space after each, A-Z lowered, and their new
    spans."""
    size = ends - starts
    new = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(new[-1], 32, np.uint8)
    inside = ~K.SPACE[buf]
    body = buf[inside]
    upper = (body >= 65) & (body <= 90)
    body = body + (upper * np.uint8(32)).astype(np.uint8)
    place = np.arange(len(body)) + np.repeat(np.arange(len(size)), size)
    out[place] = body
    return out, new[:-1], new[:-1] + size


def _fingerprints(buf, off, n: int, seed: int) -> np.ndarray:
    starts, ends, ptr = K.word_spans(buf, off)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    joined, starts, ends = _lower_joined(buf, starts, ends)
    data = joined.tobytes()
    words = np.diff(ptr)
    first = K.windows(ptr, n)
    # A row of fewer words than a shingle is one shingle of them all.
    short = np.flatnonzero((words > 0) & (words < n))
    begin = np.concatenate([starts[first], starts[ptr[:-1][short]]])
    stop = np.concatenate([ends[first + n - 1], ends[ptr[1:][short] - 1]])
    row = np.concatenate([K.rows_of(ptr)[first], short])
    order = np.argsort(row, kind="stable")
    begin, stop, row = begin[order], stop[order], row[order]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], seed) for a, b in zip(
        begin.tolist(), stop.tolist(), strict=True)), np.uint64, len(begin))
    count = np.bincount(row, minlength=len(out))
    full = np.flatnonzero(count)
    edge = np.concatenate([[0], np.cumsum(count[full])])
    for start in range(0, len(full)):
        a, b = edge[start], edge[start + 1]
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1)
        votes = bits.sum(axis=0, dtype=np.int64) * 2 > b - a
        out[full[start]] = np.packbits(votes).view(np.uint64)[0]
    return out


def _fingerprint_batches(keep: list[str], n: int, seed: int):
    def run(batches, schema):
        for batch in K.byte_slices(batches, "text"):
            fp = _fingerprints(*K.flat(batch.column("text")), n, seed)
            yield K.with_columns(batch, keep, {
                "fp": pa.array(fp.view(np.int64))}, schema)
    return run


def fingerprints(documents: DataFrame, keep: list[str] | None = None,
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns in ``keep`` (default ``doc_id``) and ``fp``, the signed
    view of the 64-bit fingerprint, for each row. A text without words,
    empty or null has fingerprint zero."""
    keep = ["doc_id"] if keep is None else keep
    fields = [f for c in keep for f in documents.schema if f.name == c]
    need = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(documents.select(*need),
                     _fingerprint_batches(keep, shingle, seed),
                     T.StructType([*fields, T.StructField("fp",
                                                          T.LongType())]))


def _base(parts: int, radius: int) -> int:
    """Of the numbers that stand for part counts: large enough that a count
    changed by ``radius`` never looks like another cell's."""
    return 1 << (64 // parts + radius).bit_length()


def _cell(fp: Column, parts: int, radius: int) -> Column:
    """Bit counts of the parts, as the digits of one number."""
    width = 64 // parts
    out = F.lit(0).cast("long")
    for k in range(parts):
        part = F.shiftrightunsigned(fp, k * width)
        if width < 64:
            part = part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out * _base(parts, radius) + F.bit_count(part)
    return out


def _steps(parts: int, radius: int) -> list[int]:
    """Differences between the cells of two fingerprints within ``radius``;
    of each and its opposite, the one that isn't negative."""
    codes = [(0, 0)]
    for _ in range(parts):
        codes = [(code * _base(parts, radius) + d, s + abs(d))
                 for code, s in codes for d in range(-radius, radius + 1)
                 if s + abs(d) <= radius]
    return sorted({code for code, _ in codes if code >= 0})


def _link_pair(a: np.ndarray, b: np.ndarray, same: bool, radius: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or within one) that join two groups."""
    left, right = [], []
    forest = Forest(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    step = max(1, BLOCK // len(b))
    for start in range(0, len(a), step):
        rows = a[start:start + step, None]
        near = np.bitwise_count(rows ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + start
        if same:
            i, j = i[i < j], j[i < j]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.union(x, y + shift):
                left.append(x)
                right.append(y)
    return a[np.array(left, np.int64)], b[np.array(right, np.int64)]


def _link_batches(radius: int):
    def run(batches, schema):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), "<i8")
                        .view(np.uint64) for c in ("left", "right"))
                u, v = _link_pair(a, b, batch.column("same")[i].as_py(),
                                  radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)),
                         pa.array(v.view(np.int64))], schema=schema)
    return run


def _pack_batches(batches, schema):
    """Sorted rows ``(tile, fp)`` -> one row per tile with its fingerprints
    as bytes. A task holds whole tiles, one after another."""
    tile, have = None, []

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([tile]), pa.array([b"".join(have)], pa.binary())],
            schema=schema)
    for batch in batches:
        ids = batch.column("tile").to_numpy()
        fps = batch.column("fp").to_numpy()
        if not len(ids):
            continue
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1,
                              [len(ids)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if tile is not None and ids[a] != tile:
                yield done()
                have = []
            tile = int(ids[a])
            have.append(fps[a:b].astype("<i8").tobytes())
    if have:
        yield done()


def parts_for(count: int) -> int:
    return next(p for most, p in PARTS_UP_TO if most is None or count <= most)


def links(distinct: DataFrame, radius: int = RADIUS,
          parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect every two of the distinct fingerprints
    ``fp`` at ``radius`` or fewer differing bits: all groups, as spanning
    forests of tile pairs."""
    parts = parts or parts_for(distinct.count())
    cells = distinct.select("fp", _cell(
        F.col("fp"), parts, radius).alias("cell"))
    # Tiles of a cell: as many as its size asks for, dealt by a hash. No
    # window over a cell, however many fingerprints it has.
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.select("cell", F.ceil(
        F.col("n") / (tile // 2)).cast("long").alias("tiles")))
    dealt = cells.join(counts, "cell").select(
        (F.col("cell") * _TILES + F.pmod(F.xxhash64("fp"), F.col("tiles"))
         ).alias("tile"), "fp")
    packed = arrow_map(
        dealt.repartition("tile").sortWithinPartitions("tile", "fp"),
        _pack_batches, T.StructType([T.StructField("tile", T.LongType()),
                                     T.StructField("fps", T.BinaryType())]))
    packed = cut_lineage(packed)
    # Tile pairs: equi-joins of the cells with those a step away.
    step = F.explode(F.array(*[F.lit(s).cast("long")
                               for s in _steps(parts, radius)]))
    near = (counts.select(F.col("cell").alias("c1"),
                          F.col("tiles").alias("t1"), step.alias("d"))
            .withColumn("c2", F.col("c1") + F.col("d"))
            .join(counts.select(F.col("cell").alias("c2"),
                                F.col("tiles").alias("t2")), "c2"))
    pairs = (near.select("c1", "c2", "t2", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("t1") - 1)).alias("i"))
        .select("c1", "c2", "i", F.explode(F.sequence(
            F.lit(0).cast("long"), F.col("t2") - 1)).alias("j"))
        .where("c1 != c2 or i <= j")
        .select((F.col("c1") * _TILES + F.col("i")).alias("p"),
                (F.col("c2") * _TILES + F.col("j")).alias("q")))
    work = (pairs
            .join(packed.select(F.col("tile").alias("p"),
                                F.col("fps").alias("left")), "p")
            .join(packed.select(F.col("tile").alias("q"),
                                F.col("fps").alias("right")), "q")
            .select((F.col("p") == F.col("q")).alias("same"), "left",
                    "right"))
    return arrow_map(work, _link_batches(radius), T.StructType([
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def fingerprint_components(prints: DataFrame, radius: int = RADIUS,
                           parts: int | None = None, tile: int = TILE
                           ) -> DataFrame:
    """``(fp, root)``: each distinct fingerprint and the least fingerprint
    (as a signed number) that links reach from it."""
    nodes = cut_lineage(prints.select("fp").distinct())
    root = components(links(nodes, radius, parts, tile))
    return cut_lineage(nodes.join(root, nodes.fp == root.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root")))


def simhash_components(prints: DataFrame, radius: int = RADIUS,
                       parts: int | None = None, tile: int = TILE
                       ) -> DataFrame:
    """``(doc_id, fp)`` -> those and ``component_id``, the smallest id that
    links reach, one row for each input row.

    Equal fingerprints (repeated rows, all texts without words) link. Rows
    with a null id keep a row; their component's id is the smallest that is
    not null, or null if there is none. An empty table gives no rows."""
    prints = cut_lineage(prints.select("doc_id", "fp"))
    of = fingerprint_components(prints, radius, parts, tile)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = of.join(least, "fp")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(best, "root").select("fp",
                                                         "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(documents: DataFrame, shingle: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """One row of each group of linked texts, with all columns: the one with
    the smallest id (null last; ties by the text's hash), once if it is
    repeated. See ``simhash_near_dedup`` for what links."""
    prepare(documents.sparkSession)
    names = documents.columns
    own = documents.toDF(*[c if c in ("doc_id", "text") else f"_c{i}"
                           for i, c in enumerate(names)])
    key = [F.coalesce("doc_id", F.lit(-1 << 63).cast("long")).alias("_id"),
           F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_hash")]
    plain = own.columns
    own = own.select("*", *key)
    prints = cut_lineage(fingerprints(own, ["doc_id", "_id", "_hash"],
                                      shingle))
    of = fingerprint_components(prints, radius)
    best = prints.join(of, "fp").groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("null"), "_id", "_hash"
    )).alias("k")).select("k._id", "k._hash")
    # Rows of a key are together after the join; the window needs no other
    # exchange.
    place = F.row_number().over(W.partitionBy("_id", "_hash").orderBy(
        F.lit(0)))
    return (own.join(best, ["_id", "_hash"]).withColumn("_n", place)
            .where("_n = 1").select(*plain).toDF(*names))


def simhash_near_dedup(documents: DataFrame, shingle: int = SHINGLE,
                       radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for
    each row of ``documents``. Only ``doc_id`` and ``text`` are read, so
    other columns may have any name; see ``fingerprints`` for empty and null
    texts and ``simhash_components`` for null ids, ties and repeats."""
    prepare(documents.sparkSession)
    found = simhash_components(fingerprints(documents, shingle=shingle),
                               radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0"))
                        .alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
