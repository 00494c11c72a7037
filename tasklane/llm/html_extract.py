"""HTML extraction with a suffix array per host.

Markup gives each block of a page a zone (see ``html_blocks``). The token
streams of a host's pages are then concatenated and their suffixes sorted, so
that long substrings repeated across distinct pages stand next to each other.
Where markup doesn't tell what is article (zone REST), tokens covered by a
run that enough of the host's distinct pages repeat are marked. A block marked
whole goes; one that is mostly marked loses the marked runs at its ends and
keeps its unique ones; any other block is kept whole, so a sentence that pages
share is never cut out of a paragraph. Inside an article a block goes only if runs that
enough pages show outside of their articles cover all of it: a passage that
several articles share is article text. ``ENOUGH_PAGES`` distinct pages of a
host are enough whatever its size; on smaller hosts ``MIN_SHARE`` of them.

Pages are grouped by host. A host's pages are dealt by a hash into groups of
about ``GROUP_PAGES``, so no host, however large, is one task. A host of one
group sorts the suffixes to the depth of the shortest run that counts, by
prefix doubling; deeper order couldn't change what is covered. Of a host of
several groups each group first sends short prints of its runs to buckets of
the host, and learns which prints are shown often enough over all groups; runs
share prints, so none that could count is missed. Of these runs it sends the
hashes, with the pages that show them (no more than ``ENOUGH_PAGES`` of a
run); the distinct pages of all groups are counted and each group gets the
counts of its runs back. Pages are shuffled once, as text.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tasklane.llm import html_blocks as H
from tasklane.llm import kernel as K
from tasklane.llm.common import arrow_map, prepare, table
from tasklane.llm.decontaminate import Lookup
from tasklane.llm.url_filter import host_of
from tasklane.session import cut_lineage

MIN_RUN = 8            # tokens; a power of two
MIN_PAGES = 3
MIN_SHARE = 0.3
ENOUGH_PAGES = 10
BLOCK_SHARE = 0.8      # marked part of a block that loses its marked ends
GROUP_PAGES = 128
BUCKET_GROUPS = 32     # groups of a host for each bucket of its runs
PRINT_BITS = 22        # distinct prints of a bucket

_BLOCKS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url",
                                                          T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("part",
                                                         T.LongType()),
    T.StructField("zones", T.BinaryType()), T.StructField("blocks",
                                                          T.BinaryType())])
_PRINTS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("prints", T.BinaryType()),
    T.StructField("times", T.BinaryType())])
_RUNS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("runs", T.BinaryType()),
    T.StructField("pages", T.BinaryType()),
    T.StructField("chrome", T.BinaryType())])
_COUNTS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("pages", T.LongType()),
    T.StructField("runs", T.BinaryType()),
    T.StructField("often", T.BinaryType()),
    T.StructField("chrome", T.BinaryType())])
_RESULT = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url",
                                                          T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("n_chars",
                                                         T.LongType()),
    T.StructField("n_removed", T.LongType())])


def _squeezed(data: bytes) -> bytes:
    """Binary columns are shuffled as zstd, with their size before it."""
    return len(data).to_bytes(8, "little") + pa.compress(
        data, "zstd", asbytes=True)


def _whole(data: bytes | None) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd",
                         asbytes=True) if data else b""


def _block_batches(batches, schema):
    for batch in K.byte_slices(batches, "html", 4 << 20):
        pages = [H.blocks(x) for x in batch.column("html").to_pylist()]
        yield K.with_columns(batch, ["page_id", "url", "host", "part"], {
            "zones": pa.array([bytes(z for z, _ in p) for p in pages],
                              pa.binary()),
            # blocks hold no line ends
            "blocks": pa.array([_squeezed("\n".join(t for _, t in p).encode()) for p in pages],
                pa.binary())}, schema)


def suffix_classes(tokens: np.ndarray, page: np.ndarray, run: int
                   ) -> np.ndarray:
    """Sort the suffixes of the concatenated streams to depth ``run`` and
    return the class of each: equal for suffixes whose first ``run`` tokens
    are. ``page`` is the page of each token; a stream's end is like no
    token and no other end."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    ends = np.searchsorted(page, page, side="right")
    place = np.arange(n)
    step = 1
    while step < run:
        second = np.where(place + step < ends,
                          rank[np.minimum(place + step, n - 1)], n + place)
        _, rank = np.unique(rank * (2 * n + 1) + second, return_inverse=True)
        rank = rank.astype(np.int64)
        step *= 2
    return rank


def _cover(start: np.ndarray, run: int, n: int) -> np.ndarray:
    """Tokens within ``run`` of a marked suffix start."""
    edge = np.zeros(n + run + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return np.cumsum(edge)[:n] > 0


def _at_borders(gone: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """What goes of the marked tokens: all of a block that is marked whole;
    of one marked to ``BLOCK_SHARE`` or more, the runs at its start and end,
    so that a unique run between or beside them stays. Other blocks are text
    of their page's own that happens to share a sentence: they stay whole."""
    words = np.diff(ptr)
    mostly = K.sums(gone, ptr[:-1], ptr[1:]) >= BLOCK_SHARE * words
    block = K.rows_of(ptr)
    at = np.arange(len(gone))
    kept = np.flatnonzero(~gone)
    first, last = ptr[1:].copy(), ptr[:-1] - 1      # of the unmarked tokens
    np.minimum.at(first, block[kept], kept)
    np.maximum.at(last, block[kept], kept)
    return mostly[block] & ((at < first[block]) | (at > last[block]))


def _distinct(pages: list[list[tuple[int, str]]]) -> tuple[dict, np.ndarray]:
    """Pages with the same blocks count as one: their numbers."""
    alike: dict = {}
    kind = np.array([alike.setdefault(tuple(p), len(alike)) for p in pages],
                    np.int64)
    return alike, kind


def _tokens(pages):
    """Blocks' zones and texts, bytes, word spans, tokens and the offsets of
    the blocks' and of the pages' tokens."""
    zone = np.array([z for p in pages for z, _ in p], np.int64)
    texts = [t for p in pages for _, t in p]
    buf, off = K.flat(pa.array(texts, pa.large_string()))
    starts, ends, ptr = K.word_spans(buf, off)
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    return (zone, texts, buf, starts, ends, K.span_hashes(buf, starts, ends),
            ptr, ptr[first.astype(np.int64)])


def pack(numbers: np.ndarray) -> bytes:
    """Sorted numbers as gaps of seven bits a byte."""
    gaps = np.diff(numbers, prepend=0).astype(np.uint64)
    size = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        at = size > k
        out[(ends - size)[at] + k] = (gaps[at] >> np.uint64(7 * k)) & np.uint64(
            127) | np.where(size[at] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    first = np.ones(len(raw), bool)
    first[1:] = raw[:-1] < 128
    start = np.flatnonzero(first)
    place = np.arange(len(raw)) - np.repeat(start, np.diff(
        np.append(start, len(raw))))
    bits = (raw & 127) << 7 * place
    return np.cumsum(np.add.reduceat(bits, start)) if len(raw) else bits


def _buckets(parts: int) -> int:
    return -(-parts // BUCKET_GROUPS)


def _prints(runs: np.ndarray, parts: int) -> np.ndarray:
    return (runs % np.uint64(_buckets(parts) << PRINT_BITS)).astype(np.int64)


def run_pages(pages: list[list[tuple[int, str]]], min_run: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct pages; and distinct pairs of a run's hash and a
    page that shows it, with whether it does outside of its article."""
    alike, _ = _distinct(pages)
    pages = list(alike)
    own = np.array([int.from_bytes(hashlib.blake2b(
        repr(p).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
        "little") for p in pages], np.uint64)
    zone, _, _, _, _, tokens, ptr, page_ptr = _tokens(pages)
    at = K.windows(page_ptr, min_run)
    runs = K.gram_hashes(tokens, min_run)[at]
    chrome = zone[K.rows_of(ptr)[at]] == H.CHROME
    page = np.searchsorted(page_ptr, at, side="right") - 1
    # Of equal pairs the one outside of the article comes first.
    order = np.lexsort((~chrome, page, runs))
    runs, page, chrome = runs[order], page[order], chrome[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (page[1:] != page[:-1])
    return own, runs[new], own[page[new]], chrome[new]


def _few(runs: np.ndarray, chrome: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of sorted runs to give when of a run ``most`` are enough."""
    _, first = np.unique(runs, return_index=True)
    size = np.diff(np.append(first, len(runs)))
    before = np.cumsum(chrome) - chrome
    few = np.arange(len(runs)) - np.repeat(first, size) < most
    return few | chrome & (before - np.repeat(before[first], size) < most)


def _counted(runs, pages) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and the number of distinct pages of each."""
    order = np.lexsort((pages, runs))
    runs, pages = runs[order], pages[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (pages[1:] != pages[:-1])
    return np.unique(runs[new], return_counts=True)


def main_texts(pages: list[list[tuple[int, str]]], min_run: int = MIN_RUN,
               min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
               enough_pages: int = ENOUGH_PAGES, host=None
               ) -> list[tuple[str, int]]:
    """Text and number of removed tokens of each page of a group. ``host``:
    if the group isn't the whole host, the host's number of distinct pages,
    and sorted run hashes with the pages that show them at all and outside of
    their articles."""
    zone, texts, buf, starts, ends, tokens, ptr, page_ptr = _tokens(pages)
    block = K.rows_of(ptr)
    gone = np.zeros(len(tokens), bool)
    drop_block = np.zeros(len(texts), bool)
    alike, kind = _distinct(pages)
    total = host[0] if host else len(alike)
    need = max(min_pages, min(enough_pages, int(np.ceil(min_share * total))))
    if total >= min_pages and len(tokens) >= min_run:
        if host:
            at = K.windows(page_ptr, min_run)
            runs = K.gram_hashes(tokens, min_run)[at]
            same, place = Lookup(host[1]).find(runs)
            often, chrome = np.zeros((2, len(tokens)), bool)
            often[at[same]] = host[2][place] >= need
            chrome[at[same]] = host[3][place] >= need
        else:
            page = K.rows_of(page_ptr)
            rank = suffix_classes(tokens, page, min_run)
            key = rank * len(pages) + kind[page]
            often, chrome = (
                (np.bincount(np.unique(k) // len(pages),
                             minlength=int(rank.max()) + 1) >= need)[rank]
                for k in (key, key[zone[block] == H.CHROME]))
        covered = _cover(often, min_run, len(tokens))
        shown = _cover(chrome, min_run, len(tokens))
        gone = covered & (zone[block] == H.REST)
        words = np.diff(ptr)
        full = K.sums(shown, ptr[:-1], ptr[1:]) == words
        drop_block = full & (zone == H.MAIN)
        gone = _at_borders(gone, ptr)
    data, out, first = buf.tobytes(), [], 0
    for p in pages:
        here = range(first, first + len(p))
        first += len(p)
        want = H.MAIN if any(z == H.MAIN for z, _ in p) else H.REST
        parts, lost = [], 0
        for b in here:
            if zone[b] != want:
                continue
            a, z = ptr[b], ptr[b + 1]
            if drop_block[b]:
                lost += z - a
            elif gone[a:z].any():
                keep = np.flatnonzero(~gone[a:z]) + a
                lost += z - a - len(keep)
                if len(keep):
                    parts.append(b" ".join(data[s:e] for s, e in zip(
                        starts[keep].tolist(), ends[keep].tolist(),
                        strict=True)).decode())
            else:
                parts.append(texts[b])
        out.append(("\n".join(parts), int(lost)))
    return out


def _pages(group: pa.Table) -> list[list[tuple[int, str]]]:
    return [list(zip(z, _whole(t).decode().split("\n"), strict=True))
            if z else []
            for z, t in zip(group["zones"].to_pylist(),
                            group["blocks"].to_pylist(), strict=True)]


def _send_prints(min_run: int):
    """The prints of a group's runs, by bucket of its host, with the number of
    pages that show them."""
    def run(group: pa.Table) -> pa.Table:
        rows: list[dict] = []
        parts = group["parts"][0].as_py()
        if parts > 1:
            _, runs, _, _ = run_pages(_pages(group.combine_chunks()), min_run)
            prints, times = np.unique(_prints(runs, parts),
                                      return_counts=True)
            times = np.minimum(times, 255).astype(np.uint8)
            bucket = prints >> PRINT_BITS
            for b in np.unique(bucket).tolist():
                at = bucket == b
                rows.append({
                    "host": group["host"][0].as_py(), "bucket": b,
                    "part": group["part"][0].as_py(),
                    "prints": _squeezed(pack(prints[at] - (b << PRINT_BITS))),
                    "times": _squeezed(times[at].tobytes())})
        return pa.Table.from_pylist(rows, to_arrow_schema(_PRINTS))
    return run


def _common_prints(min_pages: int):
    """For each group, those of its prints that ``min_pages`` or more pages
    of the host show; copies of a page and runs of one print add up."""
    def run(bucket: pa.Table) -> pa.Table:
        own = [unpack(_whole(x)) for x in bucket["prints"].to_pylist()]
        total = np.zeros(1 << PRINT_BITS, np.int64)
        for prints, times in zip(own, bucket["times"].to_pylist(),
                                 strict=True):
            total[prints] += np.frombuffer(_whole(times), np.uint8)
        rows = []
        for prints, part in zip(own, bucket["part"].to_pylist(), strict=True):
            rows.append({"host": bucket["host"][0].as_py(),
                         "bucket": bucket["bucket"][0].as_py(), "part": part,
                         "prints": _squeezed(pack(
                             prints[total[prints] >= min_pages]))})
        return pa.Table.from_pylist(rows, to_arrow_schema(_PRINTS))
    return run


def _send_runs(min_run: int, most: int, known_pages: int):
    """A group's runs of common prints by bucket of its host. Bucket -1 gets
    its distinct pages; ``known_pages`` of them tell all that more would."""
    def run(group: pa.Table, common: pa.Table) -> pa.Table:
        rows: list[dict] = []
        parts = group["parts"][0].as_py()
        if parts > 1:
            group = group.combine_chunks()
            own, runs, pages, chrome = run_pages(_pages(group), min_run)
            wanted = [unpack(_whole(x)) + (b << PRINT_BITS) for x, b in zip(
                common["prints"].to_pylist(), common["bucket"].to_pylist(),
                strict=True)]
            at = np.isin(_prints(runs, parts), np.concatenate(
                [*wanted, np.zeros(0, np.int64)]))
            runs, pages, chrome = runs[at], pages[at], chrome[at]
            at = _few(runs, chrome, most)
            runs, pages, chrome = runs[at], pages[at], chrome[at]
            key = {"host": group["host"][0].as_py(),
                   "part": group["part"][0].as_py()}
            rows.append({**key, "bucket": -1, "pages": _squeezed(
                np.sort(own)[:known_pages].tobytes())})
            bucket = _prints(runs, parts) >> PRINT_BITS
            for b in np.unique(bucket).tolist():
                at = bucket == b
                rows.append({**key, "bucket": b,
                             "runs": _squeezed(runs[at].tobytes()),
                             "pages": _squeezed(pages[at].tobytes()),
                             "chrome": _squeezed(chrome[at].tobytes())})
        return pa.Table.from_pylist(rows, to_arrow_schema(_RUNS))
    return run


def _count_runs(min_pages: int):
    """The distinct pages of the runs in a bucket, for each group that has
    the run; runs of fewer than ``min_pages`` are left out."""
    def run(bucket: pa.Table) -> pa.Table:
        def column(name, kind):
            return [np.frombuffer(_whole(x), kind)
                    for x in bucket[name].to_pylist()]
        host, parts = bucket["host"][0].as_py(), bucket["part"].to_pylist()
        pages = column("pages", np.uint64)
        rows: list[dict] = []
        if bucket["bucket"][0].as_py() < 0:
            total = len(np.unique(np.concatenate(pages)))
            rows = [{"host": host, "part": p, "pages": total} for p in parts]
        else:
            own = column("runs", np.uint64)
            runs, page = np.concatenate(own), np.concatenate(pages)
            chrome = np.concatenate(column("chrome", bool))
            known, often = _counted(runs, page)
            shown = np.zeros(len(known), np.int64)
            some, times = _counted(runs[chrome], page[chrome])
            shown[np.searchsorted(known, some)] = times
            for p, mine in zip(parts, own, strict=True):
                place = np.unique(np.searchsorted(known, mine))
                place = place[often[place] >= min_pages]
                if len(place):
                    rows.append({"host": host, "part": p,
                                 "runs": _squeezed(known[place].tobytes()),
                                 "often": _squeezed(often[place].tobytes()),
                                 "chrome": _squeezed(shown[place].tobytes())})
        return pa.Table.from_pylist(rows, to_arrow_schema(_COUNTS))
    return run


def _group(min_run: int, min_pages: int, min_share: float,
           enough_pages: int):
    def run(group: pa.Table, counts: pa.Table) -> pa.Table:
        group, host = group.combine_chunks(), None
        if counts.num_rows:
            runs, often, chrome = (np.concatenate([
                np.frombuffer(_whole(x), kind)
                for x in counts[name].to_pylist()]) for name, kind in (
                    ("runs", np.uint64), ("often", np.int64),
                    ("chrome", np.int64)))
            order = np.argsort(runs)
            host = (max(x or 0 for x in counts["pages"].to_pylist()),
                    runs[order], often[order], chrome[order])
        found = main_texts(_pages(group), min_run, min_pages, min_share,
                           enough_pages, host)
        return pa.table({
            "page_id": group["page_id"], "url": group["url"],
            "text": pa.array([t for t, _ in found], pa.string()),
            "n_chars": pa.array([len(t) for t, _ in found], pa.int64()),
            "n_removed": pa.array([n for _, n in found], pa.int64())})
    return run


def html_extract(pages: DataFrame, min_run: int = MIN_RUN,
                 min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                 group_pages: int = GROUP_PAGES,
                 enough_pages: int = ENOUGH_PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) and
    ``n_removed`` (tokens found to be boilerplate) for each row of ``pages``.

    Null or empty html gives an empty text; pages without a host (null URL)
    form a group like a host's. Repeated rows each give a row and count once
    as evidence. Other columns aren't read; an empty table gives no rows."""
    if min_run < 2 or min_run & (min_run - 1):
        raise ValueError("min_run must be a power of two")
    prepare(pages.sparkSession)
    own = pages.select("page_id", "url", "html",
                       host_of(F.col("url")).alias("host"))
    # One row per host: how many groups its pages are dealt to.
    counts = cut_lineage(own.groupBy("host").agg(F.ceil(
        F.count("*") / group_pages).cast("long").alias("parts")))
    deal = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20))
    parted = own.select("page_id", "url", "html", "host",
                        deal.alias("part"))
    rows = arrow_map(parted, _block_batches, _BLOCKS)
    rows = rows.join(F.broadcast(counts) if _small(counts) else counts,
                     "host").withColumn(
                         "part", F.col("part") % F.col("parts"))
    groups = rows.groupBy("host", "part")
    most = max(min_pages, enough_pages)
    known = max(min_pages, math.ceil(most / min_share) if min_share else 0)
    common = groups.applyInArrow(_send_prints(min_run), _PRINTS).groupBy(
        "host", "bucket").applyInArrow(_common_prints(min_pages), _PRINTS)
    runs = groups.cogroup(common.groupBy("host", "part")).applyInArrow(
        _send_runs(min_run, most, known + 1), _RUNS)
    found = runs.groupBy("host", "bucket").applyInArrow(
        _count_runs(min_pages), _COUNTS)
    return groups.cogroup(found.groupBy("host", "part")).applyInArrow(
        _group(min_run, min_pages, min_share, enough_pages), _RESULT)


def _small(counts: DataFrame, rows: int = 200_000) -> bool:
    """Checked size of the host table; beyond it the join shuffles."""
    return counts.count() <= rows


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract(table(spark, sf_dir, "pages"))
