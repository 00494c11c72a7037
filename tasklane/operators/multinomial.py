"""K4 by splitting: every row's number of copies, without draw rows.

A task of n rows that lacks e rows gets e draws with replacement. How often a
row is drawn is multinomial, and a multinomial can be split: of the draws of a
range of ranks, a binomial number falls into its left half. Halving down to
blocks of 1,024 ranks and drawing a block's counts at once gives each row its
number from its task, its rank and the seed alone, so partitions need nothing
from each other and reruns agree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklane.operators.splits import SEED
from tasklane.plans.rank import position_buckets, two_level_rank

LEAF = 1024
MAX_TASKS = 100_000     # task sizes that the driver may hold
CHUNK = 1 << 16         # copies of a row made at a time


def _generator(seed: int, task, lo: int, hi: int) -> np.random.Generator:
    name = f"{seed}:{lo}:{hi}:{task!r}".encode()
    key = hashlib.blake2b(name, digest_size=16).digest()
    return np.random.Generator(np.random.Philox(
        key=int.from_bytes(key, "little")))


def _rows(lo: int, hi: int, n: int) -> int:
    return min(hi * LEAF, n) - lo * LEAF


class Splitter:
    """Copies by (task, rank). ``sizes`` maps a task to (n, e)."""

    def __init__(self, seed: int, sizes: dict):
        self.seed, self.sizes = seed, sizes

    def block(self, task, block: int, left) -> np.ndarray:
        """Copies of the rows of one block of ranks."""
        n, count = self.sizes[task]
        lo, hi = 0, -(-n // LEAF)
        while hi - lo > 1 and count:
            mid = (lo + hi) // 2
            first = left(task, lo, hi, count)
            if block < mid:
                hi, count = mid, first
            else:
                lo, count = mid, count - first
        size = _rows(block, block + 1, n)
        if not count:
            return np.zeros(size, np.int64)
        rng = _generator(self.seed, task, block, block + 1)
        return rng.multinomial(count, np.full(size, 1.0 / size))

    def left(self, task, lo: int, hi: int, count: int) -> int:
        """Draws of a node that fall into its left half."""
        n = self.sizes[task][0]
        share = _rows(lo, (lo + hi) // 2, n) / _rows(lo, hi, n)
        return int(_generator(self.seed, task, lo, hi).binomial(count,
                                                                share))

    def copies(self, task: pd.Series, rank: pd.Series) -> pd.Series:
        left = lru_cache(maxsize=1 << 16)(self.left)
        at = rank.to_numpy(np.int64)
        out = np.zeros(len(at), np.int64)
        if not len(at):
            return pd.Series(out)
        code, names = pd.factorize(task, use_na_sentinel=False)
        order = np.lexsort((at, code))
        c, b = code[order], at[order] // LEAF
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1])
                                   | (b[1:] != b[:-1])])
        for s, e in zip(new, [*new[1:], len(at)], strict=True):
            name = names[c[s]]
            got = self.block(None if pd.isna(name) else name, int(b[s]), left)
            rows = order[s:e]
            out[rows] = got[at[rows] - int(b[s]) * LEAF]
        return pd.Series(out)


def oversample_split(df: DataFrame, task: str = "task_id",
                     id_col: str = "id", seed: int = SEED,
                     out: str = "copy") -> DataFrame:
    """K4: every task topped up to the largest task's size by draws with
    replacement. Adds ``out``: 0 for the row itself, 1, 2, ... for its copies.

    Tasks are told apart by their string form; NULL is a task of its own.
    ``id_col`` is an integer, unique within a task. The one rank is the only
    shuffle; the task sizes are a row for each task, at most ``MAX_TASKS``.
    An empty table gives no rows.
    """
    name = F.col(task).cast("string")
    found = df.groupBy(name.alias("t")).agg(F.count(F.lit(1)).alias(
        "n")).limit(MAX_TASKS + 1).collect()
    if len(found) > MAX_TASKS:
        raise ValueError(f"more than {MAX_TASKS} tasks")
    most = max((r.n for r in found), default=0)
    sizes = {r.t: (r.n, most - r.n) for r in found}
    splitter = Splitter(seed, sizes)

    @F.pandas_udf("long")
    def copies(t: pd.Series, rank: pd.Series) -> pd.Series:
        return splitter.copies(t, rank)

    ranked = two_level_rank(df, order=[id_col],
                            buckets=position_buckets(id_col), groups=[task],
                            out="_ms_rank")
    drawn = ranked.withColumn("_ms_n", copies(name, F.col("_ms_rank")))
    parts = drawn.withColumn("_ms_c", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.col("_ms_n") / CHUNK))))
    if any(e > n * CHUNK for n, e in sizes.values()):
        # Few rows make most of the output: their chunks are dealt out.
        parts = parts.repartition(task, id_col, "_ms_c")
    return parts.select(*df.columns, F.explode(F.sequence(
        F.col("_ms_c") * CHUNK,
        F.least((F.col("_ms_c") + 1) * CHUNK - 1, F.col("_ms_n"))))
        .alias(out))
